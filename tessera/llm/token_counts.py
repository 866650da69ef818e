"""Operator 6: greedy word-piece counts by a linear longest-match automaton.

Words are `[^\\x20\\x09-\\x0D]+`; each gets the vocabulary's word-start mark
in front and is split greedily, always into the longest piece that fits.  A
character that no piece covers counts as its UTF-8 bytes.  Only the number of
pieces is wanted, so no piece is built: the trie of the vocabulary has failure
links, and with each link the number of pieces that are popped when it is
taken.  One pass over a word, each character once, gives its count; the cost
is linear in the word's length whatever the vocabulary holds.

Null, empty and blank texts have 0 words and 0 tokens.  Each row is counted on
its own, so repeated rows are repeated.  Workers keep the counts of short
words in a bounded cache.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame

CACHED = 500_000
LONGEST_CACHED = 64


class Automaton:
    """Trie of the pieces with failure links and popped-token counts."""

    def __init__(self, pieces: list[str]):
        nxt: list[dict[str, int]] = [{}]
        end: list[int] = [0]  # pieces that a node's string stands for, if it ends a piece

        def add(s: str, n: int) -> None:
            at = 0
            for c in s:
                if c not in nxt[at]:
                    nxt[at][c] = len(nxt)
                    nxt.append({})
                    end.append(0)
                at = nxt[at][c]
            end[at] = end[at] or n

        for p in pieces:
            if p:
                add(p, 1)
        for c in sorted({c for p in pieces for c in p}):  # a character that only longer pieces hold counts as bytes
            add(c, len(c.encode("utf-8", "surrogatepass")))
        self.next, self.fail, self.popped = nxt, [0] * len(nxt), [0] * len(nxt)
        level = [(0, c, v) for c, v in nxt[0].items()]
        while level:
            below = []
            for u, c, v in level:
                if end[v]:
                    self.fail[v], self.popped[v] = 0, end[v]
                else:
                    z, n = self.fail[u], self.popped[u]
                    while c not in nxt[z]:  # ends at the root, where every character of a piece goes on
                        n += self.popped[z]
                        z = self.fail[z]
                    self.fail[v], self.popped[v] = nxt[z][c], n
                below += [(v, d, w) for d, w in nxt[v].items()]
            level = below

    def count(self, word: str) -> int:
        nxt, fail, popped = self.next, self.fail, self.popped
        n, at = 0, 0
        for c in word:
            while (to := nxt[at].get(c)) is None:
                if not at:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    to = 0
                    break
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton, mark: str):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + word.decode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.clear()
            self[word] = n
        return n


def read_pieces(path: str) -> list[str]:
    """Normal pieces of a sentencepiece model file, without control, unknown
    and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


@functools.lru_cache(maxsize=2)
def _counts(pieces: tuple, mark: str) -> _Counts:
    return _Counts(Automaton(list(pieces)), mark)


def token_counts(docs: DataFrame, pieces: list[str], mark: str = "▁", id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, `n_words` and `n_tokens`.  `pieces`
    is broadcast; its size is that of the vocabulary file."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pieces))
    id_type = docs.schema[id_col].dataType.simpleString()

    def batches(it):
        counts = _counts(shared.value, mark)
        for b in it:
            n_words, n_tokens = [], []
            for text in b.column(1).to_pylist():
                ws = text.encode("utf-8", "surrogatepass").split() if text else ()
                n_words.append(len(ws))
                n_tokens.append(sum(map(counts.__getitem__, ws)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             names=[id_col, "n_words", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {id_type}, n_words long, n_tokens long")
