"""Operator 2: benchmark decontamination with training suffix arrays.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  The
training texts are dealt into shards (slabs of a partition's documents).  A
shard gets the suffix array of its words: positions sorted by the words that
follow.  Every test suffix (a benchmark item from each of its words on) is
binary-searched in it; the range it meets holds all places with the same
window, and each is extended word by word to the longest verbatim match.

A suffix can only match where its first words are first words of a window, so
the other positions are left out of the array before sorting.  Words are
compared as numbers: a benchmark word's number in the benchmark's own
vocabulary, 0 for all others, which match nothing.

Window: `window` consecutive item words; an item with fewer words, but not
none, is one window.  Null and empty texts have no words and no hits, an empty
benchmark hits nothing; repeated rows are searched row by row.  Items with
equal texts are all reported.  A shard holds a few MB of text, a longer
document is a shard of its own.  The benchmark is the stated query set: it is
cut into blocks of bounded size, and every shard is searched for every block,
so only a block is in memory at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordhash

WINDOW = 10
BLOCK_CHARS = 8 << 20  # benchmark characters in a block
KEYED = 3  # first words that a suffix needs to enter the array


class Block:
    """The test suffixes of some benchmark items, ready to be searched."""

    def __init__(self, ids: list, texts: list, window: int):
        hashes, first = wordhash.words(texts, wordhash.LETTERS)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        number = (number + 1).astype(np.int64)
        n = np.diff(first)
        self.ids = ids
        # The items' words one after the other, `window` zeros behind each.
        self.item_first = first[:-1] + window * np.arange(len(ids))
        self.words = np.zeros(len(hashes) + window * len(ids), dtype=np.int64)
        self.words[np.arange(len(hashes)) + window * np.repeat(np.arange(len(ids)), n)] = number
        # Windows: where they start and how many words they have.
        counts = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(ids)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.item, self.offset = item, offset
        self.at = self.item_first[item] + offset
        self.length = np.minimum(n, window)[item]
        self.window = window
        rows = self.words[self.at[:, None] + np.arange(window)] if len(self.at) else np.zeros((0, window), np.int64)
        behind = np.arange(window) >= self.length[:, None]
        self.low = _keys(np.where(behind, 0, rows))
        self.high = _keys(np.where(behind, 0xFFFFFFFF, rows))
        self.keyed = min([KEYED, *self.length.tolist()])
        self.starts = np.unique(_joined(self.words, self.at, self.keyed)) if len(self.at) else np.empty(0, np.uint64)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i + 1, 0)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort in the same order."""
    raw = np.ascontiguousarray(rows.astype(">u4"))
    return raw.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.empty(0, f"S{4 * rows.shape[1]}")


def _joined(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """One number for the n words from each position on."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[at + k].astype(np.uint64)
    return wordhash.mix(out)


def search(block: Block, hashes: np.ndarray, first: np.ndarray) -> tuple:
    """Longest matches in one shard: (document, word in it, item, word in it,
    words) of each place and test suffix whose window agrees."""
    w, n_docs = block.window, len(first) - 1
    # As in a block: documents one after the other, zeros behind each.
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    words = np.zeros(len(hashes) + w * (n_docs + 1), dtype=np.int64)
    words[np.arange(len(hashes)) + w * doc] = block.number(hashes)
    at = np.flatnonzero(words)
    if not len(at) or not len(block.at):
        return (np.empty(0, np.int64),) * 5
    key = _joined(words, at, block.keyed)
    i = np.minimum(np.searchsorted(block.starts, key), len(block.starts) - 1)
    at = at[block.starts[i] == key]
    suffixes = _keys(words[at[:, None] + np.arange(w)])
    order = np.argsort(suffixes, kind="stable")
    at, suffixes = at[order], suffixes[order]  # the suffix array
    low, high = np.searchsorted(suffixes, block.low, "left"), np.searchsorted(suffixes, block.high, "right")
    found = np.maximum(high - low, 0)
    suffix = np.repeat(np.arange(len(block.at)), found)
    place = at[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)]
    length = block.length[suffix].copy()
    test = block.at[suffix]
    grow = np.arange(len(place))
    while len(grow):  # one word more as long as both go on alike
        a, b = place[grow] + length[grow], test[grow] + length[grow]
        same = words[np.minimum(a, len(words) - 1)] * (a < len(words))
        grow = grow[(same > 0) & (same == block.words[np.minimum(b, len(block.words) - 1)] * (b < len(block.words)))]
        length[grow] += 1
    starts = first[:-1] + w * np.arange(n_docs)
    d = np.searchsorted(starts, place, "right") - 1
    return d, place - starts[d], block.item[suffix], block.offset[suffix], length


def _maximal(d, p, i, o, n) -> np.ndarray:
    """The matches that are not the tail of another match of the same texts."""
    if not len(d):
        return np.empty(0, np.int64)
    order = np.lexsort((p, p - o, i, d))
    d, p, i, o = d[order], p[order], i[order], o[order]
    tail = (np.diff(d, prepend=-1) == 0) & (np.diff(i, prepend=-1) == 0) & (np.diff(p - o, prepend=0) == 0) & (np.diff(p, prepend=-9) == 1)
    return order[~tail]


_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))


def search_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                     text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, `n_words`, `n_hit` (words inside any
    occurrence of a window), `items` (ids, as strings, of the items with
    occurring windows) and `matches`: the longest matches as (item_id,
    item_word, doc_word, n_words), words counted from 0."""
    sc = docs.sparkSession.sparkContext
    blocks, ids, texts, size = [], [], [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t or "")
        if size >= BLOCK_CHARS:
            blocks.append(sc.broadcast((ids, texts)))
            ids, texts, size = [], [], 0
    blocks.append(sc.broadcast((ids, texts)))
    only = len(blocks) == 1
    id_type = docs.schema[id_col].dataType.simpleString()

    def batches(it):
        ready = Block(*blocks[0].value, window) if only else None
        for b in it:
            texts = b.column(1).to_pylist()
            for lo, hi in wordhash.slabs(texts):
                yield _search_slab(b.column(0)[lo:hi], texts[lo:hi], [ready] if only else (Block(*x.value, window) for x in blocks))

    def _search_slab(keys, texts, searched):
        hashes, first = wordhash.words(texts, wordhash.LETTERS)
        cover = np.zeros(len(hashes) + 1, dtype=np.int64)
        items: list[set] = [set() for _ in texts]
        matches: list[list] = [[] for _ in texts]
        for block in searched:
            d, p, i, o, n = search(block, hashes, first)
            np.add.at(cover, first[d] + p, 1)
            np.add.at(cover, first[d] + p + n, -1)
            for x, y in set(zip(d.tolist(), i.tolist())):
                items[x].add(block.ids[y])
            for k in _maximal(d, p, i, o, n).tolist():
                matches[d[k]].append({"item_id": block.ids[i[k]], "item_word": int(o[k]), "doc_word": int(p[k]), "n_words": int(n[k])})
        hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        n_hit = hit[first[1:]] - hit[first[:-1]]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())), pa.array(matches, _MATCH)],
            names=[id_col, "n_words", "n_hit", "items", "matches"])

    return docs.select(id_col, text_col).mapInArrow(
        batches, f"`{id_col}` {id_type}, n_words long, n_hit long, items array<string>, "
                 "matches array<struct<item_id: string, item_word: long, doc_word: long, n_words: long>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digest of search_documents: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated."""
    found = search_documents(docs, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
