"""Operator 9: byte-level BPE through a serialised sentencepiece model.

The vocabulary (byte strings with ranks) is written directly as a
sentencepiece model: a piece is a token's bytes, each byte mapped to one
printable character; its score is its negative rank; the type is BPE and the
normalisation the identity.  Merging the best-scored pair, leftmost first, is
then merging the lowest rank.  Pre-tokens (matches of the pattern) are encoded
one by one; a pre-token that is itself a token is that token.  Decoding maps
ids to pieces and pieces back to bytes, so any text comes back byte for byte.

Null and empty texts have no ids and decode to no bytes.  Repeated rows are
encoded like any other row.  Long texts need memory for their own pre-tokens
only; the cache of pre-tokens is bounded.
"""

from __future__ import annotations

import base64
import functools
import itertools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import held
from tessera.llm.wordhash import slabs

CACHED = 200_000  # pre-tokens kept by a worker: those that are no token themselves
SLAB = 1 << 18    # characters that are split at once
LONGEST_CACHED = 64


@functools.cache
def byte_chars() -> list[str]:
    """One printable character for every byte: itself where it is printable
    and not a space, else the next unused one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank per line), by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    out = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in out] != list(range(len(out))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise(tokens: list[bytes]) -> bytes:
    """The model file: pieces, trainer and normalizer specification in the
    public ModelProto layout.  The unknown piece comes last, so ids are ranks."""
    chars = byte_chars()
    body = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        body += _message(1, _message(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))
    body += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    n = len(tokens)
    off = (1 << 64) - 1  # -1: no such id
    body += _message(2, _number(3, 2) + _number(4, n + 1) + _number(40, n) + _number(41, off) + _number(42, off) + _number(43, off))
    body += _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(body)


def _class(member: str) -> str:
    """The characters up to U+FFFF that match a one-character pattern of the `regex`
    library, as the inside of a character class of `re`."""
    import regex

    test = regex.compile(member).fullmatch
    found = [i for i in range(0x10000) if not 0xD800 <= i < 0xE000 and test(chr(i))]
    ends = [i for i, c in enumerate(found) if i + 1 == len(found) or found[i + 1] != c + 1]
    starts = [0, *[i + 1 for i in ends[:-1]]]
    return "".join(f"\\u{found[a]:04x}-\\u{found[b]:04x}" for a, b in zip(starts, ends))


def splitter(pattern: str):
    """findall of the pattern.  Its letter, number and space classes are spelled out
    from the `regex` library's own, for `re`, which is faster up to U+FFFF; texts
    with characters beyond, and patterns with other means, stay with `regex`."""
    import re

    import regex

    whole = regex.compile(pattern).findall
    known, out, at, inside = {r"\p{L}", r"\p{N}", r"\s", r"\S"}, [], 0, False
    while at < len(pattern):
        name = next((k for k in known if pattern.startswith(k, at)), None)
        if name is None and (pattern[at] == "\\" or pattern[at:at + 2] in ("[[", "++", "*+", "?+", "}+")) or name == r"\S" and inside:
            return whole
        if name:
            chars = _class(name if name != r"\S" else r"\s")
            out.append(chars if inside else f"[^{chars}]" if name == r"\S" else f"[{chars}]")
            at += len(name)
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    fast, beyond = re.compile("".join(out)).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: whole(text) if not text.isascii() and beyond(text) else fast(text)


class Codec:
    """Encoder and decoder of one worker, a slab of texts at a time."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = splitter(pattern)
        self.chars = byte_chars()
        self.table = {i: c for i, c in enumerate(self.chars)}
        byte_of = {c: b for b, c in enumerate(self.chars)}
        pieces = [bytes(byte_of[c] for c in self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size() - 1)]
        self.pieces = pa.array(pieces, pa.large_binary())
        self.whole = {p: struct.pack("<I", i) for i, p in enumerate(pieces)}
        self.cache: dict[str, bytes] = {}  # used since the older ones were set aside
        self.older: dict[str, bytes] = {}

    def _learn(self, unseen: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that are no tokens, all in one call of the model."""
        found = self.sp.encode([p.encode().decode("latin-1").translate(self.table) for p in unseen], num_threads=1) if unseen else []
        packed = np.fromiter(itertools.chain.from_iterable(found), dtype="<u4").tobytes()
        out, at = {}, 0
        for p, n in zip(unseen, map(len, found)):
            out[p] = packed[at:at + 4 * n]
            at += 4 * n
        return out

    def _keep(self, used: dict[str, bytes]) -> None:
        """What is in use stays: of the rest, what was not used again goes first."""
        self.cache.update((p, x) for p, x in used.items() if len(p) <= LONGEST_CACHED)
        if len(self.cache) > CACHED // 2:
            self.older, self.cache = dict(itertools.islice(self.cache.items(), CACHED // 2)), {}

    def encode(self, texts: list) -> list[bytes]:
        """Each distinct pre-token of the texts is looked up once; one Arrow take
        lays the ids of all pre-tokens one after the other."""
        split = [self.find(t) if t else [] for t in texts]
        many = np.array([len(x) for x in split], dtype=np.int64)
        coded = pa.array(list(itertools.chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        del split
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [self.whole.get(p.encode()) for p in own]
        rest = [p for p, x in zip(own, ids) if x is None]
        known = [self.cache.get(p) for p in rest]
        again = {p: self.older.get(p) for p, x in zip(rest, known) if x is None}
        again |= self._learn([p for p, x in again.items() if x is None])
        if again:
            rest = iter([again[p] if x is None else x for p, x in zip(rest, known)])
            self._keep(again)
        else:
            rest = iter(known)
        ids = [next(rest) if x is None else x for x in ids]
        return _cut(pa.array(ids, pa.large_binary()).take(coded.indices), many)

    def decode(self, ids: list) -> list[bytes]:
        many = np.array([len(x) // 4 if x else 0 for x in ids], dtype=np.int64)
        return _cut(self.pieces.take(pa.array(np.frombuffer(b"".join([x for x in ids if x]), dtype="<u4").astype(np.int32))), many)


def _cut(taken: pa.Array, many: np.ndarray) -> list[bytes]:
    """Rows of so many of the values each, whose bytes lie one after the other."""
    if not len(taken):
        return [b""] * len(many)
    _, offsets, data = taken.buffers()
    cut = np.frombuffer(offsets, dtype=np.int64)[np.concatenate([[0], np.cumsum(many)])].tolist()
    data = memoryview(data)
    return [bytes(data[a:b]) for a, b in zip(cut, cut[1:])]


def _codec(model: bytes, pattern: str) -> Codec:
    return held(("byte_bpe", model, pattern), lambda: Codec(model, pattern))


def _encoded(codec: Codec, texts: list) -> list[bytes]:
    return [x for lo, hi in slabs(texts, SLAB) for x in codec.encode(texts[lo:hi])]


def _decoded(codec: Codec, rows: list) -> list[bytes]:
    return [x for lo, hi in slabs(rows, 4 * SLAB) for x in codec.decode(rows[lo:hi])]


def _model(spark: SparkSession, path: str):
    """The serialised model, broadcast; its size is that of the vocabulary file."""
    return spark.sparkContext.broadcast(serialise(read_ranks(path)))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, `ids` (binary, little-endian unsigned
    32-bit integers), `n_tokens` and `decoded` (binary).  A text is encoded once and
    its ids decoded in the same batch: of two chained column functions Spark runs
    the first for each of its uses."""
    model = _model(docs.sparkSession, path)
    id_type = docs.schema[id_col].dataType

    def batches(it):
        codec = _codec(model.value, pattern)
        for b in it:
            ids = _encoded(codec, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(_decoded(codec, ids), pa.binary())],
                                             names=[id_col, "ids", "decoded"])

    kind = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(batches, kind).select(
        id_col, "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), "decoded")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
