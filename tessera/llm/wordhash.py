"""Words of UTF-8 texts and their 64-bit hashes, a batch of texts at a time.

Every byte gets a random 64-bit value; a word's hash is the polynomial of its
bytes' values modulo 2^64, read off prefix sums, then mixed.  The work is done
in blocks cut at word ends, so memory does not grow with a text's length.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 18
_P = 0x9E3779B97F4A7C17  # odd, and P - 1 has one factor of two only
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

#: Word bytes of `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the whole value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = _powers(_P, 1)
    down = _powers(pow(_P, -1, 1 << 64), 1)

    @classmethod
    def to(cls, n: int):
        if len(cls.up) < n:
            cls.up = _powers(_P, n)
            cls.down = _powers(pow(_P, -1, 1 << 64), n)
        return cls.up, cls.down


def _hash_block(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of one block."""
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.to(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[buf] * up[:len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def words(texts: list, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the hashes of all words of the lower-cased texts, in
    order; those of text i are hashes[first[i]:first[i + 1]].  None has none."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=offsets[1:])
    buf = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)]
    starts, hashes = [], []
    at = 0
    while at < len(buf):
        end = min(len(buf), at + _BLOCK)
        while end < len(buf) and word_bytes[buf[end - 1]]:  # to the end of the word
            stop = np.flatnonzero(~word_bytes[buf[end:end + _BLOCK]])
            end = end + int(stop[0]) + 1 if len(stop) else min(len(buf), end + _BLOCK)
        s, h = _hash_block(buf[at:end], word_bytes[buf[at:end]])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


_Q = np.uint64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; of the whole, if there are fewer."""
    size = min(size, len(hashes))
    if not size:
        return np.empty(0, np.uint64)
    n = len(hashes) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _Q + hashes[k:k + n]
    return mix(out + np.uint64(size))


def slabs(texts: list, most: int = 4 << 20):
    """Ranges of rows whose texts have up to `most` characters together (a
    longer text is alone)."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)
