"""Longest common subsequence and edit distance of two token arrays, Arrow-batched.

Spark's higher-order functions can express the LCS dynamic program, but each
DP row needs a prefix maximum, which makes it cubic in the token count.  Here
the DP runs bit-parallel (one machine-word operation per 64 cells, Python
integers as bit vectors): for each token of `a`, with `M` the bit mask of the
positions of that token in `b` and `V` the running vector (initially all ones),
``U = V & M; V = (V + U) | (V - U)``; the LCS length is the number of zero bits
of `V` in the low ``len(b)`` bits (Crochemore et al. 2001, Hyyrö 2004).

The edit distance keeps the vertical differences of the table as two vectors
(+1 and -1) and reads the last row's change off the horizontal ones (Myers
1999, Hyyrö 2003).  Both use the same position masks.  Tokens come as 64-bit
hashes, so no alphabet is built and their number is not bounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_masks(b) -> dict:
    """Per token the bits of its positions."""
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    return masks


def lcs_length(a, b, masks: dict | None = None) -> int:
    m = len(b)
    if m == 0 or len(a) == 0:
        return 0
    masks = token_masks(b) if masks is None else masks
    full = (1 << m) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def edit_distance(a, b, masks: dict | None = None) -> int:
    """Insertions, deletions and substitutions that turn `a` into `b`."""
    m = len(b)
    if m == 0 or len(a) == 0:
        return max(m, len(a))
    masks = token_masks(b) if masks is None else masks
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    for tok in a:
        same = masks.get(tok, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus = down | (full & ~(diagonal | up))
        minus = diagonal & up
        distance += bool(plus & last) - bool(minus & last)
        plus = (plus << 1) | 1
        up = ((minus << 1) | ~(diagonal | plus)) & full
        down = plus & diagonal & full
    return distance


PAIR_TYPE = T.StructType([T.StructField("lcs", T.LongType()), T.StructField("distance", T.LongType())])


@F.pandas_udf(PAIR_TYPE)
def _pair_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b):
        if x is None or y is None:
            rows.append((None, None))
            continue
        x, y = x.tolist(), y.tolist()
        masks = token_masks(y)
        rows.append((lcs_length(x, y, masks), edit_distance(x, y, masks)))
    return pd.DataFrame(rows, columns=["lcs", "distance"], dtype="Int64")


def token_hashes(tokens: Column) -> Column:
    """The tokens as 64-bit hashes: numbers cross to Python without decoding."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def lcs_and_distance(a: Column, b: Column) -> Column:
    """struct<lcs, distance> of two token arrays; null for null arrays."""
    return _pair_udf(token_hashes(a), token_hashes(b))


def lcs(a: Column, b: Column) -> Column:
    return lcs_and_distance(a, b)["lcs"]
