"""Array helpers that need Python: Arrow-batched, never row-at-a-time.

Spark has no built-in running sum over an array.  `aggregate` with `concat`
is quadratic in the array length, and a window over exploded elements needs a
shuffle of every element by its row key.  A vectorised cumulative sum per row,
shipped as an Arrow batch of integer arrays (not the text), keeps the work in
the scan stage and linear.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.LongType()))
def exclusive_prefix_sums(lengths: pd.Series) -> pd.Series:
    """[a, b, c] -> [0, a, a+b]."""
    out = []
    for arr in lengths:
        if arr is None:
            out.append(None)
            continue
        v = np.asarray(arr, dtype=np.int64)
        c = np.empty(len(v), dtype=np.int64)
        if len(v):
            c[0] = 0
            np.cumsum(v[:-1], out=c[1:])
        out.append(c)
    return pd.Series(out)


def line_start_offsets(lines: Column) -> Column:
    """0-based character offset of each line, lines joined by one newline."""
    return exclusive_prefix_sums(F.transform(lines, lambda l: F.length(l) + 1))
