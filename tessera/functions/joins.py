"""Broadcast behind a size check.

`broadcast_if_small` hints a broadcast only when a side's bytes are known to
be below a limit: by the optimizer's estimate (file sizes, literal rows), by
the width of its columns times a proven row bound, or, where a column has no
fixed width, by measuring it.  Beyond the limit the side is returned unhinted:
the planner picks a shuffle join and AQE can still switch to a broadcast at run
time if the materialised side turns out small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hint limit for an explicit broadcast (bytes).
BROADCAST_MAX_BYTES = 64 << 20

_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
          T.DateType, T.TimestampType, T.DecimalType)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _fixed_width(t: T.DataType) -> bool:
    return isinstance(t, _FIXED) or isinstance(t, T.ArrayType) and _fixed_width(t.elementType)


def side_bytes(df: DataFrame, row_bound: int) -> int:
    """Bytes of a side of at most `row_bound` rows: by its width if all columns
    are numbers (of one row also short arrays of them), else measured, which
    runs it once."""
    kinds = [f.dataType for f in df.schema.fields]
    if all(isinstance(t, _FIXED) for t in kinds) or row_bound == 1 and all(_fixed_width(t) for t in kinds):
        return row_bound * 64 * len(kinds)
    size = sum((F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) for c in df.columns), F.lit(16))
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) * 4


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                       row_bound: int | None = None) -> DataFrame:
    """Broadcast `df` if its bytes are known to be at most `max_bytes`.

    `row_bound` is a proven upper bound on the number of rows (a vocabulary
    size, a number of groups); a side without one goes by the estimate alone."""
    est = estimated_bytes(df)
    if est > max_bytes and row_bound is not None:
        est = side_bytes(df, row_bound)
    return F.broadcast(df) if est <= max_bytes else df


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Record a proven upper bound on the rows of `df` (a vocabulary of a
    requested size, a literal axis table) for `broadcast_if_small`."""
    if rows is not None:
        df._tessera_rows = int(rows)
    return df


def bound_of(df: DataFrame) -> int | None:
    return getattr(df, "_tessera_rows", None)


def broadcast_bounded(side: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """`broadcast_if_small` using the row bound recorded on `origin` (the
    frame `side` was projected from) or on `side` itself."""
    b = bound_of(origin) if origin is not None else None
    return broadcast_if_small(side, row_bound=b if b is not None else bound_of(side))
