"""Global row positions without a single-task window.

`row_number() over (order by k)` with no partition puts every row in one task.
Instead: range-partition and sort on the key (distributed), tag each row with
its partition id and in-partition position, cut the lineage with a reliable
checkpoint (so the second pass sees the very same partitions), count rows per
partition (one tiny row per partition), turn the counts into offsets, and add
them back through a broadcast join on the partition id.  The broadcast side
has one row per partition, a bound known before the job runs.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir
from tessera.functions.joins import broadcast_if_small


def with_row_index(df: DataFrame, order: Sequence[Column | str], group_cols: Sequence[str] = (),
                   index_col: str = "row_idx", total_col: str | None = None) -> DataFrame:
    """Add a 0-based position by `order` (within `group_cols` if given).

    `order` must be a total order (append a unique key as tie-break)."""
    ensure_checkpoint_dir(df.sparkSession)
    g = list(group_cols)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    sort_cols = [F.col(c) for c in g] + order_cols
    tagged = (df.orderBy(*sort_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    counts = tagged.groupBy(*g, "_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_m0"))
    # Rows of one group can span several partitions; offsets run over the
    # partitions in order, within each group.  This table has at most
    # (#partitions + #groups) rows.
    w = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    if total_col:
        offs = offs.withColumn(total_col, F.sum("_n").over(Window.partitionBy(*g)))
    keep = [*g, "_pid", "_off", "_m0"] + ([total_col] if total_col else [])
    # One row per (group, partition): at most #partitions rows without
    # groups.  With groups the offsets are materialised first (they are needed
    # before the join anyway) and their exact row count is the bound.
    side = offs.select(*keep)
    if not g:
        bound = tagged.rdd.getNumPartitions()
    else:
        side = side.checkpoint(eager=True)
        bound = side.count()
    out = tagged.join(broadcast_if_small(side, row_bound=bound), [*g, "_pid"])
    return out.withColumn(index_col, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long")) \
              .drop("_pid", "_mid", "_off", "_m0")
