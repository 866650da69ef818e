"""Batching and collation.

Batches are consecutive runs of `batch_size` rows by a row order.  Positions
come from the distributed row index (no single-task window); padding is a
window per batch, whose size is bounded by `batch_size`.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import hash_order_key
from tessera.operators.ordering import with_row_index
from tessera.functions.joins import broadcast_if_small

# Fixed values.
BATCH_SIZE = 32
EFFECTIVE_BATCH = 256
PAD_MULTIPLE = 8


def batch_assign(df: DataFrame, key, batch_size: int = BATCH_SIZE,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """B1: row_idx by key (original order), batch_id = row_idx div batch_size;
    the last partial batch is kept.  `key` is a column name or a list."""
    idx = with_row_index(df, [key] if isinstance(key, str) else list(key), group_cols)
    return idx.withColumn("batch_id", F.floor(F.col("row_idx") / batch_size).cast("long"))


def batch_shuffled(df: DataFrame, key: str, seed: int, epoch: int,
                   batch_size: int = BATCH_SIZE, group_cols: Sequence[str] = ()) -> DataFrame:
    """B2: a shuffled order per (seed, epoch) from md5 of the key, then B1."""
    h = hash_order_key(f"{seed}-{epoch}", key)
    idx = with_row_index(df.withColumn("_h", h), ["_h", key], group_cols)
    return idx.drop("_h").withColumn("batch_id", F.floor(F.col("row_idx") / batch_size).cast("long"))


def _v(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _pad(arr: Column, width: Column, value) -> Column:
    return F.concat(arr, F.array_repeat(_v(value), width - F.size(arr)))


def pad_batches(df: DataFrame, batch_cols: Sequence[str], pad_id,
                multiple: int = PAD_MULTIPLE) -> DataFrame:
    """B3 + B4: pad each array column to the longest row of its batch, rounded
    up to a multiple of 8.  Pad id for input_ids and labels, 0 for the mask.
    Input and label widths are computed separately (encoder and decoder)."""
    w = Window.partitionBy(*batch_cols)
    out = df
    if "input_ids" in df.columns:
        win = (F.ceil(F.max(F.size("input_ids")).over(w) / multiple) * multiple).cast("int")
        out = out.withColumn("_wi", win)
        out = out.withColumn("input_ids", _pad(F.col("input_ids"), F.col("_wi"), pad_id))
        if "attention_mask" in df.columns:
            out = out.withColumn("attention_mask", _pad(F.col("attention_mask"), F.col("_wi"), 0))
        out = out.drop("_wi")
    if "labels" in df.columns:
        wl = (F.ceil(F.max(F.size("labels")).over(w) / multiple) * multiple).cast("int")
        out = out.withColumn("_wl", wl).withColumn("labels", _pad(F.col("labels"), F.col("_wl"), pad_id)) \
                 .drop("_wl")
    return out


def nonpad_count(arr: Column, pad_id) -> Column:
    """Number of real tokens."""
    return F.size(F.filter(arr, lambda x: x != _v(pad_id)))


def bool_mask(arr: Column) -> Column:
    """0/1 mask as booleans."""
    return F.transform(arr, lambda x: x == 1)


def batch_budget(df: DataFrame, batch_cols: Sequence[str], labels: str, pad_id) -> DataFrame:
    """Generation budget per batch = max non-pad label count - 1 (BOS)."""
    return df.groupBy(*batch_cols).agg((F.max(nonpad_count(F.col(labels), pad_id)) - 1).alias("budget"))


def batch_plan(df: DataFrame, split_col: str = "split", batch_size: int = BATCH_SIZE,
               epochs: int = 5, effective_batch: int = EFFECTIVE_BATCH) -> DataFrame:
    """Batches per split, total steps over the epochs, gradient accumulation."""
    return df.groupBy(split_col).agg(F.count("*").alias("n_rows")).select(
        split_col, "n_rows",
        F.ceil(F.col("n_rows") / batch_size).cast("long").alias("n_batches"),
        (F.ceil(F.col("n_rows") / batch_size) * epochs).cast("long").alias("total_steps"),
        F.lit(effective_batch // batch_size).alias("grad_accum"))


def limit_batches(batched: DataFrame, fraction: float, group_cols: Sequence[str] = ()) -> DataFrame:
    """Keep the leading floor(fraction * n_batches) batches (a fraction of
    1.0 keeps all).  n_batches comes from a small per-group aggregate."""
    if fraction >= 1.0:
        return batched
    nb = batched.groupBy(*group_cols).agg((F.max("batch_id") + 1).alias("_nb"))
    j = batched.crossJoin(broadcast_if_small(nb, row_bound=1)) if not group_cols \
        else batched.join(broadcast_if_small(nb), list(group_cols))
    return j.filter(F.col("batch_id") < F.floor(F.col("_nb") * F.lit(fraction))).drop("_nb")


def trim_eos(arr: Column, eos_id) -> Column:
    """Cut just before the first EOS; unchanged when there is none."""
    pos = F.array_position(arr, _v(eos_id))
    return F.when(pos > 0, F.slice(arr, 1, (pos - 1).cast("int"))).otherwise(arr)


def trim_length(pred: Column, target: Column, n_real: Column) -> tuple[Column, Column]:
    """C14: prediction to n - 1 tokens (no BOS), target to n tokens."""
    return (F.slice(pred, 1, F.greatest(n_real - 1, F.lit(0))),
            F.slice(target, 1, F.greatest(n_real, F.lit(0))))
