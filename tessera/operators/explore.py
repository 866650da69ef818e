"""Corpus exploration: token frequencies and Jensen-Shannon distances.

Frequency tables are long `(group..., token_id, n)`.  Vectors are aligned by
token id (a join), never by position.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tessera.functions.joins import broadcast_bounded, broadcast_if_small

TOP_K = 10


def token_freq(token_ids: DataFrame, vocab: DataFrame, group_cols: Sequence[str],
               token_col: str = "token_id", count_col: str | None = None) -> DataFrame:
    """Counts over the whole vocabulary with an add-one start (every id
    starts at 1, then the observed ids are added), for every group in one pass.

    Observed counts come from one partial+final aggregate; the vocabulary
    (bounded by its size) is crossed with the distinct groups (few), then
    left-joined to the counts."""
    g = list(group_cols)
    # `count_col` given: rows are already (partially) counted occurrences.
    cnt = F.sum(count_col) if count_col else F.count("*")
    counts = token_ids.groupBy(*g, token_col).agg(cnt.alias("_c"))
    groups = token_ids.select(*g).distinct()
    grid = groups.crossJoin(broadcast_bounded(vocab.select(F.col("token_id").alias(token_col)), vocab))
    return grid.join(counts, [*g, token_col], "left").select(
        *g, token_col, (F.coalesce(F.col("_c"), F.lit(0)) + 1).cast("long").alias("n"))


def token_topk(freq: DataFrame, vocab: DataFrame, group_cols: Sequence[str], k: int = TOP_K,
               token_col: str = "token_id") -> DataFrame:
    """X2 + T13: the k most common tokens per group (count desc, then id), as
    strings.  `row_number() <= k` runs as a window group limit."""
    w = Window.partitionBy(*group_cols).orderBy(F.col("n").desc(), F.col(token_col))
    top = freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(broadcast_bounded(vocab.select(F.col("token_id").alias(token_col), "token"), vocab),
                    token_col) \
              .select(*group_cols, F.col("rank").cast("int").alias("rank"), token_col, "token", "n")


def _js_from_joined(j: DataFrame, by: Sequence[str], base: float | None) -> DataFrame:
    """sqrt((sum p ln(p/m) + sum q ln(q/m)) / 2 / ln(base)); zero terms skipped."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)
    div = 2.0 * (math.log(base) if base else 1.0)
    return j.groupBy(*by).agg(F.sqrt(F.greatest(F.sum(term) / div, F.lit(0.0))).alias("js"))


def _normalise(freq: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Probabilities per group: a window partitioned by the group, whose size
    is bounded by the vocabulary (the frequency table has one row per group
    and vocabulary entry) -- one exchange, no join, never an unpartitioned
    window."""
    return freq.withColumn("pr", F.col("n") / F.sum("n").over(Window.partitionBy(*group_cols)))


def js_distance(freq_a: DataFrame, freq_b: DataFrame, token_col: str = "token_id",
                base: float | None = None) -> DataFrame:
    """Distance between two count vectors (full outer join on the token,
    a missing count is 0)."""
    a = freq_a.groupBy(token_col).agg(F.sum("n").alias("n"))
    b = freq_b.groupBy(token_col).agg(F.sum("n").alias("n"))
    ta, tb = a.agg(F.sum("n").alias("ta")), b.agg(F.sum("n").alias("tb"))
    j = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), token_col, "full") \
         .crossJoin(broadcast_if_small(ta)).crossJoin(broadcast_if_small(tb))
    j = j.select((F.coalesce(F.col("na"), F.lit(0)) / F.col("ta")).alias("p"),
                 (F.coalesce(F.col("nb"), F.lit(0)) / F.col("tb")).alias("q"))
    return _js_from_joined(j, [], base)


def js_pairs(freq: DataFrame, part_col: str, size_col: str, token_col: str = "token_id",
             within: bool = True, left_part: str = "train", right_part: str = "test",
             base: float | None = None) -> DataFrame:
    """X4 (within=True): every pair of size classes a < b inside each part,
    a self equi-join on (part, token) with the theta filter a < b.
    X5 (within=False): left-part size x right-part size, all combinations,
    an equi-join on the token.  The frequency tables cover the whole
    vocabulary per group (add-one), so the inner join loses no token."""
    pr = _normalise(freq, [part_col, size_col]).select(part_col, size_col, token_col, "pr")
    a = pr.select(F.col(part_col).alias("part_a"), F.col(size_col).alias("size_a"), token_col,
                  F.col("pr").alias("p"))
    b = pr.select(F.col(part_col).alias("part_b"), F.col(size_col).alias("size_b"), token_col,
                  F.col("pr").alias("q"))
    if within:
        j = a.join(b, (a[token_col] == b[token_col]) & (F.col("part_a") == F.col("part_b"))
                   & (F.col("size_a") < F.col("size_b")))
        out = _js_from_joined(j, ["part_a", "size_a", "size_b"], base)
        return out.withColumnRenamed("part_a", part_col)
    a = a.filter(F.col("part_a") == left_part)
    b = b.filter(F.col("part_b") == right_part)
    j = a.join(b, token_col)
    return _js_from_joined(j, ["part_a", "size_a", "part_b", "size_b"], base)
