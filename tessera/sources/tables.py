"""Scans of the driver tables (one parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Row keys of the text-heavy tables, used to spread a scan that yields fewer
# splits than the cluster has task slots.
_SPREAD_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    A Parquet file splits only at row-group boundaries.  A text table that
    comes back as fewer partitions than there are task slots would leave slots
    idle in all the per-row text work, so it is dealt out by its row key to as
    many partitions as there are slots.  The rule is about idle slots, not
    size: a table with at least one partition per slot is left as scanned."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    key = _SPREAD_KEYS.get(name)
    slots = spark.sparkContext.defaultParallelism
    if key is not None and df.rdd.getNumPartitions() < slots:
        df = df.repartition(slots, key)
    return df
