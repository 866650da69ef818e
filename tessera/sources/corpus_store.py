"""The corpus as a Parquet table in `language=/length=/split=` folders, so that
scans by configuration or split read only the folders they name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

PARTITIONED_BY = ["language", "length", "split"]


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Write `corpus` to `path`.  Rows are rebalanced by folder: adaptive
    execution writes small folders together and splits a large one over as many
    tasks as its bytes ask for (`spark.sql.adaptive.advisoryPartitionSizeInBytes`
    each), so neither the number of files nor a task's share grows out of hand."""
    corpus.hint("rebalance", *PARTITIONED_BY).write.partitionBy(*PARTITIONED_BY).parquet(path)


def read_corpus(spark: SparkSession, path: str, columns: DataFrame) -> DataFrame:
    """Read a stored corpus with the schema of `columns` (folder names such as
    `12` stay strings)."""
    return spark.read.schema(columns.schema).parquet(path).select(*columns.columns)


_STORED: dict = {}


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus view of `sf_dir`, written once per application to the shared
    folder: length classes (a quantile over all texts) are worked out once and
    every later scan only reads."""
    from tessera.sources.views import corpus

    view = corpus(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
        write_corpus(view, path)
        _STORED[key] = path
    return read_corpus(spark, _STORED[key], view)
