"""Sources and sinks outside the driver tables.

All writers are distributed: each task writes its own part file.  Nothing is
funnelled through one task or the driver (no `coalesce(1)`, no `toPandas`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the run-ledger layout (header row, 12 columns).
LEDGER_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("experiment_id", T.StringType()),
    T.StructField("project_name", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("emissions", T.DoubleType()),
    T.StructField("energy_consumed", T.DoubleType()),
    T.StructField("country_name", T.StringType()),
    T.StructField("country_iso_code", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("on_cloud", T.StringType()),
    T.StructField("cloud_provider", T.StringType()),
    T.StructField("cloud_region", T.StringType()),
])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The run ledger CSV with an explicit schema (no inference pass)."""
    return spark.read.schema(LEDGER_SCHEMA).option("header", True).csv(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A ledger as CSV in the layout above."""
    ledger.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER_SCHEMA.fields]).write.mode("overwrite") \
        .option("header", True).csv(path)


def ledger_rollup(ledger: DataFrame) -> DataFrame:
    """Runs, total duration, emissions and energy per project."""
    return ledger.groupBy("project_name").agg(
        F.count("*").alias("n_runs"), F.sum("duration").alias("duration"),
        F.sum("emissions").alias("emissions"), F.sum("energy_consumed").alias("energy_consumed"),
        F.min("timestamp").alias("first_run"), F.max("timestamp").alias("last_run"))


MERGES_SCHEMA = "rank int, left string, right string, n long"


def save_vocab(vocab: DataFrame, path: str, merges: DataFrame | None = None) -> None:
    """Store a vocabulary and its merges (none for a word vocabulary) as
    two Parquet tables."""
    if merges is None:
        merges = vocab.sparkSession.createDataFrame([], MERGES_SCHEMA)
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").parquet(f"{path}/merges")


def load_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """The vocabulary and its merges, None if it has none."""
    merges = spark.read.schema(MERGES_SCHEMA).parquet(f"{path}/merges")
    return spark.read.parquet(f"{path}/vocab"), None if merges.isEmpty() else merges


def write_results_csv(rows: DataFrame, path: str) -> None:
    """The result table as CSV with a header; array columns as JSON, quotes
    doubled as usual in CSV files."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def metrics_json(suite: DataFrame, group_col: str = "length") -> DataFrame:
    """One JSON object per group, `{"bleu_short": ..., ...}` (entries
    sorted by name, so the text is deterministic)."""
    return suite.groupBy(group_col).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("json"))


def write_metrics_json(suite: DataFrame, path: str, group_col: str = "length") -> None:
    """One JSON file per group (`partitionBy`)."""
    metrics_json(suite, group_col).write.mode("overwrite").partitionBy(group_col).text(path)


def append_samples(samples: DataFrame, path: str) -> None:
    """Append `(input, completion, step)` rows; readers see every epoch."""
    samples.select(F.col("input").cast("string"), F.col("completion").cast("string"),
                   F.col("step").cast("long")).write.mode("append").parquet(path)
