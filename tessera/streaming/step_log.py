"""E13 on an append-only feed: the step log rolled up per epoch while it grows.

Structured Streaming keeps, per (run, epoch, metric, day), the weighted sum, the
weight, the step count and the last step.  A watermark on the event time lets the
state of old days go.  Each micro-batch comes in `update` mode, that is with the
full new value of every group it touched, and is written to a folder of its own
number; a batch that is run again after a failure writes the same folder again.
The rollup reads the newest value of every group, so nothing is counted twice.

The checkpoint and the table lie in the shared folder under a name made from the
feed's path and the job's name: the same job started again, in another session
too, goes on where it stopped.  `availableNow` drains what is there and stops; a
production job passes another trigger.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

LATE = "31 days"  # how far an event may lag behind the newest one
KEYS = ["run", "epoch", "metric"]


def step_log_stream(spark: SparkSession, events_path: str, files_per_batch: int = 1) -> DataFrame:
    """The feed: a folder of Parquet files, or one file (its folder, filtered
    to that file name)."""
    batch = spark.read.parquet(events_path)
    folder, _, name = events_path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_batch)
    files = batch.inputFiles()
    if len(files) == 1 and files[0].rpartition("/")[2] == name:
        reader, events_path = reader.option("pathGlobFilter", name), folder
    ev = reader.parquet(events_path)
    return ev.select((F.col("user_id") % 4).alias("run"), F.dayofmonth("ts").alias("epoch"),
                     F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value",
                     (1 + F.col("event_id") % 8).alias("batch_size"), F.col("ts").cast("timestamp").alias("ts"))


def rollup_stream(log: DataFrame, late: str = LATE) -> DataFrame:
    """Sums per (run, epoch, metric, day)."""
    return log.withWatermark("ts", late).groupBy(*KEYS, F.window("ts", "1 day").alias("_w")).agg(
        F.sum(F.col("value") * F.col("batch_size")).alias("weighted"), F.sum("batch_size").alias("weight"),
        F.count("*").alias("n_steps"), F.max(F.struct("step", "value")).alias("last")).withColumn("day", F.col("_w.start")).drop("_w")


def job_paths(spark: SparkSession, events_path: str, job: str) -> tuple[str, str]:
    """(table, checkpoint) of a job on a feed; the same for every start of it."""
    ident = hashlib.sha256(f"{job}\n{events_path.rstrip('/')}".encode()).hexdigest()[:24]
    base = f"{ensure_checkpoint_dir(spark)}/epoch-rollup-{ident}"
    return f"{base}/table", f"{base}/checkpoint"


def advance(spark: SparkSession, events_path: str, job: str = "default", files_per_batch: int = 1,
            trigger: dict | None = None) -> str:
    """Take in what the feed holds beyond the last start; returns the table."""
    table, checkpoint = job_paths(spark, events_path, job)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    q = (rollup_stream(step_log_stream(spark, events_path, files_per_batch)).writeStream.outputMode("update")
         .foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
    return table


def read_rollup(spark: SparkSession, table: str) -> DataFrame:
    """The rollup of a table: the newest value of every group, days added up."""
    rows = spark.read.parquet(table)
    value = F.struct("weighted", "weight", "n_steps", "last")
    newest = rows.groupBy(*KEYS, "day").agg(F.max_by(value, "batch").alias("v"))
    return newest.groupBy(*KEYS).agg(
        (F.sum("v.weighted") / F.sum("v.weight")).alias("epoch_value"), F.sum("v.n_steps").alias("n_steps"),
        F.max("v.last").alias("last")).select(*KEYS, "epoch_value", "n_steps", F.col("last.value").alias("last_value"))


def run_epoch_rollup(spark: SparkSession, events_path: str, job: str = "default") -> DataFrame:
    """Drain the feed and return the rollup as a batch DataFrame."""
    return read_rollup(spark, advance(spark, events_path, job))
