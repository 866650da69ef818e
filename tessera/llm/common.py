"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, ship_package

_HELD: list = []  # of a worker process: key and value


def _give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def held(key: tuple, make):
    """What `make` gives, kept by a worker from task to task under `key` (compared
    by value).  A worker keeps one thing at a time: workers serve one operator
    after the other, and what the last one kept would stay in memory."""
    if not _HELD or _HELD[0] != key:
        _HELD.clear()  # before the next one is made
        _give_back()
        _HELD[:] = [key, make()]
    return _HELD[1]


#: White space of the word rule `[^\x20\x09-\x0D]+` (ASCII only).
SPACE = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of an Arrow batch: a worker holds the rows of one in several forms at
#: once (Arrow, Python objects, results), and the JVM its buffers.
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Shared folder and package for the Python workers, and Arrow batches of
    BATCH_BYTES, unless the session says otherwise."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(most, None) is None:
        spark.conf.set(most, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class scratch:
    """A scope for tables of `stored`: on leaving it they are deleted, but for
    those handed to `keep`, which belong to the scope around it, if any.  Nothing
    that reads a deleted table may be used afterwards."""

    _open: list = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self):
        scratch._open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._llm_path)
        return df

    def __exit__(self, kind, *_):
        scratch._open.remove(self)
        outer = scratch._open[-1].paths if scratch._open else []
        outer += [p for p in self.paths if p in self.kept]
        for p in self.paths:
            if p not in self.kept:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark deletes the shuffle files of a query that is done; otherwise they
#: stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder of `spark.checkpoint.dir` and
    read back: cuts the lineage and survives lost executors.  Inside a `scratch`
    the table is deleted with it.  The shuffle files of the writing go when it
    is done: nothing reads them again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    if scratch._open:
        scratch._open[-1].paths.append(path)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _with(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    ids = ids.distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` is among `ids` (one number column of that
    name, stored).  The ids are counted first and broadcast only up to
    BROADCAST_IDS of them."""
    return _with(df, ids, key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The other rows of `df`, those with a null `key` too."""
    return _with(df, ids, key, "left_anti")


#: Keys that stand for more than one in so many rows are joined by a broadcast.
HOT_SHARE = 1000


def split_join(left: DataFrame, right: DataFrame, keys: list, size: str, total: int) -> DataFrame:
    """Inner join with `right`, whose keys are unique and each stand for `size`
    of `total` rows.  Its hot rows, fewer than HOT_SHARE of them, are broadcast,
    so the rows of a hot key stay where they are."""
    hot = F.broadcast(right.where(F.col(size) * HOT_SHARE > total))
    others = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(size) * HOT_SHARE <= total), keys)
    return left.join(hot, keys).unionByName(others)
