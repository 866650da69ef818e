"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every tessera job relies on.  AQE re-plans joins and coalesces small
# shuffle partitions at run time; skew-join splitting covers hot keys (frequent
# tokens, one giant source).  Timezone is pinned so timestamps agree with the
# DuckDB oracle.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Coalesced shuffle partitions may be small: rows after a shuffle often
    # carry expensive per-row work (tokenization, Arrow UDFs), and a few
    # megabytes of pairs are better spread over all slots than packed into one.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Session with the settings above.  Under `spark-submit` the submitter's
    configuration wins: only keys it leaves open are set.  Otherwise (tests,
    local runs) this is a local session with `master`, `shuffle_partitions`
    and 16 GB of driver memory (TESSERA_DRIVER_MEMORY), all of which `extra`
    can replace."""
    conf = dict(_BASE_CONF)
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit
        from pyspark import SparkConf, SparkContext
        SparkContext._ensure_initialized()
        given = dict(SparkConf().getAll())
    else:
        given = {}
        conf |= {"spark.master": master, "spark.sql.shuffle.partitions": str(shuffle_partitions),
                 "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "16g")}
    conf |= extra or {}
    builder = SparkSession.builder.appName(app_name)
    for k, v in conf.items():
        if k not in given:
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this points at shared storage and is respected as-is; if it is
    unset there, this fails, since a folder of one machine would not do.  Only
    a `local[...]` session (tests, local runs) gets a scratch folder."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make `tessera` importable in the Python workers.

    Arrow/pandas UDFs are pickled by module reference, so every executor's
    Python worker must import `tessera`.  The package is zipped once on the
    driver and distributed with `SparkContext.addPyFile` (the runtime form of
    `--py-files`), once per SparkContext."""
    import zipfile

    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # Spark Connect: no SparkContext on the client
        sc, key = None, id(spark)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="tessera-pkg-")
    zpath = os.path.join(staging, "tessera.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(zpath)
    else:
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(key)
