"""Spark session settings used by the library, the tests and the bench.

Settings are the ones a Spark user sets for a shuffle-heavy batch job:
AQE on (partition coalescing, skew-join splitting, runtime broadcast
conversion that is bounded by a measured size), UTC session time zone,
Arrow for pandas UDFs and the UI off.  ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session and only falls back to a scratch
folder in local mode when it is unset (tests, bench); on a cluster an unset
folder is an error, as executors cannot share a machine-local one.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Broadcast ceiling given to Spark's own static and adaptive thresholds.
BROADCAST_BYTES = 32 * 1024 * 1024

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "valueflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("VALUEFLOW_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points to shared storage and is
    used as is.  Only in local mode a fresh scratch folder is created and
    registered when it is unset.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder (master {master})")
        current = tempfile.mkdtemp(prefix="valueflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


# Input bytes of one task: of files, and of a shuffle (compressed; up to some 30 times that in a hash table or a sort).
SCAN_BYTES = 32 * 1024 * 1024
SHUFFLE_BYTES = 8 * 1024 * 1024


def size_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Size tasks for tables of ``input_bytes``: smaller shares of files and shuffles, and shuffle partitions that grow with the
    tables, so that no task holds more as they grow.  Settings that the session names are left as they are."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // (SHUFFLE_BYTES // 2)))
    for key, value in (("spark.sql.files.maxPartitionBytes", SCAN_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_BYTES),
                       ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", parts)):
        ours, now = f"spark.valueflow.set.{key}", spark.conf.get(key, None)
        if now is None or now == spark.conf.get(ours, None):  # unset, or set here for other tables
            spark.conf.set(key, str(value))
            spark.conf.set(ours, str(value))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts the lineage)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (Spark distributes the file)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="valueflow-pkg-"), "valueflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
