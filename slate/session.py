"""Spark session settings and the shared scratch location.

On a cluster the session is created by the platform; ``build_session`` is for
local runs (tests, bench).  ``scratch_path`` always prefers the cluster's
``spark.checkpoint.dir`` so that written intermediates survive executor loss
and are visible to every node.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every slate job expects (AQE on, UTC session clock, no UI).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of frames that are no longer referenced are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "slate",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library's settings.

    ``shuffle_partitions`` defaults to twice the local core count; on a cluster
    pass a value sized so one shuffle partition stays around 128-256 MB.
    """
    master = master or os.environ.get("SLATE_MASTER", "local[*]")
    if shuffle_partitions is None:
        shuffle_partitions = 2 * (os.cpu_count() or 4)
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("SLATE_DRIVER_MEMORY", "8g"))
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, creating a local one only if unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that value is
    always used as is.  Only a local session without it (tests, bench) gets a
    private folder; a cluster session without it is an error, since a
    driver-local folder is not visible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # executors on other machines cannot share a driver-local folder
            raise RuntimeError("spark.checkpoint.dir must name a shared folder when running on a cluster")
        # Only reached in a local session without a configured folder (tests, local bench).
        configured = tempfile.mkdtemp(prefix="slate-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/slate-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Used when a derived table feeds several branches of one plan, or must be
    finished (and its size known) before the plan that uses it is chosen.  The
    parquet files survive the loss of the executor that wrote them, later reads
    prune columns and push filters, and the planner knows their size.  Delete
    them with :func:`remove_stored` when the frame is no longer needed.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """The planner's size estimate: for a stored table, the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def remove_stored(df: DataFrame) -> int:
    """Delete the scratch folders that ``df`` reads (only this library's, under the
    checkpoint folder); returns how many.  The frame cannot be read afterwards."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    names = {m for f in df.inputFiles() if (m := re.search(r"/(slate-[A-Za-z0-9_-]+-[0-9a-f]{32})/", f))}
    paths = {f"{base}/{m[1]}" for m in names}
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(bool(hadoop_path(p).getFileSystem(conf).delete(hadoop_path(p), True)) for p in paths)
