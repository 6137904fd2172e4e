"""Session set-up, and the shared folder used to cut lineage and to stage files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Rows laid out by some of a join's keys (tile and bucket) stay where they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "gridgale") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    parts = "8" if cores == "*" else str(max(int(cores), 2))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Wide feature plans compile more classes than the default cache keeps.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan here relies on (UTC above all)."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gridgale-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for files that one job writes and reads back."""
    return f"{shared_dir(spark)}/staging/{name}-{uuid.uuid4().hex[:12]}"


def clear_staging(spark: SparkSession) -> None:
    """Remove what this session has staged. To be called when no DataFrame over it is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staging")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder so later jobs read the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
