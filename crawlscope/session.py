"""Spark session defaults and the shared checkpoint folder.

The library never builds its own cluster configuration: it reads what the
session already has and only fills gaps for local runs (tests, bench).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on. AQE re-plans joins and splits
# skewed partitions at run time (the home page of a site is a hot link target).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "crawlscope") -> SparkSession:
    """A local session for tests and the bench (no UI, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CRAWLSCOPE_DRIVER_MEMORY", "8g"))
    )
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """A reliable checkpoint of df, hash-partitioned by keys, that keeps this
    partitioning for later joins on the keys. Adaptive execution is off for the
    write alone: it would replace the partitioning by one that joins can't use."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(n, *keys).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def written_round(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder, for loops that join a table
    with itself: a checkpoint keeps the planner's size of its plan, which such
    a join squares, so that number's digits double each round; a file has the
    size it has."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, where they can't import
    it from their own path: as a zip, once for each Spark context. A cluster
    that has the package installed (pyproject.toml) doesn't need it, but isn't harmed."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in known or getattr(sc, "_crawlscope_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="crawlscope-zip-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "crawlscope"), "zip", root, "crawlscope"))
    sc._crawlscope_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster the folder must be shared storage named in
    ``spark.checkpoint.dir``; it is read from the session and never replaced.
    Only a local-mode session without one (tests, bench) gets a fresh
    scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.split("[")[0] != "local":
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative jobs need a shared checkpoint folder on a cluster"
        )
    folder = tempfile.mkdtemp(prefix="crawlscope-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
