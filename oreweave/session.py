"""Spark session and cluster settings."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "oreweave", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings every job here relies on.

    Shuffle width is left to the cluster (AQE coalesces it); only a local master
    gets a small fixed width.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = master.partition("[")[2].rstrip("]")
            width = cores if cores.isdigit() else str(os.cpu_count() or 8)
            builder = (
                builder.config("spark.sql.shuffle.partitions", width)
                .config("spark.ui.enabled", "false")
                .config("spark.driver.memory", os.environ.get("OREWEAVE_DRIVER_MEMORY", "8g"))
            )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="oreweave-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, for tables one job hands to the next.

    All such folders of an application lie in one, which goes when the driver ends.
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/oreweave-{spark.sparkContext.applicationId}"
    if root not in _FOLDERS:
        _FOLDERS.add(root)
        atexit.register(_remove, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def _remove(jvm, configuration, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)


def stored(df):
    """A table computed once and read back, for a result several later steps use.

    It is written to the shared folder, so it survives executors, its columns are pruned and
    its size is known to the planner.
    """
    path = shared_workdir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
