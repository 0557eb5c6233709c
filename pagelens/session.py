"""Session helpers for tests and the local benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session; a cluster session needs none of these settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.

    Stage tables, checkpoints and streaming output go there. Only a local session may run without the
    setting: driver and executors of a cluster do not share a temporary folder. Nothing is deleted; the
    folder's owner clears what a finished run has left below it.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagelens-ckpt-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it from there; its lineage ends here."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_in_place(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """`df` dealt out by its keys once and kept on the executors' disks, so that joins on these keys don't move it.

    It is made here: only a finished cache tells later plans how it lies. Lost blocks are made again from the plan of `df`,
    which should read a stored table. Call unpersist() when done.
    """
    kept = df.repartition(parts, *keys).persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept


# Estimated (stored) bytes of a task of a costly projection over rows of bodies.
TASK_BYTES = 2 << 20


def spread(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """`df` dealt out so that a task holds about `task_bytes`, and every core has one, whatever its files and row groups.

    A task's time then stays the same as the input grows. Rows move once, which costs little beside the projections
    over them; an input whose splits are as many already stays where it is.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if not df.isStreaming:
        parts = max(parts, -(-int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // task_bytes))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
