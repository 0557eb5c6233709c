"""Helpers of the training-data operators: the shared work folder, stored intermediates, text digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below `spark.checkpoint.dir`, which the driver and all executors share.

    Only a local session may run without that setting; it gets a temporary folder once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pagelens.llm.folder", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pagelens-llm-")
        spark.conf.set("pagelens.llm.folder", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, a lost executor costs nothing before."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = "1000"


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_ROWS rows: with whole texts in them, the session's default of 10,000 is tens of megabytes
    on both sides of every task. A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= int(BATCH_ROWS):
        spark.conf.set(key, BATCH_ROWS)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string; null is the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def remainder(column: Column, of: int) -> Column:
    """crc32 of the value as text, modulo `of`; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % of


def is_remainder(column: Column, of: int, value: int) -> Column:
    return F.coalesce(remainder(column, of) == value, F.lit(False))


def partitions(spark: SparkSession, total_bytes: int, each: int = 16 << 20) -> int:
    """How many partitions of about `each` bytes, and not fewer than the session deals out anyway."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // each))


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder that all machines reach; tasks write whole files there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def publish(files, temporary: str, final: str) -> None:
    """Give a finished temporary file its name; a repeated task replaces what an earlier attempt left."""
    from pyarrow import fs

    if not isinstance(files, fs.LocalFileSystem) and files.get_file_info(final).type != fs.FileType.NotFound:
        files.delete_file(final)
    files.move(temporary, final)


def give_back() -> None:
    """Return what the driver's Python has freed to the system; large arrays of a fit otherwise stay in its heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
