"""Two-phase commit of written folders: data under a name of its own, then a manifest, then one pointer.

A run writes `data-<run>`, reads it back into the table `manifest-<run>` (file, bytes, sha256, rows), and only then
renames the pointer file `CURRENT` into place, which names the run. Readers go through the pointer, so they see the last
finished run, whole, or the one before; what a killed run has left is never opened. Checksums and counts are made by the
executors, and nothing but the run's name passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _point(spark: SparkSession, folder: str, run: str) -> None:
    files, draft = _path(spark, f"{folder}/_CURRENT-{run}")
    stream = files.create(draft, True)
    stream.write(bytearray(run.encode()))
    stream.close()
    _, final = _path(spark, f"{folder}/CURRENT")
    files.delete(final, False)
    if not files.rename(draft, final):
        raise OSError(f"{folder}/CURRENT was not written")


def _file(run: str):
    return F.regexp_extract("_metadata.file_path", f"data-{run}/(.*)$", 1).alias("file")


def _checksums(spark: SparkSession, folder: str, run: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/data-{run}")
    return files.select(_file(run), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish(spark: SparkSession, folder: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> str:
    """Write a run with `write(data folder)`, record its files with the rows that `read(data folder)` finds, make it current."""
    folder, run = folder.rstrip("/"), uuid.uuid4().hex
    write(f"{folder}/data-{run}")
    rows = read(f"{folder}/data-{run}").select(_file(run)).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    _checksums(spark, folder, run).join(rows, "file", "left").fillna(0, ["rows"]).write.json(f"{folder}/manifest-{run}")
    _point(spark, folder, run)
    return f"{folder}/data-{run}"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256, rows) of the current run."""
    return spark.read.schema("file string, bytes bigint, sha256 string, rows bigint").json(f"{folder.rstrip('/')}/manifest-{current(spark, folder)}")


def current(spark: SparkSession, folder: str) -> str:
    files, path = _path(spark, f"{folder.rstrip('/')}/CURRENT")
    if not files.exists(path):
        raise FileNotFoundError(f"no finished run in {folder}")
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def published(spark: SparkSession, folder: str, verify: bool = False) -> str:
    """The data folder of the current run; with `verify` its files must be those of the manifest, byte for byte."""
    run = current(spark, folder)
    if verify:
        found = _checksums(spark, folder.rstrip("/"), run).withColumn("there", F.lit(True))
        odd = manifest(spark, folder).join(found, ["file", "bytes", "sha256"], "full").where("there is null or rows is null")
        if bad := odd.select("file").first():
            raise ValueError(f"{bad[0]} is not as the manifest of {folder} says")
    return f"{folder.rstrip('/')}/data-{run}"
