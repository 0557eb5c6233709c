"""Settings for managed state, and a table of partial aggregates that micro-batches add to."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: State lives in RocksDB on the executors' disks; a commit uploads the changes of its batch, not the whole state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def managed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class PartialTable:
    """Partial rows of micro-batches, combined again as they get many.

    A batch writes one folder. When FAN folders of a level have come together they are combined to one of the next level, so after
    n batches a reader opens fewer than FAN * (1 + log n) folders, and a row is rewritten log n times. A manifest per batch
    names the folders that count; a folder that none names does not exist for readers. A replayed batch starts from
    the manifest before it and writes its own folder again, so it counts once. Folders that only older manifests
    name are removed two batches later.
    """

    FAN, KEPT = 8, 3

    def __init__(self, spark: SparkSession, path: str, schema: str, combine):
        """`combine` maps the rows of several folders to fewer rows of the same columns."""
        self.spark, self.path, self.schema, self.combine = spark, path.rstrip("/"), schema, combine

    def _files(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(folder)
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifest") if n.isdigit())

    def _load(self, batch_id: int) -> list[list]:
        files, path = self._files("manifest", str(batch_id))
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, batch_id: int, folders: list[list]) -> None:
        files, draft = self._files("manifest", f"_{batch_id}")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        _, final = self._files("manifest", str(batch_id))
        files.delete(final, False)
        if not files.rename(draft, final):
            raise OSError(f"manifest {final} was not written")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        earlier = [m for m in self._manifests() if m < batch_id]
        folders = self._load(earlier[-1]) if earlier else []
        kept = {name for m in earlier[-self.KEPT :] for _, name in self._load(m)}
        for name in set(self._names("data")) - kept:
            files, path = self._files("data", name)
            files.delete(path, True)
        for old in earlier[: -self.KEPT]:
            files, path = self._files("manifest", str(old))
            files.delete(path, False)
        columns = self.spark.createDataFrame([], self.schema).columns
        self._write(batch.select(columns), f"{batch_id}-0")
        folders, level = [*folders, [0, f"{batch_id}-0"]], 0
        while len(full := [name for at, name in folders if at == level]) >= self.FAN:
            level += 1
            self._write(self.combine(self._read(full)), f"{batch_id}-{level}")
            folders = [f for f in folders if f[0] != level - 1] + [[level, f"{batch_id}-{level}"]]
        self._commit(batch_id, folders)

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/data/{name}")

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def folders(self) -> list[str]:
        """The folders that a reader opens now."""
        known = self._manifests()
        return [name for _, name in self._load(known[-1])] if known else []

    def rows(self) -> DataFrame:
        """All rows, combined."""
        names = self.folders()
        return self.combine(self._read(names)) if names else self.spark.createDataFrame([], self.schema)
