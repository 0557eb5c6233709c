"""Streams with managed state: many micro-batches, restarts, late pages, combined tables."""

import json

import pytest
from pyspark.sql import functions as F

from pagelens.functions.urls import normalize_url
from pagelens.streaming import audit
from pagelens.streaming.state import PartialTable

COLUMNS = "site string, ord bigint, url string, fetched_at timestamp"


def source(spark, path, max_files=1):
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", max_files).parquet(path)


def arrive(spark, path, rows):
    """One file, one micro-batch; files are read in the order of their times."""
    spark.createDataFrame([(s, o, u, None) for s, o, u, _ in rows], COLUMNS).drop("fetched_at").withColumn("k", F.col("ord")).join(
        spark.createDataFrame([(o, float(t)) for _, o, _, t in rows], "k bigint, t double"), "k").select("site", "ord", "url", F.expr("timestamp_micros(cast(t * 1000000 as bigint)) as fetched_at")).coalesce(1).write.mode("append").parquet(path)


def test_visited_over_twenty_batches_and_a_restart(spark, tmp_path):
    path, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    batches = [[("s", 100 * b + k, f"https://e.org/{(7 * b + k) % 50}{'/#x' if b % 2 else ''}", 1000 * b) for k in range(20)] for b in range(20)]
    read, states = [], []
    for half in (batches[:11], batches[11:]):
        for b in half:
            arrive(spark, path, b)
        query = audit.stream_visited(source(spark, path), out, ckpt)
        query.awaitTermination()
        done = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
        done = [p for p in done if p["numInputRows"]]
        read += [p["numInputRows"] for p in done]
        states += [p["stateOperators"][0] for p in done]
    assert read == [20] * 20  # a batch reads its own rows, however many came before
    assert all("rocksdb" in " ".join(s["customMetrics"]).lower() for s in states)
    rows = audit.visited(spark, out)
    want = spark.read.parquet(path).selectExpr("site", f"{normalize_url('url')} as url_key").distinct()
    assert rows.count() == 50 and sorted(map(tuple, rows.select("site", "url_key").collect())) == sorted(map(tuple, want.collect()))
    assert states[-1]["numRowsTotal"] == 50


def test_visited_within_a_span(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b, t in enumerate((6000, 6060, 13200, 13300, 20000)):
        arrive(spark, path, [("s", b, "https://e.org/a", t), ("s", 10 + b, f"https://e.org/{b}", t)])
    audit.stream_visited(source(spark, path), out, str(tmp_path / "ck"), within="10 minutes").awaitTermination()
    times = [r.o for r in audit.visited(spark, out).where("url like '%/a'").selectExpr("cast(fetched_at as bigint) as o").collect()]
    assert 6000 in times and 6060 not in times and 13300 not in times and 20000 in times


def test_progress_with_late_and_unordered_pages(spark, tmp_path):
    path, table, ckpt = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "ck")
    batches = [[0, 30, 61], [59, 20, 119], [600, 601], [1300], [10, 65, 1301], [5]]  # seconds; 1300 moves the watermark to 700, which closes the first windows after the batch that follows
    rows = [[("s", 10 * b + k, f"https://e.org/{b}/{k}", t) for k, t in enumerate(times)] for b, times in enumerate(batches)]
    for part in (rows[:3], rows[3:]):
        for r in part:
            arrive(spark, path, r)
        for query in audit.stream_progress(source(spark, path), table, ckpt):
            query.awaitTermination()
        if part is rows[:3]:
            continue
    got = {int(r.w): (r.pages, r.late_pages) for r in audit.running_progress(spark, table).selectExpr("cast(window_start as bigint) as w", "pages", "late_pages").collect()}
    assert got == {0: (6, 1), 60: (3, 0), 600: (2, 0), 1260: (2, 0)}  # the last window is still open
    assert audit.running_progress(spark, str(tmp_path / "none")).count() == 0


def summed(spark, path):
    return PartialTable(spark, path, "k string, n bigint", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))


def test_partial_table_stays_small_and_counts_once(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    for b in range(50):
        rows = [(f"k{b % 5}", b), (f"k{b % 3}", 1)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        for _ in range(1 + (b in (7, 20, 49))):  # replayed, also right where folders are combined
            summed(spark, path).add(spark.createDataFrame(rows, "k string, n bigint"), b)
        assert len(summed(spark, path).folders()) < PartialTable.FAN * 3
    table = summed(spark, path)
    assert {r.k: r.n for r in table.rows().collect()} == want
    assert len(table.folders()) <= 8 and len(table._names("data")) < 40 and len(table._manifests()) <= PartialTable.KEPT + 1


def test_a_failed_batch_stays_unseen(spark, tmp_path, monkeypatch):
    table = summed(spark, str(tmp_path / "t"))
    table.add(spark.createDataFrame([("a", 1)], "k string, n bigint"), 0)
    monkeypatch.setattr(PartialTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.add(spark.createDataFrame([("a", 5)], "k string, n bigint"), 1)
    monkeypatch.undo()
    assert table.rows().first().n == 1
    table.add(spark.createDataFrame([("a", 5)], "k string, n bigint"), 1)
    assert table.rows().first().n == 6
