"""Structured Streaming versions of the incremental steps: audit, visited set, progress, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelens.functions.arrays import lit
from pagelens.functions.urls import normalize_url
from pagelens.operators.extract import page
from pagelens.operators import site
from pagelens.operators.rules import page_issues
from pagelens.schemas import CRAWL
from pagelens.session import spread
from pagelens.streaming.state import PartialTable, managed_state


def crawl_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(CRAWL).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def stream_page_audit(crawl: DataFrame) -> DataFrame:
    """Findings of each page as it arrives: the batch projection, unchanged and stateless."""
    return page_issues(page(crawl))


def stream_visited(crawl: DataFrame, table_path: str, checkpoint: str, within: str | None = None) -> StreamingQuery:
    """Each URL once for the whole crawl, however far apart its copies arrive.

    Keys are managed state, dealt out by (site, url_key): a micro-batch looks up its own keys and reads nothing that
    earlier ones stored. The state holds every key of the crawl, on the executors' disks. With `within` a key is
    forgotten that long (in event time) after it was seen, and a later copy counts as a new URL.
    """
    keyed = crawl.selectExpr("site", "ord", "url", f"{normalize_url('url')} as url_key", "fetched_at")
    fresh = keyed.withWatermark("fetched_at", within).dropDuplicatesWithinWatermark(["site", "url_key"]) if within else keyed.dropDuplicates(["site", "url_key"])
    with managed_state(crawl.sparkSession):
        return append_to(fresh, table_path, checkpoint)


VISITED = "site string, ord bigint, url string, url_key string, fetched_at timestamp"


def visited(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.schema(VISITED).parquet(table_path)


WINDOW = "window_start timestamp, window_end timestamp"


def _progress_tables(spark: SparkSession, table_path: str) -> tuple[PartialTable, PartialTable]:
    """Pages on time, where the latest count of a window holds, and all pages that arrived, as partial counts."""
    latest = PartialTable(spark, f"{table_path}/on_time", f"{WINDOW}, pages bigint, batch bigint", lambda df: df.groupBy("window_start", "window_end").agg(F.max_by("pages", "batch").alias("pages"), F.max("batch").alias("batch")))
    arrived = PartialTable(spark, f"{table_path}/arrived", f"{WINDOW}, pages bigint", lambda df: df.groupBy("window_start", "window_end").agg(F.sum("pages").alias("pages")))
    return latest, arrived


def stream_progress(crawl: DataFrame, table_path: str, checkpoint: str, window: str = "1 minute", delay: str = "10 minutes") -> list[StreamingQuery]:
    """Pages done per event-time window, in update mode behind a watermark.

    A window closes with the batch behind the one in which the latest fetched_at passed its end by `delay`; its running count is stored
    with every batch that changes it, so open windows are seen at any time and need no flush. A page that arrives after its window
    has closed is late: the state no longer has the window, and the second query, which counts arrivals without
    state, tells how many there were.
    """
    spark = crawl.sparkSession
    on_time, arrived = _progress_tables(spark, table_path)

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy(F.window("fetched_at", window)).agg(F.count(F.lit(1)).alias("pages")).selectExpr("window.start as window_start", "window.end as window_end", "pages")

    def store_counts(batch: DataFrame, batch_id: int) -> None:
        on_time.add(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)

    def store_arrivals(batch: DataFrame, batch_id: int) -> None:
        arrived.add(counted(batch), batch_id)

    times = crawl.select("fetched_at")
    with managed_state(spark):
        first = counted(times.withWatermark("fetched_at", delay)).writeStream.outputMode("update").foreachBatch(store_counts).option("checkpointLocation", f"{checkpoint}/on_time").trigger(availableNow=True).start()
    return [first, times.writeStream.foreachBatch(store_arrivals).option("checkpointLocation", f"{checkpoint}/arrived").trigger(availableNow=True).start()]


def running_progress(spark: SparkSession, table_path: str) -> DataFrame:
    """Every window so far, the open ones too: pages (late ones included), late pages, and pages per second."""
    on_time, arrived = _progress_tables(spark, table_path)
    counted = on_time.rows().select("window_start", F.col("pages").alias("in_time"))
    rows = arrived.rows().join(counted, "window_start", "left").withColumn("late_pages", F.col("pages") - F.coalesce("in_time", F.lit(0)))
    return rows.selectExpr("window_start", "window_end", "pages", "late_pages", "pages / (cast(window_end as bigint) - cast(window_start as bigint)) as pages_per_sec")


def append_to(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start an append query into a parquet table; file sinks are exactly-once."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


COUNTED = ["pages", *site.SHARES, *site.COUNTS, "bytes_sum", "score_sum"]


def _score_tables(spark: SparkSession, table_path: str) -> dict[str, PartialTable]:
    """Sums per site, page counts per duplicate key, and the crawled addresses."""
    facts = "site string, " + ", ".join(f"{c} bigint" for c in COUNTED) + ", ms_sum double, has_answers boolean"
    return {
        "facts": PartialTable(spark, f"{table_path}/facts", facts, lambda df: df.groupBy("site").agg(*[F.sum(c).alias(c) for c in (*COUNTED, "ms_sum")], F.max("has_answers").alias("has_answers"))),
        "keys": PartialTable(spark, f"{table_path}/keys", "site string, dup_key string, kind string, n bigint", lambda df: df.groupBy("site", "dup_key", "kind").agg(F.sum("n").alias("n"))),
        "urls": PartialTable(spark, f"{table_path}/urls", "site string, url string", lambda df: df.distinct()),
    }


def stream_site_scores(crawl: DataFrame, probe: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """What the running site scores need, added to three tables of partial aggregates with every micro-batch.

    The batch's pages are read once, into one narrow row each (facts, score, duplicate keys); the tables are made
    from those rows. Tables combine earlier batches as they get many, so neither a batch nor a reader opens a folder per batch.
    """
    tables = _score_tables(crawl.sparkSession, table_path)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = site.page_facts(page(spread(batch)), probe).persist()
        keys = rows.selectExpr("site", f"stack({len(site.DUPLICATE_KEYS)}, {', '.join(f'{lit(k)}, {k}_key' for k in site.DUPLICATE_KEYS)}) as (kind, dup_key)").where("dup_key is not null")
        parts = {"facts": site.summed_facts(rows, F.sum(F.col("score").cast("bigint")).alias("score_sum")), "keys": keys.groupBy("site", "kind", "dup_key").agg(F.count(F.lit(1)).alias("n")), "urls": rows.select("site", "url").distinct()}
        for name, df in parts.items():
            tables[name].add(df, batch_id)
        rows.unpersist()

    return crawl.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_site_scores(spark: SparkSession, table_path: str, probe: DataFrame, sitemap: DataFrame) -> DataFrame:
    """The four scores of every site over all stored batches; broken targets are checked after the crawl."""
    tables = {name: t.rows() for name, t in _score_tables(spark, table_path).items()}
    sums = tables["facts"]
    mean = sums.selectExpr("site", "score_sum / pages as avg_page_score")
    return site.site_scores(probe, site.facts_of(sums), mean, site.site_duplicate_counts(tables["keys"].where("n > 1")), site.orphan_pages(sitemap, tables["urls"]))
