"""Crawl snapshots: stored fetch results as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pagelens.functions.arrays import lit, present
from pagelens.operators.extract import header
from pagelens.schemas import CRAWL, SITE_PROBE, STORED_DOCUMENT, URL_STATUS
from pagelens.sources.warc import read_crawl_warc

MAX_BYTES = 10 * 1024 * 1024

# Fixed values.
NON_HTML = "Non-HTML content: "
TOO_LONG = "Content length exceeds maximum limit."
TOO_BIG = "Download size exceeded limit."


def read_crawl(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """A stored crawl; `fmt="warc"` reads indexed archives (`sources/warc.py`), where leaving out `html` in `columns` leaves bodies packed."""
    shape = StructType.fromDDL(CRAWL)
    if columns is not None:
        shape = StructType([shape[c] for c in columns])
    if fmt == "warc":
        return read_crawl_warc(spark, path, shape)
    return spark.read.schema(shape).format(fmt).load(path)


def read_site_probe(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SITE_PROBE).format(fmt).load(path)


def read_url_status(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(URL_STATUS).format(fmt).load(path)


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored non-page documents (robots.txt, sitemaps) as (url, body)."""
    return spark.read.schema(STORED_DOCUMENT).format(fmt).load(path)


IS_SUCCESS = "(coalesce(error_message, '') = '' and coalesce(status_code between 200 and 299, false))"


def successful(crawl: DataFrame) -> DataFrame:
    """Fetches that completed with a 2xx status; both tests push down to the scan."""
    return crawl.where(IS_SUCCESS)


def fetch_guard(crawl: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Mark rows that are not HTML or are larger than the limit; their body is dropped."""
    kind = f"coalesce({header('headers', 'Content-Type')}, '')"
    declared = f"try_cast(regexp_extract({header('headers', 'Content-Length')}, '^[ ]*([+-]?[0-9]+)[ ]*$', 1) as bigint)"
    guard = (
        f"case when {present('error_message')} then error_message "
        f"when not contains(lower({kind}), 'text/html') and not contains(lower({kind}), 'application/xhtml') then concat({lit(NON_HTML)}, {kind}) "
        f"when {declared} > {max_bytes} then {lit(TOO_LONG)} "
        f"when octet_length(html) > {max_bytes} then {lit(TOO_BIG)} end"
    )
    guarded = crawl.withColumnsRenamed({"error_message": "_e"}).selectExpr("*", guard.replace("error_message", "_e") + " as error_message")
    kept = [c for c in crawl.columns if c not in ("html", "html_size_bytes", "error_message")]
    return guarded.selectExpr(
        *kept, "error_message", "if(error_message is null, html, '') as html",
        "if(error_message is null, html_size_bytes, 0L) as html_size_bytes",
    ).select(*crawl.columns)
