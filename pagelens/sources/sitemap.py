"""Sitemaps: stored XML documents to (site, loc, lastmod) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.arrays import lit, nonempty, strip
from pagelens.functions.urls import netloc

LOC_PATTERN = r"(?i)<loc>\s*(https?://[^\s<]+)\s*</loc>"
_URLSET = "url array<struct<loc:string,lastmod:string>>"
_INDEX = "sitemap array<struct<loc:string>>"


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """URL entries straight from sitemap files; a file of any size is split by row tag."""
    return (
        spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
        .selectExpr(f"{netloc('loc')} as site", f"{strip('loc')} as loc", f"{nonempty(strip('lastmod'))} as lastmod")
    )


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """URL entries of stored sitemap documents (url, body)."""
    parsed = documents.selectExpr("url as sitemap_url", f"inline(from_xml(body, '{_URLSET}').url)")
    return parsed.where("btrim(loc) <> ''").selectExpr(
        f"{netloc('sitemap_url')} as site", "sitemap_url", f"{strip('loc')} as loc", f"{nonempty(strip('lastmod'))} as lastmod"
    )


def expand_index(documents: DataFrame) -> DataFrame:
    """Entries of all sitemaps, marked where an index names the sitemap (one level).

    Each body is parsed once, in its own row; only the narrow entries meet the names of the indexes.
    """
    named = documents.selectExpr(f"inline(from_xml(body, '{_INDEX}').sitemap)").selectExpr(f"{strip('loc')} as sitemap_url", "true as from_index").distinct()
    entries = sitemap_entries(documents.where("not body rlike '<sitemapindex'"))
    return entries.join(named, "sitemap_url", "left").select("site", "sitemap_url", "loc", "lastmod", F.coalesce("from_index", F.lit(False)).alias("from_index"))


def sitemap_locs(documents: DataFrame) -> DataFrame:
    """Every http(s) loc by pattern, whatever the document around it."""
    return documents.selectExpr("url as sitemap_url", f"explode(regexp_extract_all(body, {lit(LOC_PATTERN)}, 1)) as loc")
