"""Writers. Each one writes its partitions in parallel; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.sources.commit import publish, published

CSV_COLUMNS = {
    "url": "URL", "severity": "Severity", "issue_type": "Issue Type", "description": "Description",
    "html_snippet": "HTML Snippet", "css_selector": "CSS Selector", "xpath": "XPath", "recommendation": "Recommendation",
}


def issues_csv_table(located_issues: DataFrame, compact: bool = False) -> DataFrame:
    """The eight (or seven) export columns, site findings first; null becomes empty. Partitions are ranges of (site, ord, seq)."""
    cols = [(c, n) for c, n in CSV_COLUMNS.items() if not (compact and c == "html_snippet")]
    order = ["site", "ord", "seq"]
    ordered = located_issues.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in cols])


def write_issues_csv(located_issues: DataFrame, path: str, compact: bool = False) -> None:
    """Write the export as a run below `path`; it is visible as a whole or not at all (see `commit`)."""
    table = issues_csv_table(located_issues, compact)
    publish(table.sparkSession, path, lambda to: table.write.option("header", True).option("escape", '"').csv(to), lambda at: _csv(table.sparkSession, at))


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(folder)


def read_issues_csv(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The export's last finished run."""
    return _csv(spark, published(spark, path, verify))


FINDING = ["seq", "severity", "issue_type", "description", "html_snippet", "css_selector", "xpath", "recommendation"]
REFERENCE = ["n", "target", "is_internal", "status_code", "is_broken"]


def page_documents(page: DataFrame, located_issues: DataFrame, scores: DataFrame, checked: DataFrame) -> DataFrame:
    """One nested document per page: its fields, links and images with their status, findings and score.

    Findings and references are grouped per page, so a group is as large as one page's own.
    """
    found = located_issues.where("ord >= 0").groupBy("site", "ord").agg(F.sort_array(F.collect_list(F.struct(*FINDING))).alias("issues"))
    targets = checked.groupBy("site", "ord").agg(
        *[F.expr(f"sort_array(collect_list(struct({', '.join(REFERENCE)})) filter (where kind = '{k}'))").alias(f"checked_{k}s") for k in ("link", "image")]
    )
    docs = page.drop("headers").join(found, ["site", "ord"], "left").join(targets, ["site", "ord"], "left")
    return docs.join(scores.select("site", "ord", "score"), ["site", "ord"])


# Rows of one site in one file; a larger site is several files, and no site has one per task.
ROWS_PER_FILE = 50_000


def write_report_json(parts: dict[str, DataFrame], path: str) -> None:
    """Every part of the site report as JSON lines below `path`, one folder per part and site.

    Parts: `sites` (one row per site), `pages` (documents), and the member tables that a report holds as
    lists: site findings, duplicate groups and members, orphans, redirect chains, statuses, keywords, the
    advanced audit. A site's rows are never gathered into one value; they are clustered by site and by
    blocks of rows before writing, so the number of files follows the rows. All parts are one run: a reader sees
    the whole report or the one before (`report_folder`).
    """
    spark = parts["sites"].sparkSession
    publish(spark, path, lambda to: _write_parts(parts, to), lambda at: spark.read.option("recursiveFileLookup", True).text(at))


def report_folder(spark: SparkSession, path: str, verify: bool = False) -> str:
    """The folder of the last finished report."""
    return published(spark, path, verify)


def _write_parts(parts: dict[str, DataFrame], path: str) -> None:
    for name, df in parts.items():
        if name == "sites":
            df.write.mode("overwrite").json(f"{path}/{name}")
            continue
        blocks = df.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_blocks"))
        others = [c for c in ("ord", "url", "loc", "keyword", "dup_key", "seq", "status_code") if c in df.columns]
        placed = df.join(blocks, "site").withColumn("_block", F.pmod(F.xxhash64(F.lit(0), *others), F.col("_blocks")))
        clustered = placed.repartition("site", "_block").drop("_blocks", "_block")
        clustered.write.mode("overwrite").partitionBy("site").json(f"{path}/{name}")


def write_sitemap_xml(export: DataFrame, path: str) -> None:
    """Sitemap files per site through the XML writer."""
    (
        export.select("site", "loc", "lastmod", "changefreq", "priority").write.mode("overwrite").format("xml")
        .option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("rowTag", "url")
        .partitionBy("site").save(path)
    )


def write_site_texts(texts: DataFrame, path: str) -> None:
    """One text per site (llms.txt and its long form)."""
    texts.select("site", "content").write.mode("overwrite").partitionBy("site").option("lineSep", "\n").text(path)


def write_keyword_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
