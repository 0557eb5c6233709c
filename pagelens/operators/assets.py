"""Link and image status: distinct targets joined to stored fetch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.rules import ISSUE_COLUMNS, finding
from pagelens.operators.skew import sized_join


def link_rows(page: DataFrame) -> DataFrame:
    """The edge list: one row per kept link of a page."""
    return page.selectExpr("site", "ord", "url as page_url", "inline(links)").withColumnRenamed("url", "link_url")


def image_rows(page: DataFrame) -> DataFrame:
    return page.selectExpr("site", "ord", "url as page_url", "inline(images)")


def heading_rows(page: DataFrame) -> DataFrame:
    return page.selectExpr("site", "ord", "url", "posexplode(headings) as (n, h)").selectExpr(
        "site", "ord", "url", "n + 1 as n", "h.level as level", "h.text as text"
    )


def references(page: DataFrame) -> DataFrame:
    """Every link and image of every page as (site, ord, page_url, kind, n, target, is_internal, snippet)."""
    merged = (
        "concat(transform(links, x -> named_struct('kind', 'link', 'n', x.n, 'target', x.url, 'is_internal', x.is_internal, "
        "'html_snippet', cast(null as string))), transform(images, x -> named_struct('kind', 'image', 'n', x.n, 'target', x.src, "
        "'is_internal', cast(null as boolean), 'html_snippet', x.html_snippet)))"
    )
    return page.selectExpr("site", "ord", "url as page_url", f"inline({merged})")


BROKEN = "coalesce(not status_code between 200 and 399, true)"


def asset_status(refs: DataFrame, url_status: DataFrame) -> DataFrame:
    """One row per distinct target: how often it is referenced, its status, whether it is broken."""
    targets = refs.groupBy("target").agg(F.count(F.lit(1)).alias("n_refs"))
    known = url_status.groupBy(F.col("url").alias("target")).agg(F.max("status_code").alias("status_code"))
    return targets.join(known, "target", "left").withColumn("is_broken", F.expr(BROKEN))


def checked_references(refs: DataFrame, url_status: DataFrame) -> DataFrame:
    """Every reference with the status of its target. Where statuses are many, a popular target is salted."""
    known = url_status.groupBy(F.col("url").alias("target")).agg(F.max("status_code").alias("status_code"))
    joined = sized_join(refs, known, ["target"], ["site", "ord", "n"], known)
    return joined.withColumn("is_broken", F.expr(BROKEN))


def broken_issues(checked: DataFrame) -> DataFrame:
    """Broken Link and Broken Image findings, in page order after the page rules."""
    status = "coalesce(cast(status_code as string), 'Timeout')"
    link = finding("Broken Link", "if(is_internal, 'internal', 'external')", "target", status,
                   severity="if(is_internal, 'CRITICAL', 'WARNING')", k="n")
    image = finding("Broken Image", "target", status, snippet="html_snippet", loc=("img", "n"), k="n")
    rows = checked.where("is_broken").selectExpr("site", "ord", "page_url as url", f"if(kind = 'link', {link}, {image}) as f")
    return rows.selectExpr("site", "ord", "f.seq as seq", "url", *[f"f.{c}" for c in ISSUE_COLUMNS[4:]])


def hreflang_targets(page: DataFrame, url_status: DataFrame) -> DataFrame:
    """Each hreflang edge with a return-link flag and a broken-target flag."""
    edges = page.selectExpr("site", "ord", "url as source_url", "posexplode(hreflang) as (n, h)").selectExpr(
        "site", "ord", "source_url", "n + 1 as n", "h.target_url as target_url", "h.language_code as language_code",
        "h.country_code as country_code", "h.is_x_default as is_x_default",
    )
    back = edges.selectExpr("target_url as source_url", "source_url as target_url").distinct().withColumn("_back", F.lit(True))
    known = url_status.groupBy(F.col("url").alias("target_url")).agg(F.max("status_code").alias("status_code"))
    paired = edges.join(back, ["source_url", "target_url"], "left")
    return sized_join(paired, known, ["target_url"], ["site", "ord", "n"], known).selectExpr(
        "site", "ord", "source_url", "n", "target_url", "language_code", "country_code", "is_x_default",
        "coalesce(_back, false) as has_return_link", "status_code", f"{BROKEN} as is_broken_target",
    )


def hreflang_issues(targets: DataFrame) -> DataFrame:
    f = finding("Hreflang Broken Target", "target_url", k="n")
    rows = targets.where("is_broken_target").selectExpr("site", "ord", "source_url as url", f"{f} as f")
    return rows.selectExpr("site", "ord", "f.seq as seq", "url", *[f"f.{c}" for c in ISSUE_COLUMNS[4:]])
