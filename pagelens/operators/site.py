"""Site-level operators: duplicates, orphans, scores and the site report row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.arrays import fill, lit
from pagelens.operators.catalog import ISSUES, RULE_NUMBER, RULE_STRIDE
from pagelens.operators.rules import ISSUE_COLUMNS, page_penalty
from pagelens.operators.skew import salted_join, sized_join

DUPLICATE_KEYS = {
    "content": ("md5(btrim(concat(title, coalesce(meta_description, ''))))", "coalesce(title, '') <> ''"),
    "title": ("btrim(title)", "coalesce(title, '') <> ''"),
    "description": ("btrim(meta_description)", "coalesce(meta_description, '') <> ''"),
}


def duplicate_keys(page: DataFrame, kind: str) -> DataFrame:
    key, cond = DUPLICATE_KEYS[kind]
    return page.where(cond).selectExpr("site", "ord", "url", f"{key} as dup_key")


def duplicate_groups(page: DataFrame, kind: str) -> DataFrame:
    """Groups of two or more pages of a site sharing a key: size and first page."""
    return (
        duplicate_keys(page, kind)
        .groupBy("site", "dup_key")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.min("ord").alias("first_ord"), F.min_by("url", "ord").alias("first_url"))
        .where("n_pages > 1")
    )


def duplicate_members(page: DataFrame, kind: str) -> DataFrame:
    """Every page of every duplicate group; a large group is salted, never collected."""
    groups = duplicate_groups(page, kind).select("site", "dup_key", "n_pages", "first_ord")
    joined = salted_join(duplicate_keys(page, kind), groups, ["site", "dup_key"], ["ord"], "inner")
    return joined.selectExpr("site", "dup_key", "ord", "url", "n_pages", "ord = first_ord as is_first")


DUPLICATE_ISSUES = {
    "content": "Duplicate Page Content",
    "title": "Duplicate Page Title",
    "description": "Duplicate Meta Description",
}


def duplicate_issues(page: DataFrame, kind: str) -> DataFrame:
    """One finding per group on its first page: how many pages share the key, and the key.

    The pages themselves are rows of `duplicate_members`, which carries the same key.
    """
    issue = DUPLICATE_ISSUES[kind]
    level, text, advice = ISSUES[issue]
    slots = ("dup_key", "n_pages") if kind == "title" else ("n_pages", "dup_key")
    groups = duplicate_groups(page, kind)
    return groups.selectExpr(
        "site", "cast(-1 as bigint) as ord",
        f"cast({RULE_NUMBER[issue] * RULE_STRIDE} as bigint) + first_ord as seq",
        "first_url as url", f"{lit(level)} as severity", f"{lit(issue)} as issue_type",
        f"{fill(text, *slots)} as description", "cast(null as string) as html_snippet",
        "cast(null as string) as loc_tag", "cast(null as int) as loc_n", f"{lit(advice)} as recommendation",
    )


def orphan_pages(sitemap: DataFrame, page: DataFrame) -> DataFrame:
    """Sitemap URLs that were not crawled; a trailing slash does not count."""
    crawled = page.selectExpr("site", "rtrim('/', url) as clean").distinct()
    return (
        sitemap.selectExpr("site", "loc", "rtrim('/', loc) as clean").join(crawled, ["site", "clean"], "left_anti").select("site", "loc")
    )


def orphan_pages_inlink(sitemap: DataFrame, page: DataFrame) -> DataFrame:
    """Sitemap URLs that no internal link of the same site points to."""
    linked = (
        page.selectExpr("site", "explode(filter(links, x -> x.is_internal)) as l")
        .selectExpr("site", "rtrim('/', substring_index(l.url, '#', 1)) as clean")
        .distinct()
    )
    return (
        sitemap.selectExpr("site", "loc", "rtrim('/', loc) as clean").join(linked, ["site", "clean"], "left_anti").select("site", "loc")
    )


def orphan_issues(orphans: DataFrame, probe: DataFrame) -> DataFrame:
    issue = "Orphan Pages"
    level, text, advice = ISSUES[issue]
    counts = orphans.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(probe.select("site", "start_url"), "site").selectExpr(
        "site", "cast(-1 as bigint) as ord", f"cast({RULE_NUMBER[issue] * RULE_STRIDE} as bigint) as seq", "start_url as url",
        f"{lit(level)} as severity", f"{lit(issue)} as issue_type", f"{fill(text, 'n')} as description",
        "cast(null as string) as html_snippet", "cast(null as string) as loc_tag", "cast(null as int) as loc_n",
        f"{lit(advice)} as recommendation",
    )


def page_scores(page: DataFrame, probe: DataFrame, checked_refs: DataFrame | None = None) -> DataFrame:
    """Per-page score before (`base_score`) and after (`score`) broken links and images.

    The two robots and sitemap penalties are per site: broadcast when the sites are few, else
    salted. Broken counts are per page and join one to one.
    """
    scored = page.selectExpr("site", "ord", "url", f"{page_penalty()} as penalty")
    flags = probe.selectExpr("site", "if(robots_txt_found, 0, 5) + if(sitemap_xml_found, 0, 5) as site_penalty")
    joined = sized_join(scored, flags, ["site"], ["ord"], probe)
    base = joined.selectExpr(
        "site", "ord", "url", "cast(greatest(0, least(100, 100 - penalty - coalesce(site_penalty, 10))) as int) as base_score"
    )
    if checked_refs is None:
        return base.withColumn("n_broken", F.lit(0).cast("bigint")).withColumn("score", F.col("base_score"))
    broken = checked_refs.where("is_broken").groupBy("site", "ord").agg(F.count(F.lit(1)).alias("n_broken"))
    return base.join(broken, ["site", "ord"], "left").selectExpr(
        "site", "ord", "url", "base_score", "coalesce(n_broken, 0) as n_broken",
        "cast(greatest(0, base_score - 5 * coalesce(n_broken, 0)) as int) as score",
    )


REDIRECT_TYPE = "cast(try_element_at(redirect_status_codes, -1) as string)"


def redirect_pages(page: DataFrame) -> DataFrame:
    return page.where(f"size(redirect_history) > 0 and {REDIRECT_TYPE} is not null").selectExpr("site", "ord", "url", f"{REDIRECT_TYPE} as redirect_type")


def redirect_display() -> str:
    hops = (
        "transform(redirect_history, (u, i) -> concat('[', coalesce(cast(get(redirect_status_codes, i) as string), '?'), '] ', u))"
    )
    return f"if(size(redirect_history) = 0, '', concat_ws(' → ', {hops}, concat('[', status_code, '] ', url)))"


COMPRESSION = (
    "if(coalesce(compressed_size, 0) > 0 and html_size_bytes > 0, round((1 - compressed_size / html_size_bytes) * 100, 1), null)"
)


def page_report(page: DataFrame, scores: DataFrame) -> DataFrame:
    """The final row per page."""
    facts = page.selectExpr(
        "site", "ord", "url", "status_code", "is_https", "crawl_depth", "ttfb_ms", "total_ms", "html_size_bytes",
        "compressed_size", f"{COMPRESSION} as compression_ratio", "html_size_bytes > 1048576 as is_large_page",
        "indexability.noindex_source is not null as noindex_detected", "is_soft_404 as soft_404_detected",
        "size(redirect_history) > 0 as is_redirect", f"{REDIRECT_TYPE} as redirect_type",
    )
    return facts.join(scores.select("site", "ord", "score"), ["site", "ord"])


# What is counted per site as a share of its pages, and what is summed.
SHARES = {
    "https_pct": "is_https", "title_pct": "coalesce(title, '') <> ''", "description_pct": "coalesce(meta_description, '') <> ''", "h1_pct": "h1_count > 0",
    "canonical_pct": "coalesce(canonical_url, '') <> ''", "json_ld_pct": "size(json_ld) > 0", "og_pct": "size(open_graph) > 0", "twitter_pct": "size(twitter_cards) > 0",
    "lazy_pct": "exists(images, x -> coalesce(contains(x.loading, 'lazy'), false))",
}
COUNTS = {
    "pages_with_lang": "lang is not null", "pages_with_viewport": "viewport is not null", "pages_with_favicon": "favicon_url is not null",
    "redirect_chains": f"size(redirect_history) > 0 and {REDIRECT_TYPE} is not null",
}
HAS_ANSWERS_PAGE = "exists(json_ld, x -> coalesce(contains(x.schema_type, 'FAQPage') or contains(x.schema_type, 'HowTo'), false))"
HAS_ANSWERS = f"coalesce(max({HAS_ANSWERS_PAGE}), false)"


def fact_sums(page: DataFrame) -> DataFrame:
    """Per site the counts and sums from which its facts follow; sums of parts of a crawl add up."""
    return page.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.expr(f"count_if({cond})").alias(name) for name, cond in {**SHARES, **COUNTS}.items()],
        F.expr(HAS_ANSWERS).alias("has_answers"),
        F.expr("sum(coalesce(total_ms, 0.0D))").alias("ms_sum"),
        F.expr("sum(coalesce(html_size_bytes, 0L))").alias("bytes_sum"),
    )


def page_facts(page: DataFrame, probe: DataFrame) -> DataFrame:
    """One narrow row per page: what its site's facts, score and duplicate groups need of it."""
    facts = page.selectExpr(
        "site", "url", *[f"{cond} as {name}" for name, cond in {**SHARES, **COUNTS}.items()], f"{HAS_ANSWERS_PAGE} as has_answers",
        "coalesce(total_ms, 0.0D) as ms", "coalesce(html_size_bytes, 0L) as bytes", f"{page_penalty()} as penalty",
        *[f"if({cond}, {key}, null) as {kind}_key" for kind, (key, cond) in DUPLICATE_KEYS.items()],
    )
    flags = probe.selectExpr("site", "if(robots_txt_found, 0, 5) + if(sitemap_xml_found, 0, 5) as site_penalty")
    joined = sized_join(facts, flags, ["site"], ["url"], probe)
    return joined.withColumn("score", F.expr("cast(greatest(0, least(100, 100 - penalty - coalesce(site_penalty, 10))) as int)")).drop("penalty", "site_penalty")


def summed_facts(rows: DataFrame, *more: Column) -> DataFrame:
    """The sums of `fact_sums` over page_facts rows."""
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col(name)).alias(name) for name in (*SHARES, *COUNTS)],
        F.coalesce(F.max("has_answers"), F.lit(False)).alias("has_answers"), F.sum("ms").alias("ms_sum"), F.sum("bytes").alias("bytes_sum"), *more,
    )


def facts_of(sums: DataFrame) -> DataFrame:
    """Shares and means from sums."""
    return sums.selectExpr(
        "site", "pages", *[f"{name} / pages * 100 as {name}" for name in SHARES], "has_answers", "ms_sum / pages as avg_response_ms",
        "bytes_sum / pages as avg_html_bytes", *COUNTS,
    )


def site_facts(page: DataFrame) -> DataFrame:
    """One pass over `page`: every per-site count and mean the site scores and reports use."""
    return facts_of(fact_sums(page))


AI_SCORE = (
    "greatest(0, 100 - case when json_ld_pct < 50 then 20 when json_ld_pct < 80 then 10 else 0 end"
    " - case when og_pct < 50 then 15 when og_pct < 80 then 5 else 0 end - if(twitter_pct < 30, 10, 0) - if(has_answers, 0, 5))"
)
SPEED_SCORE = (
    "greatest(0, 100 - case when avg_response_ms > 3000 then 30 when avg_response_ms > 2000 then 20 when avg_response_ms > 1000 then 10 else 0 end"
    " - case when avg_html_bytes > 2000000 then 25 when avg_html_bytes > 1000000 then 15 when avg_html_bytes > 500000 then 5 else 0 end"
    " - if(lazy_pct < 30, 10, 0))"
)


def site_duplicate_counts(groups: DataFrame) -> DataFrame:
    """Duplicate group counts of all three kinds, from rows (site, kind) of groups with two or more pages."""
    return groups.groupBy("site").agg(*[F.expr(f"count_if(kind = '{k}')").alias(f"duplicate_{k}s") for k in DUPLICATE_KEYS])


def all_duplicate_groups(page: DataFrame) -> DataFrame:
    parts = [duplicate_groups(page, kind).selectExpr("site", f"'{kind}' as kind") for kind in DUPLICATE_KEYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def website_report(page: DataFrame, scores: DataFrame, orphans: DataFrame, probe: DataFrame) -> DataFrame:
    """One row per site: counts, shares and the four scores. Every join here is one row per site."""
    mean_score = scores.groupBy("site").agg(F.avg("score").alias("avg_page_score"))
    return site_scores(probe, site_facts(page), mean_score, site_duplicate_counts(all_duplicate_groups(page)), orphans)


def site_scores(probe: DataFrame, facts: DataFrame, mean_score: DataFrame, duplicates: DataFrame, orphans: DataFrame) -> DataFrame:
    """The report row of each site from its facts, however they were gathered."""
    n_orphans = orphans.groupBy("site").agg(F.count(F.lit(1)).alias("orphans"))
    joined = (
        probe.join(facts, "site", "left")
        .join(mean_score, "site", "left")
        .join(duplicates, "site", "left")
        .join(n_orphans, "site", "left")
        .na.fill(0, ["pages", "duplicate_contents", "duplicate_titles", "duplicate_descriptions", "orphans", "redirect_chains"])
    )
    penalty = (
        "(if(duplicate_contents > 0, 10, 0) + if(duplicate_titles > 0, 5, 0) + if(duplicate_descriptions > 0, 5, 0) + if(orphans > 0, 5, 0))"
    )
    scored = joined.selectExpr(
        "*",
        f"cast(greatest(0, least(100, cast(coalesce(avg_page_score, 100.0D) - {penalty} as int))) as int) as site_score",
        f"cast({AI_SCORE} as int) as ai_visibility_score",
        f"cast({SPEED_SCORE} as int) as site_speed_score",
    )
    health = (
        "site_score * 0.4D + ai_visibility_score * 0.2D + site_speed_score * 0.2D + if(robots_txt_found, 10, 0) + if(sitemap_xml_found, 10, 0)"
    )
    return scored.withColumn("site_health_score", F.expr(f"cast(greatest(0, least(100, cast({health} as int))) as int)"))


def issue_columns(*frames: DataFrame) -> DataFrame:
    out = frames[0].select(*ISSUE_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*ISSUE_COLUMNS))
    return out
