"""Advanced page audit: headers, redirect chains, content quality, link and URL scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.arrays import count_where, lit
from pagelens.functions.text import THIN_WORDS, readability_band, reading_ease
from pagelens.functions.urls import url_structure_score
from pagelens.operators.extract import header
from pagelens.operators.rules import SKIP

# Fixed values: (header, display name, severity when missing, description, recommendation).
SECURITY_HEADERS = [
    ("Strict-Transport-Security", "HSTS", "CRITICAL", "HTTP Strict Transport Security forces browsers to use HTTPS.", "Add header: Strict-Transport-Security: max-age=31536000; includeSubDomains"),
    ("X-Content-Type-Options", "X-Content-Type-Options", "WARNING", "Prevents MIME type sniffing attacks.", "Add header: X-Content-Type-Options: nosniff"),
    ("X-Frame-Options", "X-Frame-Options", "WARNING", "Prevents clickjacking by controlling iframe embedding.", "Add header: X-Frame-Options: DENY or SAMEORIGIN"),
    ("X-XSS-Protection", "X-XSS-Protection", "INFO", "Enables browser XSS filtering.", "Add header: X-XSS-Protection: 1; mode=block"),
    ("Content-Security-Policy", "Content-Security-Policy", "WARNING", "Controls which resources the browser can load.", "Implement a Content-Security-Policy header."),
    ("Referrer-Policy", "Referrer-Policy", "INFO", "Controls referrer information sent with requests.", "Add header: Referrer-Policy: strict-origin-when-cross-origin"),
    ("Permissions-Policy", "Permissions-Policy", "INFO", "Controls which browser features can be used.", "Add a Permissions-Policy header to restrict camera, microphone, etc."),
]
GENERIC_INTERNAL_ANCHORS = [
    "click here", "here", "read more", "more", "learn more", "this link", "link", "go", "continue", "see more",
]
LONG_CHAIN = 3


def security_checks() -> str:
    """array<struct> with one entry per checked header."""
    rows = []
    for name, display, severity, text, advice in SECURITY_HEADERS:
        value = f"nullif({header('headers', name)}, '')"
        rows.append(
            f"named_struct('header', {lit(display)}, 'present', {value} is not null, 'value', {value}, "
            f"'severity', if({value} is null, {lit(severity)}, 'INFO'), 'description', {lit(text)}, "
            f"'recommendation', if({value} is null, {lit(advice)}, ''))"
        )
    return f"array({', '.join(rows)})"


MISSING_CHECK = "not x.present and x.severity in ('CRITICAL', 'WARNING')"


def security_headers(page: DataFrame) -> DataFrame:
    return page.selectExpr("site", "ord", "url", f"inline({security_checks()})")


def missing_security_headers(page: DataFrame) -> DataFrame:
    return page.selectExpr("site", "ord", "url", f"inline(filter({security_checks()}, x -> {MISSING_CHECK}))").drop("present", "value")


CHAIN = "concat(redirect_history, array(url))"


def redirect_chain(page: DataFrame) -> DataFrame:
    return page.where("size(redirect_history) > 0").selectExpr(
        "site", "ord", "redirect_history[0] as original_url", f"{CHAIN} as chain", "url as final_url",
        "size(redirect_history) as total_redirects", f"size(redirect_history) > {LONG_CHAIN} as is_too_long",
    )


QUALITY = [
    "text_metrics.word_count as word_count",
    "text_metrics.character_count as character_count",
    "text_metrics.sentence_count as sentence_count",
    "text_metrics.syllable_count as syllable_count",
    "if(text_metrics.word_count > 0, round(text_metrics.word_count / text_metrics.sentence_count, 1), 0.0D) as avg_words_per_sentence",
    f"text_metrics.word_count < {THIN_WORDS} as is_thin_content",
    f"size({SKIP}) = 0 as heading_hierarchy_valid",
    f"{count_where('links', 'x.is_internal')} as internal_link_count",
    f"{count_where('links', 'not x.is_internal')} as external_link_count",
    "size(images) as image_count",
    f"{count_where('images', 'not x.is_missing_alt')} as images_with_alt",
    f"{count_where('images', 'not x.is_lazy_loaded')} as images_without_lazy",
]

INTERNAL_LINK_SCORE_INPUT = [
    f"{count_where('links', 'x.is_internal')} as n_internal",
    f"{count_where('links', 'not x.is_internal')} as n_external",
    count_where("links", "x.is_internal and (btrim(x.text) = '' or lower(btrim(x.text)) in ("
                + ", ".join(lit(g) for g in GENERIC_INTERNAL_ANCHORS) + "))") + " as n_generic",
    "h1_count > 0 and not exists(filter(links, x -> x.is_internal), x -> exists(filter(headings, h -> h.level = 1), "
    "h -> contains(lower(x.text), lower(h.text)))) as h1_unlinked",
]
INTERNAL_LINK_SCORE = (
    "greatest(0, 100 - case when n_internal = 0 then 30 when n_internal < 3 then 10 else 0 end"
    " - if(n_external > 0 and n_external > 2 * n_internal, 10, 0) - least(15, 3 * n_generic) - if(h1_unlinked, 5, 0))"
)


def content_quality(page: DataFrame) -> DataFrame:
    measured = page.selectExpr("site", "ord", "url", *QUALITY)
    ease = reading_ease("word_count", "sentence_count", "syllable_count")
    return measured.selectExpr("*", f"{readability_band(ease)} as readability")


def mixed_content(page: DataFrame) -> DataFrame:
    return page.selectExpr("site", "ord", "url as page_url", "posexplode(mixed_content) as (n, m)").selectExpr(
        "site", "ord", "page_url", "n + 1 as n", "m.resource_url as resource_url", "m.resource_type as resource_type"
    )


def advanced_page(page: DataFrame) -> DataFrame:
    """One row per page combining the advanced checks, in one projection without a join."""
    measured = page.selectExpr(
        "site", "ord", "url", "is_https", "title", "meta_description", "headings", "h1_count", "json_ld", "open_graph",
        "twitter_cards", "canonical_url", "viewport", *QUALITY, *INTERNAL_LINK_SCORE_INPUT,
        f"{count_where(security_checks(), MISSING_CHECK)} as missing_headers",
        "size(mixed_content) as mixed_count",
        "size(redirect_history) as redirect_hops",
        f"cast({url_structure_score('url')} as int) as url_structure_score",
    )
    ease = reading_ease("word_count", "sentence_count", "syllable_count")
    return measured.selectExpr("*", f"{readability_band(ease)} as readability", f"cast({INTERNAL_LINK_SCORE} as int) as internal_link_score")


def advanced_site(advanced: DataFrame) -> DataFrame:
    """Per-site sums. The reference point for readability is the first page; the mode is added."""
    known = "readability <> 'N/A'"
    return advanced.groupBy("site").agg(
        F.expr("sum(cast(missing_headers as bigint))").alias("security_issues"),
        F.expr("sum(cast(mixed_count as bigint))").alias("mixed_content"),
        F.expr("count_if(is_thin_content)").alias("thin_pages"),
        F.expr("count_if(not heading_hierarchy_valid)").alias("heading_issues"),
        F.expr("sum(cast(images_without_lazy as bigint))").alias("images_no_lazy"),
        F.expr("cast(floor(sum(cast(word_count as bigint)) / count(1)) as bigint)").alias("avg_word_count"),
        F.expr(f"coalesce(min_by(readability, ord) filter (where {known}), 'N/A')").alias("first_readability"),
        F.expr("round(avg(url_structure_score), 4)").alias("avg_url_score"),
        F.expr("round(avg(internal_link_score), 4)").alias("avg_link_score"),
    )


def readability_mode(advanced: DataFrame) -> DataFrame:
    """Most frequent readability band per site; ties go to the band that sorts first."""
    counts = advanced.where("readability <> 'N/A'").groupBy("site", "readability").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("site").agg(F.expr("min_by(readability, struct(-n, readability))").alias("mode_readability"))


def advanced_site_extra(page: DataFrame) -> DataFrame:
    """Per-site totals that the site model declares: one aggregation over `page`."""
    return page.groupBy("site").agg(
        F.expr("sum(cast(size(filter(images, x -> coalesce(x.width, '') = '' or coalesce(x.height, '') = '')) as bigint))").alias("images_no_dimensions"),
        F.expr("sum(cast(size(filter(images, x -> x.format is not null and not x.is_next_gen_format)) as bigint))").alias("images_not_next_gen"),
        F.expr("sum(cast(size(filter(links, x -> x.is_nofollow)) as bigint))").alias("nofollow_links"),
        F.expr("sum(cast(size(filter(links, x -> x.is_nofollow and x.is_internal)) as bigint))").alias("internal_nofollow_links"),
        F.expr("count_if(not indexability.is_indexable)").alias("non_indexable_pages"),
        F.expr("count_if(is_soft_404)").alias("soft_404_pages"),
        F.expr("count_if(size(redirect_history) > 0)").alias("redirect_chains"),
        F.expr("count_if(has_redirect_loop)").alias("redirect_loops"),
        F.expr("round(avg(total_ms), 4)").alias("avg_response_ms"),
        F.expr("round(avg(ttfb_ms), 4)").alias("avg_ttfb_ms"),
        F.expr("round(avg(html_size_bytes), 4)").alias("avg_html_bytes"),
        F.expr("round(avg(crawl_depth), 4)").alias("avg_depth"),
        F.expr("count_if(crawl_depth > 3)").alias("deep_pages"),
    )
