"""Every operator as a named query over a test-data folder."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelens.functions import urls as U
from pagelens.functions.arrays import lit
from pagelens.functions.text import content_metrics, ngrams, readability_band, reading_ease
from pagelens.operators import (
    advanced, assets, dom, frontier, guides, keywords, reporting, rules, site, structured, visibility,
)
from pagelens.operators.catalog import ISSUES
from pagelens.plans import derived
from pagelens.plans.snapshot import Snapshot, derived_snapshot, scratch
from pagelens.sources import crawl as crawl_source
from pagelens.session import spread
from pagelens.sources import robots, sinks, sitemap, warc
from pagelens.streaming import audit as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYWORD_NEEDLE = "the"
RUN_DATE = "2024-06-01"
AGENT = "PageLens/1.0"
MAX_DEPTH = 3
MAX_PAGES = 5


def query(name: str):
    """Register a function of (spark, folder)."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return add


def table(name: str, build: Callable[[Snapshot], DataFrame], *columns: str) -> None:
    """Register a query over the derived snapshot, optionally projected."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(derived_snapshot(spark, sf_dir))
        return out.selectExpr(*columns) if columns else out
    QUERIES[name] = run


def joined(arr: str) -> str:
    return f"array_join({arr}, '|')"


# --- 2.2 extraction ------------------------------------------------------------------------
def pages(name: str, *columns: str) -> None:
    table(name, lambda s: s.page, "ord", *columns)


pages("extract_title", "title", "title_html")
pages("extract_meta_description", "meta_description", "meta_desc_html")
pages("extract_meta_robots", "meta_robots")
pages("indexability", "indexability.is_indexable as is_indexable", "indexability.status as status", "indexability.noindex_source as noindex_source",
      "indexability.nofollow as nofollow", "indexability.nosnippet as nosnippet", "indexability.max_snippet as max_snippet",
      "indexability.max_image_preview as max_image_preview")
pages("canonical", "canonical_url", "canonical_is_relative", "canonical_is_self_ref", "multiple_canonicals")
pages("viewport", "viewport", "viewport_has_device_width", "viewport_allows_scaling")
pages("html_lang", "lang")
pages("favicon", "favicon_url")
pages("pagination", "pagination_next", "pagination_prev")
pages("amp", "amp_url")
pages("js_rendered", "is_js_rendered")
pages("spa_shell", "is_spa_shell")
pages("soft_404", "is_soft_404")
pages("redirect_display", f"{site.redirect_display()} as redirects")
pages("compression_ratio", f"{site.COMPRESSION} as compression_ratio")
table("headings", lambda s: assets.heading_rows(s.page), "ord", "n", "level", "text")
table("images", lambda s: assets.image_rows(s.page), "ord", "n", "src", "alt", "is_missing_alt", "alt_text_length", "width", "height",
      "loading", "is_lazy_loaded", "fetchpriority", "format", "is_next_gen_format")
table("image_format", lambda s: assets.image_rows(s.page), "ord", "n", "src", "format")
table("links", lambda s: assets.link_rows(s.page), "ord", "n", "link_url", "text", "is_internal", "rel", "is_nofollow", "is_sponsored", "is_ugc",
      "target", "is_self_referencing", "anchor_text_type")
table("anchor_text_type", lambda s: assets.link_rows(s.page).groupBy("site", "anchor_text_type").agg(F.count(F.lit(1)).alias("links")))
for _name, _col in [("robots_directives", "robots_directives"), ("x_robots_directives", "x_robots_directives")]:
    table(_name, lambda s, c=_col: s.page.selectExpr("ord", f"posexplode({c}) as (n, d)"), "ord", "n", "d.directive as directive", "d.value as value", "d.source as source")
for _name, _col in [("open_graph", "open_graph"), ("twitter_cards", "twitter_cards"), ("http_equiv", "http_equiv")]:
    table(_name, lambda s, c=_col: s.page.selectExpr("ord", f"explode({c}) as (key, value)"))
table("hreflang", lambda s: s.page.selectExpr("ord", "posexplode(hreflang) as (n, h)"), "ord", "n", "h.target_url as target_url",
      "h.language_code as language_code", "h.country_code as country_code", "h.is_x_default as is_x_default")
table("json_ld", lambda s: s.page.selectExpr("ord", "inline(json_ld)"), "ord", "n", "valid", "data", "error", "schema_type",
      f"{joined('schema_types')} as schema_types", "schema_id", "html_snippet")
table("json_ld_requirements", lambda s: s.page.selectExpr("ord", "inline(json_ld)"), "ord", "n", f"{joined('required_missing')} as required_missing",
      f"{joined('recommended_missing')} as recommended_missing", "rich_result_compatible", f"{joined('validation_errors')} as validation_errors",
      f"{joined('warnings')} as warnings")
table("html_snippet", lambda s: s.issues.where("html_snippet is not null"), "ord", "seq", "issue_type", "html_snippet")


@query("extract_js_title")
def _js_title(spark, sf_dir):
    from pagelens.functions.jsstate import js_title, states
    html = derived.derived_crawl(spark, sf_dir).select("ord", "html")
    return html.selectExpr("ord", f"{states('html')} as st").selectExpr("ord", f"{js_title('st')} as js_title")


@query("extract_js_description")
def _js_description(spark, sf_dir):
    from pagelens.functions.jsstate import js_description, states
    html = derived.derived_crawl(spark, sf_dir).select("ord", "html")
    return html.selectExpr("ord", f"{states('html')} as st").selectExpr("ord", f"{js_description('st')} as js_description")


def _nodes(s: Snapshot) -> DataFrame:
    return dom.dom_nodes(s.crawl)


table("dom_nodes", _nodes, "ord", "url", "tag", "n", "size(ancestors) as depth", "css_selector", "xpath", "link_position")
table("css_selector", _nodes, "ord", "url", "tag", "n", "css_selector")
table("xpath", _nodes, "ord", "url", "tag", "n", "xpath")
table("link_position", lambda s: dom.link_positions(_nodes(s), assets.link_rows(s.page)), "ord", "n", "link_url", "link_position")
table("issue_locators", lambda s: dom.issue_locators(rules.page_issues(s.page), _nodes(s)), "ord", "seq", "issue_type", "css_selector", "xpath")


# --- 2.3 URL functions ---------------------------------------------------------------------
def url_query(name: str, *columns: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: derived.load_pages(spark, sf_dir).selectExpr("page_id", "url", *columns)


url_query("is_valid_url", f"{U.is_valid_url('url')} as valid", f"{U.is_valid_url('substring(url, 6)')} as valid_cut")
url_query("get_domain", f"{U.get_domain('url')} as domain", f"{U.get_domain('substring(url, 9)')} as domain_cut")
url_query("is_internal_url", f"{U.is_internal_url('url', lit('https://example.com/'))} as of_example", f"{U.is_internal_url(lit('/x'), 'url')} as relative",
          f"{U.is_internal_url(lit('https://www.example.com/'), 'url')} as of_www")
url_query("normalize_url", f"{U.normalize_url('url')} as url_key", f"{U.normalize_url('concat(' + U.frontier_key('url') + ', ' + lit('/index.html') + ')')} as index_key")
url_query("frontier_key", f"{U.frontier_key('url')} as url_key")
url_query("url_structure_score", f"cast({U.url_structure_score('url')} as int) as score")
JOIN_REFS = ["/abs/x?q=1#f", "rel/y", "?p=2", "//cdn.example.com/z", "https://other.example.com/a", "#frag", "../up", "./here", "mailto:a@b.c"]
QUERIES["url_join"] = lambda spark, sf_dir: derived.load_pages(spark, sf_dir).selectExpr(
    "page_id", "url", f"posexplode(array({', '.join(lit(r) for r in JOIN_REFS)})) as (n, ref)"
).selectExpr("page_id", "n", f"{U.url_join('url', 'ref')} as joined")


# --- 2.1 sources and sinks -----------------------------------------------------------------
@query("read_crawl")
def _read_crawl(spark, sf_dir):
    """The derived crawl, stored and read through the source's reader."""
    path = scratch(spark, "crawl")
    derived.derived_crawl(spark, sf_dir).write.parquet(path)
    return crawl_source.successful(crawl_source.read_crawl(spark, path)).select(
        "ord", "site", "url", "status_code", "html_size_bytes", "compressed_size", "crawl_depth"
    )


READ_OUT = ["ord", "site", "url", "status_code", "html_size_bytes", "compressed_size", "crawl_depth"]


def _archived(spark, sf_dir):
    path = scratch(spark, "crawl-warc")
    warc.write_crawl_warc(derived.derived_crawl(spark, sf_dir), path)
    return path


@query("read_crawl_warc")
def _read_crawl_warc(spark, sf_dir):
    """The derived crawl, stored as archives; no body is unpacked."""
    crawl = crawl_source.read_crawl(spark, _archived(spark, sf_dir), fmt="warc", columns=[*READ_OUT, "error_message"])
    return crawl_source.successful(crawl).select(*READ_OUT)


@query("fetch_guard_warc")
def _fetch_guard_warc(spark, sf_dir):
    """The guard over the same archives, bodies included."""
    crawl = crawl_source.read_crawl(spark, _archived(spark, sf_dir), fmt="warc")
    return crawl_source.fetch_guard(crawl).selectExpr("ord", "error_message", "length(html) as html_length")


table("fetch_guard", lambda s: crawl_source.fetch_guard(s.crawl), "ord", "error_message", "length(html) as html_length")


def _documents(spark, sf_dir, columns):
    return derived.load_pages(spark, sf_dir).selectExpr(*columns)


@query("read_sitemap")
def _read_sitemap(spark, sf_dir):
    """Stored sitemap documents, read through the source's reader."""
    path = scratch(spark, "sitemaps")
    _documents(spark, sf_dir, derived.SITEMAP_DOCUMENT_COLUMNS).select("url", "body").write.parquet(path)
    return sitemap.expand_index(crawl_source.read_documents(spark, path))


@query("sitemap_locs")
def _sitemap_locs(spark, sf_dir):
    return sitemap.sitemap_locs(_documents(spark, sf_dir, derived.SITEMAP_DOCUMENT_COLUMNS))


def _robots(spark, sf_dir):
    docs = _documents(spark, sf_dir, derived.ROBOTS_DOCUMENT_COLUMNS).groupBy("url").agg(F.min_by("body", "ord").alias("body"))
    return robots.robots_rules(docs)


@query("read_robots")
def _read_robots(spark, sf_dir):
    return _robots(spark, sf_dir)


@query("robots_filter")
def _robots_filter(spark, sf_dir):
    urls = derived.load_pages(spark, sf_dir).select("page_id", "url")
    return frontier.robots_filter(urls, robots.rules_for_agent(_robots(spark, sf_dir), AGENT))


@query("write_issues_csv")
def _write_issues_csv(spark, sf_dir):
    s = derived_snapshot(spark, sf_dir)
    path = scratch(spark, "issues-csv")
    located = dom.issue_locators(s.issues, _nodes(s))
    sinks.write_issues_csv(located, path)
    back = sinks.read_issues_csv(spark, path, verify=True)
    return back.select(*[F.coalesce(F.col(n), F.lit("")).alias(c) for c, n in sinks.CSV_COLUMNS.items() if c not in ("css_selector", "xpath")])


@query("write_issues_csv_compact")
def _issues_csv_compact(spark, sf_dir):
    s = derived_snapshot(spark, sf_dir)
    issues = s.issues.selectExpr("*", "cast(null as string) as css_selector", "cast(null as string) as xpath")
    return sinks.issues_csv_table(issues, compact=True).withColumnsRenamed({"URL": "url", "Severity": "severity", "Issue Type": "issue_type", "Description": "description",
                                                                            "CSS Selector": "css_selector", "XPath": "xpath", "Recommendation": "recommendation"})


def _report_parts(s: Snapshot) -> dict[str, DataFrame]:
    located = dom.issue_locators(s.issues, _nodes(s))
    return {
        "sites": s.report,
        "pages": sinks.page_documents(s.page, located, s.scores, s.checked),
        "site_issues": s.issues.where("ord < 0"),
        **{f"duplicate_{k}": site.duplicate_members(s.page, k) for k in site.DUPLICATE_KEYS},
        "orphans": s.orphans,
        "redirects": site.redirect_pages(s.page),
        "statuses": reporting.status_distribution(s.page),
        "keywords": s.top_keywords.select("site", "position", "keyword", "count", "density"),
        "advanced": s.advanced_site,
    }


@query("write_report_json")
def _write_report_json(spark, sf_dir):
    """Every part of the written report, read back as (part, site, name, value)."""
    path = scratch(spark, "report-json")
    parts = _report_parts(derived_snapshot(spark, sf_dir))
    sinks.write_report_json(parts, path)
    path = sinks.report_folder(spark, path, verify=True)

    def back(name: str) -> DataFrame:
        schema = StructType([f for f in parts[name].schema.fields])
        return spark.read.schema(schema).json(f"{path}/{name}")

    def part(name: str, df: DataFrame, key: str, *values: str) -> DataFrame:
        shown = ", ".join(f"coalesce(cast({v} as string), '')" for v in values)
        return df.selectExpr(f"{lit(name)} as part", "site", f"cast({key} as string) as name", f"concat_ws('|', {shown or lit('')}) as value")

    finding = ("severity", "issue_type", "description", "html_snippet", "recommendation")
    pages = back("pages")
    out = [
        part("site", back("sites"), "start_url", "site_score", "ai_visibility_score", "site_speed_score", "site_health_score", "pages", "orphans"),
        part("page", pages, "ord", "url", "score", "title", "coalesce(size(issues), 0)"),
        part("finding", pages.selectExpr("site", "ord", "inline(issues)"), "concat(ord, ':', seq)", *finding),
        part("link", pages.selectExpr("site", "ord", "inline(checked_links)"), "concat(ord, ':', n)", "target", "is_internal", "status_code", "is_broken"),
        part("image", pages.selectExpr("site", "ord", "inline(checked_images)"), "concat(ord, ':', n)", "target", "status_code", "is_broken"),
        part("site finding", back("site_issues"), "seq", *finding),
        *[part(f"duplicate {k}", back(f"duplicate_{k}"), "ord", "dup_key", "url", "n_pages", "is_first") for k in site.DUPLICATE_KEYS],
        part("orphan", back("orphans"), "loc"),
        part("redirect", back("redirects"), "ord", "url", "redirect_type"),
        part("status", back("statuses"), "status_code", "pages"),
        part("keyword", back("keywords"), "position", "keyword", "count"),
        part("advanced", back("advanced"), "'counts'", "security_issues", "mixed_content", "thin_pages"),
    ]
    return reduce(DataFrame.unionByName, out)


table("sitemap_export", lambda s: structured.sitemap_export(s.scores, s.probe, RUN_DATE), "ord", "loc", "lastmod", "changefreq", "priority")
table("llms_txt", lambda s: structured.llms_txt(s.llms_sites, email="concat('team@', site)", features="array('Audit', 'Keywords')", blog_url="concat(site_url, '/blog')"))
table("llms_full_txt", lambda s: structured.llms_full_txt(s.llms_sites, email="concat('team@', site)", features="array('Audit', 'Keywords')"))


@query("keyword_csv")
def _keyword_csv(spark, sf_dir):
    s = derived_snapshot(spark, sf_dir)
    path = scratch(spark, "keyword-csv")
    sinks.write_keyword_csv(s.top_keywords.select("site", "position", "keyword", "count", "density"), path)
    return spark.read.schema("site string, position int, keyword string, count bigint, density double").option("header", True).csv(path)


# --- 2.4 frontier --------------------------------------------------------------------------
table("discover_links", lambda s: frontier.discovered_links(s.crawl), "ord", "target_url")
table("seed_frontier", lambda s: frontier.seed_frontier(s.sitemap, s.probe))
table("visited_dedup", lambda s: frontier.visited_dedup(s.crawl.select("site", "ord", "url")))


ALLOWED = "not {} like '%/sub/page.html'"
NEXT_PLACE = 1_000_000


def _reached(s: Snapshot) -> DataFrame:
    """Depth from the start URLs over the links of fetched pages to allowed URLs.

    The stored pages of a site link to few of each other, so each fetched page also leads to the
    next stored page of its site, in last place.
    """
    following = Window.partitionBy("site").orderBy("ord")
    pages = s.crawl.selectExpr("site", "ord", "status_code", "error_message", f"{U.normalize_url('url')} as source_key").withColumn("target_key", F.lead("source_key").over(following))
    stored = frontier.fetched(pages).where("target_key is not null").select("site", "source_key", "target_key", F.lit(NEXT_PLACE).alias("pos"))
    edges = frontier.page_edges(s.crawl).unionByName(stored).where(ALLOWED.format("target_key"))
    starts = s.probe.selectExpr("site", f"{U.normalize_url('start_url')} as url_key")
    return frontier.crawl_depth(starts, edges, MAX_DEPTH)


table("crawl_depth_bfs", _reached, "site", "url_key", "depth", "array_join(path, '.') as path")
table("frontier_limit", lambda s: frontier.frontier_limit(_reached(s), MAX_PAGES), "site", "url_key", "depth", "rn")

# --- 2.5 page rules ------------------------------------------------------------------------
ISSUE_OUT = ["ord", "seq", "url", "severity", "issue_type", "description", "html_snippet", "recommendation"]


def rule_slug(issue: str) -> str:
    return "rule_" + re.sub(r"[^a-z0-9]+", "_", issue.lower()).strip("_")


for _issue, _, _ in rules.rules():
    table(rule_slug(_issue), lambda s, i=_issue: rules.page_issues(s.page, i), *ISSUE_OUT)
table("page_issues", lambda s: rules.page_issues(s.page), *ISSUE_OUT)
table("rule_broken_link", lambda s: assets.broken_issues(s.checked).where("issue_type = 'Broken Link'"), *ISSUE_OUT)
table("rule_broken_image", lambda s: assets.broken_issues(s.checked).where("issue_type = 'Broken Image'"), *ISSUE_OUT)
table("rule_hreflang_broken_target", lambda s: assets.hreflang_issues(s.hreflang), *ISSUE_OUT)
table("rule_orphan_pages", lambda s: site.orphan_issues(s.orphans, s.probe), "site", "url", "severity", "issue_type", "description", "recommendation")
table("page_score", lambda s: s.base_scores, "ord", "url", "base_score")
table("page_score_assets", lambda s: s.scores, "ord", "url", "base_score", "n_broken", "score")
table("page_report", lambda s: site.page_report(s.page, s.scores))

# --- 2.6 site level ------------------------------------------------------------------------
table("asset_status", lambda s: assets.asset_status(s.references, s.url_status))
for _kind in site.DUPLICATE_KEYS:
    _id = {"content": "dup_content", "title": "dup_titles", "description": "dup_descriptions"}[_kind]
    table(_id, lambda s, k=_kind: site.duplicate_groups(s.page, k))
    table(f"{_id}_members", lambda s, k=_kind: site.duplicate_members(s.page, k))
    table(f"{_id}_issues", lambda s, k=_kind: site.duplicate_issues(s.page, k), "site", "seq", "url", "severity", "issue_type", "description", "recommendation")
table("redirect_pages", lambda s: site.redirect_pages(s.page))
table("orphan_pages", lambda s: s.orphans)
table("orphan_pages_inlink", lambda s: site.orphan_pages_inlink(s.sitemap, s.page))
table("hreflang_targets", lambda s: s.hreflang)
SITE_SCORES = ["site", "pages", "site_score"]
table("site_score", lambda s: s.report, *SITE_SCORES)
table("status_distribution", lambda s: reporting.status_distribution(s.page))
table("site_ai_score", lambda s: s.report, "site", "ai_visibility_score")
table("site_speed_score", lambda s: s.report, "site", "site_speed_score")
table("site_health_score", lambda s: s.report, "site", "site_health_score")
table("avg_response", lambda s: site.site_facts(s.page), "site", "round(avg_response_ms, 6) as avg_response_ms")
table("website_report", lambda s: s.report, "site", "start_url", "robots_txt_found", "sitemap_xml_found", "pages", "orphans", "redirect_chains",
      "duplicate_contents", "duplicate_titles", "duplicate_descriptions", "round(avg_page_score, 6) as avg_page_score", "site_score",
      "ai_visibility_score", "site_speed_score", "site_health_score")

# --- 2.7 advanced page audit ---------------------------------------------------------------
table("security_headers", lambda s: advanced.security_headers(s.page), "ord", "header", "present", "value", "severity", "description", "recommendation")
table("redirect_chain", lambda s: advanced.redirect_chain(s.page), "ord", "original_url", f"{joined('chain')} as chain", "final_url", "total_redirects", "is_too_long")
table("content_quality", lambda s: advanced.content_quality(s.page).drop("readability", "syllable_count"))
table("readability", lambda s: advanced.content_quality(s.page), "ord", "word_count", "syllable_count", "readability")
table("mixed_content", lambda s: advanced.mixed_content(s.page), "ord", "page_url", "n", "resource_url", "resource_type")
table("internal_link_score", lambda s: s.advanced, "ord", "internal_link_score")
table("advanced_page", lambda s: s.advanced, "ord", "url", "word_count", "readability", "missing_headers", "mixed_count", "redirect_hops", "url_structure_score", "internal_link_score")


@query("document_readability")
def _document_readability(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("doc_id", f"{content_metrics('text')} as m")
    ease = reading_ease("m.word_count", "m.sentence_count", "m.syllable_count")
    return docs.selectExpr("doc_id", "m.word_count as word_count", "m.sentence_count as sentence_count", "m.syllable_count as syllable_count",
                           f"{readability_band(ease)} as readability")


# --- 2.8 AI visibility ---------------------------------------------------------------------
for _id, _k in [("aiv_structured_data", "sd"), ("aiv_meta_description", "md"), ("aiv_headings", "hs"), ("aiv_content_depth", "cd"), ("aiv_eeat", "ee"),
                ("aiv_answer", "an"), ("aiv_technical", "te"), ("aiv_image_alt", "im"), ("aiv_internal_links", "il"), ("aiv_social", "so")]:
    table(_id, lambda s: s.factors, "ord", f"{_k} as score")
table("aiv_status", lambda s: s.factor_table, "ord", "factor", "status")
table("aiv_overall", lambda s: s.factors, "ord", "overall_score")
table("aiv_grade", lambda s: s.factors, "ord", "grade")
table("aiv_engines", lambda s: s.factors, "ord", "google_score", "chatgpt_score", "perplexity_score")
table("aiv_citation", lambda s: s.factors, "ord", "citation_potential")
table("aiv_geo", lambda s: s.factors, "ord", "geo_readiness")
table("advanced_site", lambda s: s.advanced_site.join(advanced.readability_mode(s.advanced), "site", "left"))
table("advanced_site_extra", lambda s: advanced.advanced_site_extra(s.page))

# --- 2.9 keywords --------------------------------------------------------------------------
table("page_text", lambda s: keywords.page_text(s.page), "ord", "text")
table("page_text_labeled", lambda s: keywords.page_text_labeled(s.page), "ord", "labeled_text")
table("tokenize", lambda s: s.tokenized, "ord", "size(tokens) as n_tokens", "array_join(tokens, ' ') as tokens")
table("stop_filter", lambda s: keywords.occurrences(s.tokenized).where("n = 1"), "ord", "pos", "term")
table("ngrams", lambda s: s.tokenized.selectExpr("ord", f"posexplode(concat({ngrams('tokens', 2)}, {ngrams('tokens', 3)})) as (pos, phrase)"))
KEYWORD_OUT = ["site", "keyword", "count", "n_pages", "density", "in_title", "in_meta", "in_headings", "in_url"]
table("keyword_count", lambda s: s.keywords, "site", "keyword", "count", "n_pages")
table("keyword_pages", lambda s: keywords.keyword_pages(s.tokenized))
table("keyword_density", lambda s: s.keywords, "site", "keyword", "density")
table("keyword_placement", lambda s: s.keywords, *KEYWORD_OUT)
table("vocabulary_stats", lambda s: keywords.vocabulary(s.tokenized))
table("primary_keywords", lambda s: keywords.primary_keywords(s.keywords), "rank", *KEYWORD_OUT)
table("secondary_keywords", lambda s: keywords.secondary_keywords(s.keywords), "rank", *KEYWORD_OUT)
table("lsi_keywords", lambda s: keywords.lsi_keywords(s.keywords), "site", "rank", "keyword", "count", "density")
table("keyword_gaps", lambda s: s.gaps)
table("keyword_report", lambda s: keywords.keyword_report(s.tokenized, s.keywords))
table("keyword_overview", lambda s: keywords.keyword_overview(s.top_keywords))
table("keyword_search", lambda s: keywords.keyword_search(keywords.keyword_overview(s.top_keywords), KEYWORD_NEEDLE), "site", "position", "keyword", "volume")
table("keyword_recommendations", lambda s: keywords.keyword_recommendations(s.top_keywords))
table("serp_opportunities", lambda s: keywords.serp_opportunities(s.top_keywords, s.gaps))
table("keyword_clusters", lambda s: keywords.keyword_clusters(s.top_keywords, s.seeds))
table("keyword_expand", lambda s: keywords.keyword_expand(s.seeds, s.keywords))
table("keyword_questions", lambda s: keywords.keyword_questions(s.seeds))
table("keyword_metrics", lambda s: keywords.keyword_metrics(keywords.keyword_expand(s.seeds, s.keywords)))
table("keyword_labels", lambda s: keywords.keyword_labels(keywords.keyword_expand(s.seeds, s.keywords)))
table("competitor_gap", lambda s: keywords.competitor_gap(s.keywords, s.probe.agg(F.min("site").alias("site"))))


def _document_keywords(spark, sf_dir, **asked):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain, dealt = (keywords.tokens(keywords.document_text(d)) for d in (docs, spread(docs, keywords.TASK_BYTES)))
    return keywords.keyword_table(plain, dealt, **asked)


@query("document_keyword_count")
def _document_keyword_count(spark, sf_dir):
    return _document_keywords(spark, sf_dir, placed=False).select("site", "keyword", "count", "n_pages", "density")


@query("document_primary_keywords")
def _document_primary_keywords(spark, sf_dir):
    return keywords.primary_keywords(_document_keywords(spark, sf_dir, lengths=(1,))).select("site", "rank", "keyword", "count", "density")


# --- 2.10 reports --------------------------------------------------------------------------
table("all_issues", lambda s: s.issues, "site", *ISSUE_OUT)
table("severity_counts", lambda s: reporting.severity_counts(s.issues))
table("issue_clusters_html", lambda s: reporting.issue_clusters_html(s.issues))
table("issue_clusters_pdf", lambda s: reporting.issue_clusters_pdf(s.issues))
table("issue_distribution", lambda s: reporting.issue_distribution(s.issues))
table("pages_with_issues", lambda s: reporting.pages_with_issues(s.issues))
table("executive_findings", lambda s: reporting.executive_findings(s.issues, s.report))
table("top_issues", lambda s: reporting.top_issues(s.issues))
table("health_breakdown", lambda s: reporting.health_breakdown(s.report, s.advanced_site))
table("health_table", lambda s: reporting.health_table(s.report))
table("page_rows", lambda s: reporting.page_rows(s.page, s.issues, s.scores))
table("report_chapters", lambda s: reporting.report_chapters(s.issues))
table("status_buckets", lambda s: reporting.status_buckets(s.page))
table("depth_distribution", lambda s: reporting.depth_distribution(s.page))
table("link_overview", lambda s: reporting.link_overview(s.page))
table("links_per_page_hist", lambda s: reporting.links_per_page_hist(s.page))
table("avg_page_score", lambda s: reporting.avg_page_score(s.scores))
table("section_scores", lambda s: reporting.section_scores(s.issues, s.probe))
table("technical_checklist", lambda s: reporting.technical_checklist(s.report))
table("pages_overview", lambda s: reporting.pages_overview(s.page, s.issues, s.scores))
table("http_error_summary", lambda s: reporting.http_error_summary(s.page, s.issues))
table("http_error_totals", lambda s: reporting.http_error_totals(reporting.http_error_summary(s.page, s.issues)))
table("error_pages", lambda s: reporting.error_pages(s.page, s.issues, s.scores))
table("technical_issues", lambda s: reporting.technical_issues(s.issues))
table("technical_issue_counts", lambda s: reporting.technical_issue_counts(s.issues))
table("content_issues", lambda s: reporting.content_issues(s.page, s.issues))
table("image_issues", lambda s: reporting.of_types(s.issues, ["Missing Alt Text", "Broken Image"]), "ord", "seq", "url", "issue_type", "description")
table("link_issues", lambda s: reporting.of_types(s.issues, ["Broken Link"]), "ord", "seq", "url", "severity", "description")
table("page_perf", lambda s: reporting.page_perf(s.page))
table("schema_inventory", lambda s: reporting.schema_inventory(s.page))
table("schema_summary", lambda s: reporting.schema_summary(s.page))
table("quality_table", lambda s: advanced.content_quality(s.page), "url", "word_count", "sentence_count", "avg_words_per_sentence", "readability",
      "if(is_thin_content, 'Yes', '') as thin", "if(heading_hierarchy_valid, 'Valid', 'Invalid') as hierarchy", "internal_link_count", "external_link_count")
table("mixed_content_table", lambda s: reporting.mixed_content_table(advanced.mixed_content(s.page)), "site", "rank", "page_url", "resource_url", "resource_type")
table("redirect_table", lambda s: reporting.redirect_table(advanced.redirect_chain(s.page)))
table("technical_summary", lambda s: reporting.technical_summary(s.report))
table("missing_security_headers", lambda s: advanced.missing_security_headers(s.page))
table("factor_table", lambda s: s.factor_table)
table("priority_improvements", lambda s: visibility.priority_improvements(s.factor_table))
table("score_averages", lambda s: s.advanced_site, "site", "avg_url_score", "avg_link_score")
table("issue_summary", lambda s: reporting.issue_summary(s.issues))
table("score_label", lambda s: s.scores, "ord", "score", f"{reporting.score_label('score')} as label")
table("score_indicator", lambda s: s.report, "site", *[f"{reporting.score_indicator(c)} as {c}" for c in ("site_score", "ai_visibility_score", "site_speed_score", "site_health_score")])
table("priority_actions", lambda s: reporting.priority_actions(s.issues, s.report))
table("fix_guides", lambda s: guides.fix_guides(s.issues))
table("fix_guides_wordpress", lambda s: guides.fix_guides(s.issues, "WordPress"), "site", "issue_type", "priority", "cms_steps")
table("fix_guides_short", lambda s: guides.fix_guides_short(s.issues))
table("issue_descriptions", lambda s: guides.issue_descriptions(s.issues))
table("fix_plan", lambda s: reporting.fix_plan(s.issues))

# --- 2.11 structured data ------------------------------------------------------------------
table("validate_rich_results", lambda s: structured.rich_results(s.page.selectExpr("ord", "inline(json_ld)").select("ord", "n", "data")),
      "ord", "n", "is_valid", f"{joined('errors')} as errors", f"{joined('warnings')} as warnings", "rich_result_type", f"{joined('missing_required')} as missing_required")
table("jsonld_breadcrumb_from_url", lambda s: s.page.selectExpr("ord", f"{structured.breadcrumb(structured.crumbs_from_url('url', 'site'))} as json"))
table("jsonld_breadcrumb", lambda s: s.page.selectExpr(
    "ord", f"{structured.breadcrumb('transform(headings, h -> named_struct(' + lit('name') + ', h.text, ' + lit('url') + ', if(h.level = 1, url, cast(null as string))))')} as json"))
pages("jsonld_webpage", f"{structured.webpage('title', 'url', 'meta_description', 'coalesce(lang, ' + lit('en') + ')')} as json")
pages("jsonld_generic", f"{structured.generic(lit('AboutPage'), 'title', 'url')} as json")
pages("jsonld_article", structured.article("title", "url", published="substring(cast(fetched_at as string), 1, 10)", author="if(ord % 2 = 0, site, '')", author_url="if(ord % 4 = 0, concat('https://', site), '')",
      description="meta_description", image="open_graph['og:image']", publisher="site", publisher_logo="favicon_url") + " as json")
pages("jsonld_faq_fallback", f"{structured.faq_fallback('title', 'meta_description')} as json")
table("jsonld_website_search", lambda s: s.probe.selectExpr("site", f"{structured.website_search('site', 'start_url')} as json"))


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("jsonld_organization")
def _jsonld_organization(spark, sf_dir):
    url = "concat('https://suppliers.example.com/', s_suppkey)"
    return _read(spark, sf_dir, "supplier").selectExpr("s_suppkey", structured.organization(
        "s_name", url, description="if(s_acctbal > 0, 'In good standing', '')", phone="concat('+', s_nationkey, '-555')",
        address="if(s_suppkey % 2 = 0, concat(s_suppkey, ' Main Street'), '')", same_as="if(s_suppkey % 3 = 0, array('https://social.example.com/s'), cast(array() as array<string>))") + " as json")


@query("jsonld_local_business")
def _jsonld_local_business(spark, sf_dir):
    url = "concat('https://suppliers.example.com/', s_suppkey)"
    return _read(spark, sf_dir, "supplier").selectExpr("s_suppkey", structured.local_business(
        "s_name", url, phone="concat('+', s_nationkey, '-555')", address="if(s_suppkey % 2 = 0, concat(s_suppkey, ' Main Street'), '')", city="'Springfield'",
        zip_code="cast(10000 + s_suppkey as string)", latitude="s_nationkey", longitude="s_suppkey", hours="'Mo-Fr 09:00-17:00'") + " as json")


@query("jsonld_product")
def _jsonld_product(spark, sf_dir):
    return _read(spark, sf_dir, "part").selectExpr("p_partkey", structured.product(
        "p_name", "concat('https://shop.example.com/p/', p_partkey)", description="concat(p_type, ' size ', p_size)",
        price="cast(cast(p_retailprice as decimal(12,2)) as string)", availability="if(p_size > 5, 'InStock', 'OutOfStock')", brand="p_brand") + " as json")


def _faq_pairs(spark, sf_dir) -> DataFrame:
    """A user turn and the answer that follows it."""
    turns = _read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").selectExpr("conv_id", "turn", "text as question")
    answered = turns.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 as turn", "text as answer")
    return asked.join(answered, ["conv_id", "turn"])


@query("jsonld_faq")
def _jsonld_faq(spark, sf_dir):
    """One Question entity per turn pair: a conversation of any length is as many rows."""
    place = Window.partitionBy("conv_id").orderBy("turn")
    return _faq_pairs(spark, sf_dir).withColumn("position", F.row_number().over(place)).selectExpr("conv_id", "turn", "position", f"{structured.question('question', 'answer')} as json")


@query("jsonld_faq_document")
def _jsonld_faq_document(spark, sf_dir):
    """One document per conversation, whatever its length; the document is as large as the conversation."""
    grouped = _faq_pairs(spark, sf_dir).groupBy("conv_id").agg(
        F.expr("transform(sort_array(collect_list(struct(turn, question, answer))), x -> named_struct('question', x.question, 'answer', x.answer)) as entries")
    )
    return grouped.selectExpr("conv_id", f"{structured.faq('entries')} as json")


SUGGESTION_OUT = ["ord", "n", "suggestion"]
table("title_suggestions", lambda s: structured.title_suggestions(s.page), *SUGGESTION_OUT)
table("page_title_suggestions", lambda s: structured.page_title_suggestions(s.page), *SUGGESTION_OUT)
table("meta_suggestions", lambda s: structured.meta_suggestions(s.page), *SUGGESTION_OUT)
table("page_meta_suggestions", lambda s: structured.page_meta_suggestions(s.page), *SUGGESTION_OUT)
table("h1_suggestions", lambda s: structured.h1_suggestions(s.page), *SUGGESTION_OUT)
table("page_h1_suggestions", lambda s: structured.page_h1_suggestions(s.page), *SUGGESTION_OUT)
table("issue_explanations", lambda s: structured.issue_explanations(s.issues), "ord", "seq", "issue_type", "explanation")
table("suggestions_for_issues", lambda s: structured.page_title_suggestions(structured.pages_needing(s.page, s.issues, "Title")).unionByName(
    structured.page_meta_suggestions(structured.pages_needing(s.page, s.issues, "Meta Description"))).unionByName(
    structured.page_h1_suggestions(structured.pages_needing(s.page, s.issues, "H1"))), *SUGGESTION_OUT)


# --- 2.12 streaming ------------------------------------------------------------------------
def _stream(spark, sf_dir) -> DataFrame:
    raw = (
        spark.readStream.schema("page_id bigint, url string, html string").option("pathGlobFilter", "pages.parquet").parquet(sf_dir)
    )
    return derived.derive_crawl(raw)


def _run(spark, df: DataFrame, name: str) -> DataFrame:
    path, ckpt = scratch(spark, name), scratch(spark, f"{name}-ckpt")
    streaming.append_to(df, path, ckpt).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("stream_page_audit")
def _stream_page_audit(spark, sf_dir):
    out = _run(spark, streaming.stream_page_audit(_stream(spark, sf_dir)), "stream-audit")
    return out.selectExpr(*ISSUE_OUT)


@query("stream_visited")
def _stream_visited(spark, sf_dir):
    path = scratch(spark, "stream-visited")
    streaming.stream_visited(_stream(spark, sf_dir), path, scratch(spark, "stream-visited-ckpt")).awaitTermination()
    return streaming.visited(spark, path).select("site", "url_key")


@query("stream_progress")
def _stream_progress(spark, sf_dir):
    """Every window, those still open at the end of the stored pages too."""
    path = scratch(spark, "stream-progress")
    for running in streaming.stream_progress(_stream(spark, sf_dir), path, scratch(spark, "stream-progress-ckpt")):
        running.awaitTermination()
    return streaming.running_progress(spark, path)


@query("stream_site_scores")
def _stream_site_scores(spark, sf_dir):
    s = derived_snapshot(spark, sf_dir)
    path = scratch(spark, "stream-scores")
    streaming.stream_site_scores(_stream(spark, sf_dir), s.probe, path, scratch(spark, "stream-scores-ckpt")).awaitTermination()
    return streaming.running_site_scores(spark, path, s.probe, s.sitemap).select(
        "site", "pages", "site_score", "ai_visibility_score", "site_speed_score", "site_health_score"
    )
