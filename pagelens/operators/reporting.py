"""Report tables over `issue`, page scores, `page` and the site report. All per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.arrays import any_word, lit, lits
from pagelens.operators.catalog import ISSUES, SEVERITY_ORDER
from pagelens.operators.site import redirect_display

# Fixed values.
STATUS_NAMES = {
    200: "200 OK", 301: "301 Moved Permanently", 302: "302 Found (Redirect)", 304: "304 Not Modified",
    400: "400 Bad Request", 401: "401 Unauthorized", 403: "403 Forbidden", 404: "404 Not Found",
    405: "405 Method Not Allowed", 408: "408 Request Timeout", 410: "410 Gone", 429: "429 Too Many Requests",
    500: "500 Internal Server Error", 502: "502 Bad Gateway", 503: "503 Service Unavailable", 504: "504 Gateway Timeout",
}
STATUS_CLASS = {2: "OK", 3: "Redirect", 4: "Error", 5: "Critical"}
HTTP_ISSUES = ["Soft 404 Detected", "Broken Link", "Broken Image"]
TECHNICAL_TYPES = [
    "HTTPS Security", "Missing Canonical URL", "Canonical Mismatch", "Missing Viewport Tag", "Missing Lang Attribute",
    "Missing Favicon", "Missing H1 Heading", "Multiple H1 Headings", "Invalid JSON-LD", "Missing Open Graph Tags",
    "Missing Twitter Cards", "Missing Title", "Title Too Short", "Title Too Long", "Missing Meta Description",
    "Meta Description Too Short", "Meta Description Too Long", "Missing Alt Text", "Broken Link", "Broken Image",
    "Soft 404 Detected", "Server Error", "Page Not Found", "Access Forbidden", "Orphan Pages",
]
CONTENT_TYPES = [
    "Missing Title", "Title Too Short", "Title Too Long", "Missing Meta Description", "Meta Description Too Short",
    "Meta Description Too Long", "Missing H1 Heading", "Multiple H1 Headings",
]
SECTIONS = [
    ("Crawlability", ["robots", "sitemap", "redirect", "crawl"]),
    ("Indexability", ["canonical", "noindex", "index", "meta robots"]),
    ("On-Page SEO", ["title", "meta description", "h1", "heading", "content"]),
    ("Links", ["link", "anchor", "nofollow"]),
    ("Images", ["image", "alt", "lazy"]),
    ("Structured Data", ["schema", "json-ld", "jsonld"]),
    ("Security", ["security", "https", "mixed content", "header"]),
    ("Performance", ["response", "size", "speed", "time"]),
]
CHAPTERS = {
    "1. Critical Errors": ["Missing Title", "Missing Meta Description", "Missing H1 Heading", "HTTPS Security"],
    "3. Content Quality": [
        "Title Too Short", "Title Too Long", "Title Special Characters", "Meta Description Too Short", "Meta Description Too Long",
        "Viewport Missing Device Width", "Viewport Blocks User Scaling", "Multiple H1 Headings", "Heading Hierarchy Skip",
        "Duplicate Page Content", "Duplicate Page Title", "Duplicate Meta Description",
    ],
    "4. Images & Media": [
        "Missing Alt Text", "Image Missing Dimensions", "Images Not Next-Gen Format", "Images Missing Lazy Loading", "Broken Image",
    ],
    "5. Links & Navigation": [
        "Internal Nofollow Links", "Generic Anchor Text", "Empty Anchor Text", "Links Missing noopener", "Broken Link", "Orphan Pages",
    ],
    "6. Structured Data & Social": [
        "Schema Missing Required Properties", "Invalid JSON-LD", "Missing Open Graph Tags", "OG URL Invalid",
        "Missing Twitter Cards", "Missing Favicon",
    ],
    "7. Performance & Security": ["Slow Response Time", "High TTFB", "Large Page Size"],
}
FALLBACK_CHAPTER = "2. Technical SEO"
TOP_ISSUES = 15
TOP_CLUSTERS = 20
MIXED_ROWS = 50

# The order of findings as one number, (ord, seq) packed: a minimum over it stays in the hash aggregate, while
# one over a struct sorts every row. Sequence numbers stay below the base (catalog.RULE_STRIDE).
SEQ_BASE = 10**15
FIRST_SEEN = f"(cast(ord as decimal(22,0)) * cast({SEQ_BASE} as decimal(16,0)) + cast(seq as decimal(16,0)))"
# What stands before the order in some reports: a severity or site findings after page findings.
LEAD_BASE = 10**36


def led_by(lead: str) -> str:
    return f"cast(cast({lead} as decimal(1,0)) * cast({LEAD_BASE} as decimal(37,0)) + {FIRST_SEEN} as decimal(38,0))"


SEVERITIES = ("CRITICAL", "WARNING", "INFO")
_FIXED_ADVICE = " ".join(f"when {lit(name)} then {lit(advice)}" for name, (_, _, advice) in ISSUES.items() if "{}" not in advice)
_VARYING_ADVICE = [name for name, (_, _, advice) in ISSUES.items() if "{}" in advice]


def with_advice(groups: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds the recommendation of each group's first finding (`first_seen`): a fixed text by type, else read from that finding."""
    varying = issues.where(F.col("issue_type").isin(_VARYING_ADVICE)).selectExpr("site", f"{FIRST_SEEN} as first_seen", "recommendation as own")
    joined = groups.join(varying, ["site", "first_seen"], "left")
    return joined.withColumn("recommendation", F.expr(f"coalesce(own, case issue_type {_FIXED_ADVICE} end)")).drop("own")


def _count(cond: str, name: str) -> F.Column:
    return F.expr(f"count_if({cond})").alias(name)


def severity_aggs() -> list:
    return [
        F.count(F.lit(1)).alias("total"), _count("severity = 'CRITICAL'", "critical"),
        _count("severity = 'WARNING'", "warning"), _count("severity = 'INFO'", "info"),
    ]


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site").agg(*severity_aggs())


def _first_urls(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """First k URLs per group of rows (keys, url, at); ranks are cut on the map side before the shuffle."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("rn") <= k)
    return ranked.groupBy(*keys).agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(rn, url))), r -> r.url), '|')").alias("urls")
    )


def issue_clusters_html(issues: DataFrame) -> DataFrame:
    """Per type: severity and advice of the first finding, count, first five affected pages."""
    keys = ["site", "issue_type"]
    # Severity rides in the last digit of the order, so the minimum brings the first finding's own.
    seen = f"({FIRST_SEEN} * 10 + case severity when 'CRITICAL' then 0 when 'WARNING' then 1 else 2 end)"
    per_url = issues.groupBy(*keys, "url").agg(F.count(F.lit(1)).alias("c"), F.expr(f"min(cast({seen} as decimal(38,0)))").alias("at"))
    clusters = per_url.groupBy(*keys).agg(F.sum("c").alias("n_issues"), F.count(F.lit(1)).alias("n_urls"), F.min("at").alias("at"))
    clusters = clusters.selectExpr(
        *keys, "n_issues", "n_urls", "cast(floor(at / 10) as decimal(38,0)) as first_seen",
        f"element_at(array({lits(list(SEVERITIES))}), cast(at - floor(at / 10) * 10 as int) + 1) as severity",
    )
    order = Window.partitionBy("site").orderBy(F.expr(SEVERITY_ORDER), F.desc("n_issues"), "first_seen")
    urls = _first_urls(per_url.select(*keys, "url", "at"), keys, 5)
    return with_advice(clusters, issues).join(urls, keys).withColumn("rank", F.row_number().over(order)).drop("first_seen")


def issue_clusters_pdf(issues: DataFrame) -> DataFrame:
    """Per type: critical if any is, count, first ten URLs; the first twenty are the listed ones."""
    keys = ["site", "issue_type"]
    clusters = issues.groupBy(*keys).agg(
        F.expr("if(max(severity = 'CRITICAL'), 'CRITICAL', 'WARNING')").alias("severity"),
        F.count(F.lit(1)).alias("n_issues"), F.expr(f"min({FIRST_SEEN})").alias("first_seen"),
    )
    first = issues.selectExpr("site", f"{FIRST_SEEN} as first_seen", "description as sample_description")
    order = Window.partitionBy("site").orderBy(F.expr("severity <> 'CRITICAL'"), F.desc("n_issues"), "first_seen")
    ranked = clusters.withColumn("rank", F.row_number().over(order)).withColumn("listed", F.col("rank") <= TOP_CLUSTERS)
    ranked = ranked.join(first, ["site", "first_seen"])
    return ranked.join(_first_urls(issues.selectExpr(*keys, "url", f"{FIRST_SEEN} as at"), keys, 10), keys).drop("first_seen")


def issue_distribution(issues: DataFrame) -> DataFrame:
    counts = severity_counts(issues)
    return counts.selectExpr(
        "site", "critical", "warning", "total", "round(critical / total * 100, 1) as critical_pct", "round(warning / total * 100, 1) as warning_pct"
    )


def pages_with_issues(issues: DataFrame) -> DataFrame:
    return issues.select("site", "url").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages_with_issues"))


def executive_findings(issues: DataFrame, report: DataFrame) -> DataFrame:
    joined = report.select("site", "duplicate_contents", "orphans", "redirect_chains").join(severity_counts(issues), "site", "left")
    rows = [
        ("Critical Issues", "critical"), ("Warnings", "warning"), ("Duplicate Content Sets", "duplicate_contents"),
        ("Orphan Pages", "orphans"), ("Redirect Chains", "redirect_chains"),
    ]
    structs = ", ".join(f"named_struct('n', {i}, 'finding', {lit(t)}, 'amount', coalesce({c}, 0L))" for i, (t, c) in enumerate(rows, 1))
    return joined.selectExpr("site", f"inline(array({structs}))").where("amount > 0")


def top_issues(issues: DataFrame) -> DataFrame:
    """Fifteen (severity, type) groups per site; page findings count as seen before site findings."""
    keys = ["site", "severity", "issue_type"]
    per_url = issues.groupBy(*keys, "url").agg(F.count(F.lit(1)).alias("c"), F.expr(f"min({led_by('if(ord < 0, 1, 0)')})").alias("at"))
    groups = per_url.groupBy(*keys).agg(F.sum("c").alias("n_issues"), F.count(F.lit(1)).alias("n_pages"), F.min("at").alias("at"))
    plain = f"if(at > cast({LEAD_BASE // 2} as decimal(38,0)), at - cast({LEAD_BASE} as decimal(38,0)), at)"
    groups = with_advice(groups.withColumn("first_seen", F.expr(f"cast({plain} as decimal(38,0))")), issues).drop("first_seen").withColumnRenamed("at", "first_seen")
    order = Window.partitionBy("site").orderBy(F.expr(SEVERITY_ORDER), F.desc("n_issues"), "first_seen")
    return (
        groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_ISSUES)
        .selectExpr(
            "site", "rank", "severity", "issue_type", "n_issues", "n_pages",
            "if(length(recommendation) > 80, concat(left(recommendation, 80), '...'), recommendation) as recommendation",
        )
    )


def health_breakdown(report: DataFrame, advanced: DataFrame) -> DataFrame:
    joined = report.join(advanced.select("site", "security_issues", "thin_pages"), "site", "left")
    rows = [
        ("HTTPS Security", "https_pct"), ("robots.txt", "if(robots_txt_found, 100.0D, 0.0D)"),
        ("sitemap.xml", "if(sitemap_xml_found, 100.0D, 0.0D)"), ("Title Tags", "title_pct"),
        ("Meta Descriptions", "description_pct"), ("H1 Tags", "h1_pct"),
        ("Security Headers", "cast(greatest(0, 100 - security_issues * 10) as double)"),
        ("Content Quality", "cast(greatest(0, 100 - thin_pages * 20) as double)"),
    ]
    structs = ", ".join(f"named_struct('n', {i}, 'label', {lit(t)}, 'pct', round({e}, 4))" for i, (t, e) in enumerate(rows, 1))
    return joined.selectExpr("site", f"inline(array({structs}))")


def health_table(report: DataFrame) -> DataFrame:
    rows = [
        ("HTTPS Security", "https_pct", "if(https_pct = 100, 'Pass', 'Partial')"),
        *[(t, c, f"if({c} > 80, 'Good', 'Needs Work')") for t, c in [
            ("Title Tags", "title_pct"), ("Meta Descriptions", "description_pct"), ("H1 Headings", "h1_pct"), ("Canonical Tags", "canonical_pct")]],
    ]
    structs = ", ".join(
        f"named_struct('n', {i}, 'label', {lit(t)}, 'status', {s}, 'pct', round({c}, 4))" for i, (t, c, s) in enumerate(rows, 1)
    )
    return report.selectExpr("site", f"inline(array({structs}))")


def page_issue_counts(issues: DataFrame) -> DataFrame:
    return issues.where("ord >= 0").groupBy("site", "ord").agg(*severity_aggs())


def page_rows(page: DataFrame, issues: DataFrame, scores: DataFrame) -> DataFrame:
    return (
        page.select("site", "ord", "url", "status_code")
        .join(page_issue_counts(issues), ["site", "ord"], "left")
        .join(scores.select("site", "ord", "score"), ["site", "ord"])
        .selectExpr("site", "ord", "url", "status_code", "coalesce(critical, 0L) as critical", "coalesce(warning, 0L) as warning", "score")
    )


def chapter_expr() -> str:
    first = CHAPTERS["1. Critical Errors"]
    rest = " ".join(f"when issue_type in ({lits(v)}) then {lit(k)}" for k, v in CHAPTERS.items() if not k.startswith("1."))
    return f"case when severity = 'CRITICAL' or issue_type in ({lits(first)}) then '1. Critical Errors' {rest} else {lit(FALLBACK_CHAPTER)} end"


def report_chapters(issues: DataFrame) -> DataFrame:
    """Totals per chapter and section and per chapter; a null section is the chapter line."""
    per_url = issues.withColumn("chapter", F.expr(chapter_expr())).groupBy("site", "chapter", "issue_type", "url").agg(*severity_aggs())
    sums = [F.sum(c).alias(c) for c in ("total", "critical", "warning")]
    sections = per_url.groupBy("site", "chapter", "issue_type").agg(*sums, F.count(F.lit(1)).alias("pages"))
    chapter_pages = per_url.groupBy("site", "chapter", "url").agg(*sums)
    chapters = chapter_pages.groupBy("site", "chapter").agg(*sums, F.count(F.lit(1)).alias("pages"))
    return sections.withColumnRenamed("issue_type", "section").unionByName(chapters.withColumn("section", F.lit(None).cast("string")))


def status_buckets(page: DataFrame) -> DataFrame:
    return page.groupBy("site", F.expr("concat(cast(floor(status_code / 100) as string), 'xx')").alias("bucket")).agg(F.count(F.lit(1)).alias("pages"))


def status_distribution(page: DataFrame) -> DataFrame:
    return page.groupBy("site", "status_code").agg(F.count(F.lit(1)).alias("pages"))


def depth_distribution(page: DataFrame) -> DataFrame:
    return page.groupBy("site", "crawl_depth").agg(F.count(F.lit(1)).alias("pages"))


LINK_COUNTS = ["size(filter(links, x -> x.is_internal)) as n_internal", "size(links) as n_links"]


def link_overview(page: DataFrame) -> DataFrame:
    return page.selectExpr("site", *LINK_COUNTS).groupBy("site").agg(
        F.expr("sum(cast(n_internal as bigint))").alias("internal_links"),
        F.expr("sum(cast(n_links - n_internal as bigint))").alias("external_links"),
        F.expr("cast(floor(sum(cast(n_internal as bigint)) / count(1)) as bigint)").alias("avg_internal"),
        _count("n_internal > 0", "pages_with_links"), F.count(F.lit(1)).alias("pages"),
    )


def links_per_page_hist(page: DataFrame) -> DataFrame:
    label = "if(n_internal >= 20, '20+', cast(n_internal as string))"
    return page.selectExpr("site", *LINK_COUNTS).groupBy("site", F.expr(label).alias("bucket")).agg(F.count(F.lit(1)).alias("pages"))


def avg_page_score(scores: DataFrame) -> DataFrame:
    return scores.groupBy("site").agg(F.expr("cast(floor(sum(cast(score as bigint)) / count(1)) as bigint)").alias("avg_page_score"))


def section_scores(issues: DataFrame, sites: DataFrame) -> DataFrame:
    """Eight section scores per site; a finding may count in several sections."""
    structs = ", ".join(f"named_struct('n', {i}, 'section', {lit(s)}, 'words', {lit(any_word(w))})" for i, (s, w) in enumerate(SECTIONS, 1))
    names = ", ".join(f"named_struct('n', {i}, 'section', {lit(s)})" for i, (s, _) in enumerate(SECTIONS, 1))
    by_type = issues.groupBy("site", "issue_type").agg(*severity_aggs())
    hits = by_type.selectExpr(
        "site", "critical", "warning", "total", f"inline(filter(array({structs}), s -> lower(issue_type) rlike s.words))"
    ).groupBy("site", "section").agg(*[F.sum(c).alias(c) for c in ("critical", "warning", "total")])
    return (
        sites.select("site").distinct().selectExpr("site", f"inline(array({names}))")
        .join(hits, ["site", "section"], "left").na.fill(0, ["critical", "warning", "total"])
        .selectExpr("site", "n", "section", "critical", "warning", "total", "cast(greatest(0, 100 - 15 * critical - 5 * warning) as int) as score")
    )


def technical_checklist(report: DataFrame) -> DataFrame:
    rows = [
        ("HTTPS", "https_pct = 100"), ("robots.txt", "robots_txt_found"), ("sitemap.xml", "sitemap_xml_found"),
        ("Viewport Meta", "pages_with_viewport > 0"), ("Lang Attribute", "pages_with_lang > 0"),
        ("Favicon", "pages_with_favicon > 0"), ("No Redirect Chains", "redirect_chains = 0"),
    ]
    structs = ", ".join(f"named_struct('n', {i}, 'check', {lit(t)}, 'passed', coalesce({e}, false))" for i, (t, e) in enumerate(rows, 1))
    return report.selectExpr("site", f"inline(array({structs}))")


def pages_overview(page: DataFrame, issues: DataFrame, scores: DataFrame, url_filter: str = "") -> DataFrame:
    rows = (
        page.selectExpr("site", "ord", "url", "status_code", "if(is_https, 'HTTPS', 'HTTP') as protocol", f"{redirect_display()} as redirects")
        .join(page_issue_counts(issues).select("site", "ord", F.col("total").alias("n")), ["site", "ord"], "left")
        .join(scores.select("site", "ord", "score"), ["site", "ord"])
        .selectExpr("site", "ord", "url", "status_code", "protocol", "score", "coalesce(n, 0L) as n_issues", "redirects")
    )
    return rows.where(F.lower("url").contains(url_filter.lower())) if url_filter else rows


def http_error_summary(page: DataFrame, issues: DataFrame) -> DataFrame:
    names = " ".join(f"when {code} then {lit(name)}" for code, name in STATUS_NAMES.items())
    classes = " ".join(f"when {d} then {lit(name)}" for d, name in STATUS_CLASS.items())
    statuses = status_distribution(page).where(f"status_code in ({', '.join(map(str, STATUS_NAMES))})").selectExpr(
        "site", f"case status_code {names} end as http_status", "pages as amount",
        f"case cast(floor(status_code / 100) as int) {classes} end as severity",
    )
    found = issues.where(f"ord >= 0 and severity in ('CRITICAL', 'WARNING') and issue_type in ({lits(HTTP_ISSUES)})").groupBy("site", "issue_type").agg(
        F.count(F.lit(1)).alias("amount"), F.expr(f"min(cast({FIRST_SEEN} * 10 + if(severity = 'CRITICAL', 0, 1) as decimal(38,0)))").alias("at")
    ).selectExpr("site", "issue_type as http_status", "amount", "if(at - floor(at / 10) * 10 = 0, 'CRITICAL', 'WARNING') as severity")
    return statuses.unionByName(found)


def http_error_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("site").agg(F.expr("coalesce(sum(if(severity in ('Error', 'Critical'), amount, 0L)), 0L)").alias("total_errors"))


def error_pages(page: DataFrame, issues: DataFrame, scores: DataFrame) -> DataFrame:
    return pages_overview(page.where("status_code >= 400"), issues, scores).select("site", "ord", "url", "status_code", "n_issues", "score")


def of_types(issues: DataFrame, types: list[str]) -> DataFrame:
    return issues.where(F.col("issue_type").isin(types))


def technical_issues(issues: DataFrame) -> DataFrame:
    return of_types(issues, TECHNICAL_TYPES).select("site", "ord", "seq", "url", "severity", "issue_type", "description", "recommendation")


def technical_issue_counts(issues: DataFrame) -> DataFrame:
    return severity_counts(of_types(issues, TECHNICAL_TYPES))


def content_issues(page: DataFrame, issues: DataFrame) -> DataFrame:
    """Pages with title, description or main-heading findings and their current values."""
    counts = of_types(issues, CONTENT_TYPES).groupBy("site", "ord").agg(F.count(F.lit(1)).alias("n_issues"))
    h1 = "get(filter(headings, h -> h.level = 1), 0).text"
    values = page.selectExpr(
        "site", "ord", "url", "coalesce(nullif(title, ''), 'MISSING') as title", "coalesce(length(title), 0) as title_length",
        "if(coalesce(meta_description, '') = '', 'MISSING', concat(left(meta_description, 80), '...')) as description",
        "coalesce(length(meta_description), 0) as description_length",
        f"coalesce({h1}, 'MISSING') as h1", f"coalesce(length({h1}), 0) as h1_length",
    )
    return values.join(counts, ["site", "ord"])


def page_perf(page: DataFrame) -> DataFrame:
    return page.selectExpr(
        "site", "ord", "url", "coalesce(length(title), 0) + coalesce(length(meta_description), 0) + 500 as document_length",
        "if(favicon_url is not null, 'Configured', 'Missing') as favicon_status",
    )


def schema_inventory(page: DataFrame) -> DataFrame:
    return page.selectExpr("site", "ord", "url", "inline(json_ld)").selectExpr(
        "site", "ord", "url", "n", "if(valid, coalesce(schema_type, 'Unknown'), null) as schema_type", "valid", "error"
    )


def schema_summary(page: DataFrame) -> DataFrame:
    per_type = schema_inventory(page).groupBy("site", "schema_type").agg(
        F.count(F.lit(1)).alias("blocks"), _count("valid", "valid"), _count("not valid", "errors")
    )
    return per_type.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("blocks", "valid", "errors")], F.count("schema_type").alias("types"))


def mixed_content_table(mixed: DataFrame, rows: int = MIXED_ROWS) -> DataFrame:
    """The first `rows` insecure resources of each site, for display; `mixed` is the whole list."""
    order = Window.partitionBy("site").orderBy("ord", "n")
    return mixed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)


def redirect_table(chains: DataFrame) -> DataFrame:
    return chains.selectExpr("site", "ord", "original_url", "total_redirects", "is_too_long", "posexplode(chain) as (hop, hop_url)")


def technical_summary(report: DataFrame) -> DataFrame:
    return report.select("site", "orphans", "duplicate_titles", "duplicate_descriptions", "duplicate_contents", "redirect_chains")


def issue_summary(issues: DataFrame) -> DataFrame:
    grouped = issues.groupBy("site", "issue_type").agg(
        F.count(F.lit(1)).alias("n_issues"), F.expr("if(max(severity = 'CRITICAL'), 'CRITICAL', 'WARNING')").alias("severity"),
        F.expr(f"min({SEVERITY_ORDER})").alias("worst"),
    ).selectExpr("site", "issue_type", "n_issues", "severity", f"element_at(array({lits(list(SEVERITIES))}), worst + 1) as max_severity")
    order = Window.partitionBy("site").orderBy(F.expr("severity <> 'CRITICAL'"), "issue_type")
    return grouped.withColumn("rank", F.row_number().over(order))


def score_label(score: str) -> str:
    return f"case when {score} >= 90 then 'Excellent' when {score} >= 70 then 'Satisfactory' else 'Needs Immediate Remediation' end"


def score_indicator(score: str) -> str:
    return f"case when {score} >= 80 then 'Excellent' when {score} >= 60 then 'Good' when {score} >= 40 then 'Needs Work' else 'Poor' end"


def priority_actions(issues: DataFrame, report: DataFrame) -> DataFrame:
    joined = report.select("site", "robots_txt_found", "sitemap_xml_found").join(severity_counts(issues), "site", "left")
    rows = [
        ("Fix critical issues first", "coalesce(critical, 0L)"), ("Fix warnings next", "coalesce(warning, 0L)"),
        ("Create robots.txt", "if(robots_txt_found, 0L, 1L)"), ("Create sitemap.xml", "if(sitemap_xml_found, 0L, 1L)"),
    ]
    structs = ", ".join(f"named_struct('n', {i}, 'action', {lit(t)}, 'amount', {e})" for i, (t, e) in enumerate(rows, 1))
    return joined.selectExpr("site", f"inline(array({structs}))").where("amount > 0")


def fix_plan(issues: DataFrame) -> DataFrame:
    """Types by worst severity, then first occurrence; first five pages of each."""
    keys = ["site", "issue_type"]
    at = led_by(SEVERITY_ORDER)
    groups = issues.groupBy(*keys).agg(F.expr(f"min({at})").alias("first_seen"), F.count(F.lit(1)).alias("n_issues"))
    # The severity leads the order; the half keeps site findings, whose order is below zero, in their place.
    worst = f"cast(floor((first_seen + cast({LEAD_BASE // 2} as decimal(38,0))) / cast({LEAD_BASE} as decimal(38,0))) as int)"
    groups = groups.withColumn("severity", F.expr(f"element_at(array({lits(list(SEVERITIES))}), {worst} + 1)"))
    order = Window.partitionBy("site").orderBy("first_seen")
    plan = groups.withColumn("priority", F.row_number().over(order)).drop("first_seen")
    urls = _first_urls(issues.selectExpr(*keys, "url", f"{at} as at"), keys, 5)
    return plan.join(urls, keys)
