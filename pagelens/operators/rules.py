"""Page rules: one projection over `page`, one row per finding, no join and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagelens.functions.arrays import STRINGS, count_where, fill, first_where, lit, present
from pagelens.operators.catalog import ISSUES, JS, JS_NOTE, RULE_NUMBER, RULE_STRIDE

ISSUE_COLUMNS = [
    "site", "ord", "seq", "url", "severity", "issue_type", "description", "html_snippet", "loc_tag", "loc_n", "recommendation",
]


def finding(issue: str, *slots: str, snippet: str = "null", loc: tuple[str, str] | None = None,
            severity: str | None = None, k: str = "0", rec_slots: tuple[str, ...] = ()) -> str:
    """The struct of one finding, with its fixed texts filled in."""
    level, text, advice = ISSUES[issue]
    if level == JS:
        severity = "if(is_js_rendered, 'WARNING', 'CRITICAL')"
        slots = (f"if(is_js_rendered, {lit(JS_NOTE)}, '')",)
    tag, n = loc or (None, "null")
    return (
        f"named_struct('seq', cast({RULE_NUMBER[issue] * RULE_STRIDE} + {k} as bigint), "
        f"'severity', {severity or lit(level)}, 'issue_type', {lit(issue)}, "
        f"'description', {fill(text, *slots)}, 'html_snippet', cast({snippet} as string), "
        f"'loc_tag', {lit(tag) if tag else 'cast(null as string)'}, 'loc_n', cast({n} as int), "
        f"'recommendation', {fill(advice, *rec_slots)})"
    )


def when(cond: str, issue: str, *slots: str, **kw) -> tuple[str, str, str]:
    """A rule with at most one finding per page."""
    return issue, "one", f"if({cond}, {finding(issue, *slots, **kw)}, null)"


def each(arr: str, issue: str, *slots: str, **kw) -> tuple[str, str, str]:
    """A rule with one finding per element (x) of an array."""
    return issue, "many", f"transform({arr}, (x, i) -> {finding(issue, *slots, k='i', **kw)})"


def missing_keys(map_col: str, keys: list[str]) -> str:
    names = ", ".join(lit(k) for k in keys)
    return f"array_except(array({names}), coalesce(map_keys({map_col}), {STRINGS}))"


def whole(e: str) -> str:
    """A number as a whole-number text, half rounded to even."""
    return f"cast(cast(bround({e}, 0) as bigint) as string)"


TITLE_LENGTH = "length(title)"
DESC_LENGTH = "length(meta_description)"
MISMATCH = "rtrim('/', canonical_url) <> rtrim('/', url)"
SKIP = "filter(zip_with(headings, slice(headings, 2, greatest(size(headings) - 1, 0)), (a, b) -> named_struct('a', a.level, 'b', b.level)), h -> h.b > h.a + 1)"
MISSING_OG = missing_keys("open_graph", ["og:title", "og:description", "og:image"])
MISSING_TWITTER = missing_keys("twitter_cards", ["twitter:card", "twitter:title"])
SPECIAL = "array_distinct(slice(regexp_extract_all(title, '([^\\\\x00-\\\\x7F])', 1), 1, 5))"
KNOWN_FORMAT = "x.format is not null"
LEGACY_FORMAT = "x.format is not null and not x.is_next_gen_format"
NOT_LAZY = f"not x.is_lazy_loaded and not {present('x.fetchpriority')}"


def rules() -> list[tuple[str, str, str]]:
    """(issue type, one|many, expression) of every page rule in evaluation order."""
    title_at = {"snippet": "title_html", "loc": ("title", "1")}
    desc_at = {"snippet": "meta_desc_html", "loc": ("meta", "meta_desc_n")}
    canonical_at = {"snippet": "canonical_html", "loc": ("link", "canonical_n")}
    has_title, has_desc = present("title"), present("meta_description")
    one_canonical = f"not multiple_canonicals and {present('canonical_url')}"
    no_size = f"not {present('x.width')} or not {present('x.height')}"
    nofollow = count_where("links", "x.is_nofollow and x.is_internal")
    generic = count_where("links", "x.anchor_text_type = 'generic'")
    empty = count_where("links", "x.text = '[Empty Anchor Text]'")
    unsafe = count_where("links", f"x.target = '_blank' and {present('x.rel')} and not contains(x.rel, 'noopener')")
    legacy = count_where("images", LEGACY_FORMAT)
    not_lazy = count_where("images", NOT_LAZY)
    head = [
        when("not is_https", "HTTPS Security"),
        when(f"not {has_title}", "Missing Title"),
        when(f"{has_title} and {TITLE_LENGTH} < 10", "Title Too Short", TITLE_LENGTH, **title_at),
        when(f"{TITLE_LENGTH} > 65", "Title Too Long", TITLE_LENGTH, **title_at),
        when(f"size({SPECIAL}) > 0", "Title Special Characters", f"array_join({SPECIAL}, '')", snippet="title_html"),
        when(f"not {has_desc}", "Missing Meta Description"),
        when(f"{has_desc} and {DESC_LENGTH} < 50", "Meta Description Too Short", DESC_LENGTH, **desc_at),
        when(f"{DESC_LENGTH} > 160", "Meta Description Too Long", DESC_LENGTH, **desc_at),
        when("multiple_canonicals", "Multiple Canonical Tags", snippet="canonical_html"),
        when(f"not multiple_canonicals and not {present('canonical_url')}", "Missing Canonical URL"),
        when(f"{one_canonical} and canonical_is_relative", "Canonical Relative URL", snippet="canonical_html"),
        when(f"{one_canonical} and {MISMATCH}", "Canonical Mismatch", "canonical_url", **canonical_at),
        when(f"{one_canonical} and not is_https and startswith(canonical_url, 'https://')", "Canonical Protocol Mismatch"),
        when("viewport is null", "Missing Viewport Tag"),
        when("viewport is not null and not viewport_has_device_width", "Viewport Missing Device Width"),
        when("viewport is not null and not viewport_allows_scaling", "Viewport Blocks User Scaling"),
        when("lang is null", "Missing Lang Attribute"),
        when("h1_count = 0", "Missing H1 Heading"),
        when("h1_count > 1", "Multiple H1 Headings", "h1_count"),
        when(f"size({SKIP}) > 0", "Heading Hierarchy Skip", f"get({SKIP}, 0).a", f"get({SKIP}, 0).b"),
        when("is_js_rendered", "JavaScript Rendered Page"),
        when("favicon_url is null", "Missing Favicon"),
        when(f"size({MISSING_OG}) > 0", "Missing Open Graph Tags", f"array_join({MISSING_OG}, ', ')"),
        when("not open_graph['og:url'] rlike '^https?://'", "OG URL Invalid", "open_graph['og:url']"),
        when(f"size({MISSING_TWITTER}) > 0", "Missing Twitter Cards", f"array_join({MISSING_TWITTER}, ', ')"),
    ]
    missing_props = "array_join(x.required_missing, ', ')"
    block_at = {"snippet": "x.html_snippet"}
    body = [
        when(f"exists(images, x -> {no_size})", "Image Missing Dimensions",
             f"left({first_where('images', no_size)}.src, 80)", snippet=f"{first_where('images', no_size)}.html_snippet"),
        when(f"{legacy} > 0 and {legacy} = {count_where('images', KNOWN_FORMAT)}", "Images Not Next-Gen Format", legacy),
        when(f"{not_lazy} > 3", "Images Missing Lazy Loading", not_lazy),
        when(f"{nofollow} > 0", "Internal Nofollow Links", nofollow),
        when(f"{generic} > 0", "Generic Anchor Text", generic),
        when(f"{empty} > 0", "Empty Anchor Text", empty),
        when(f"{unsafe} > 0", "Links Missing noopener", unsafe),
        when("indexability.noindex_source is not null", "Noindex Detected", "indexability.noindex_source"),
        when("indexability.nofollow", "Nofollow Directive Detected"),
        when("indexability.nosnippet", "Nosnippet Detected"),
        when("pagination_next is not null or pagination_prev is not null", "Pagination Detected",
             "if(pagination_next is not null, 'True', 'False')", "if(pagination_prev is not null, 'True', 'False')"),
        when("amp_url is not null", "AMP Page Detected", "amp_url"),
        when("has_redirect_loop", "Redirect Loop"),
        when("size(redirect_history) > 3", "Too Many Redirects", "size(redirect_history)"),
        when("is_soft_404", "Soft 404 Detected"),
        when("status_code >= 500", "Server Error", "status_code"),
        when("status_code = 404", "Page Not Found"),
        when("status_code = 403", "Access Forbidden"),
        when("total_ms > 3000", "Slow Response Time", whole("total_ms")),
        when("not coalesce(total_ms > 3000, false) and ttfb_ms > 1000", "High TTFB", whole("ttfb_ms")),
        when("html_size_bytes > 1048576", "Large Page Size", whole("html_size_bytes / 1024D")),
        when("crawl_depth > 3", "Deep Page Depth", "crawl_depth"),
    ]
    return [
        *head,
        each("filter(json_ld, x -> not x.valid)", "Invalid JSON-LD", "x.error", loc=("script", "x.n"), **block_at),
        each("filter(json_ld, x -> x.valid and size(x.required_missing) > 0)", "Schema Missing Required Properties",
             "x.schema_type", missing_props, rec_slots=(missing_props,), **block_at),
        each("filter(images, x -> x.is_missing_alt)", "Missing Alt Text", "left(x.src, 100)", loc=("img", "x.n"), **block_at),
        *body,
    ]


def page_issues(page: DataFrame, only: str | None = None) -> DataFrame:
    """Findings of the page rules; `seq` orders them within a page as the rules are listed.

    Rules with one finding share an array, the others are arrays of their own, so the projection
    is a handful of expressions. `only` keeps one rule and evaluates nothing else.
    """
    chosen = [r for r in rules() if only in (None, r[0])]
    ones = [e for _, kind, e in chosen if kind == "one"]
    arrays = [f"array_compact(array({', '.join(ones)}))"] if ones else []
    arrays += [e for _, kind, e in chosen if kind == "many"]
    merged = arrays[0] if len(arrays) == 1 else f"concat({', '.join(arrays)})"
    found = page.selectExpr("site", "ord", "url", f"explode({merged}) as f")
    return found.selectExpr("site", "ord", "f.seq as seq", "url", *[f"f.{c}" for c in ISSUE_COLUMNS[4:]])


SCORE_PENALTIES = [
    "if(is_https, 0, 10)",
    f"case when not {present('title')} then if(is_js_rendered, 7, 15) when {TITLE_LENGTH} < 10 then 7 when {TITLE_LENGTH} > 65 then 5 else 0 end",
    f"case when not {present('meta_description')} then if(is_js_rendered, 7, 15) when {DESC_LENGTH} < 50 then 5 when {DESC_LENGTH} > 160 then 3 else 0 end",
    f"case when multiple_canonicals then 10 when not {present('canonical_url')} then 10 when {MISMATCH} then 5 else 0 end",
    "if(viewport is null, 10, 0)",
    "if(lang is null, 5, 0)",
    "case when h1_count = 0 then if(is_js_rendered, 5, 10) when h1_count > 1 then 5 else 0 end",
    f"if(size({MISSING_OG}) > 0, 3, 0)",
    "if(exists(json_ld, b -> not b.valid), 5, 0)",
    f"least(10, 2 * {count_where('images', 'x.is_missing_alt')})",
    "if(is_soft_404, 20, 0)",
    "if(has_redirect_loop, 15, 0)",
    "if(size(redirect_history) > 3, 5, 0)",
    "if(coalesce(total_ms, 0) > 3000, 5, 0)",
    "if(html_size_bytes > 1048576, 5, 0)",
    "if(crawl_depth > 3, 3, 0)",
]


def page_penalty() -> str:
    """Points lost on the page itself, before the two site-wide robots and sitemap penalties."""
    return "(" + " + ".join(SCORE_PENALTIES) + ")"
