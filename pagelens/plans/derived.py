"""A full crawl snapshot derived row by row from the `pages` table.

`pages` holds only url and html. Every page of it becomes one crawl row: head and body markup,
status, headers, redirects, timings and depth are computed from `page_id` and `url` with the
plain SQL below, which Spark and the checking engine both read. Work grows with `pages`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.urls import get_domain
from pagelens.session import spread


def _case(modulus: int, cases: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items())
    return f"(CASE page_id % {modulus} {whens} ELSE '' END)"


DESCRIPTION = _case(5, {
    1: "'<meta name=\"description\" content=\"Short text ' || page_id || '\">'",
    2: "'<META NAME=''Description'' CONTENT='' How to read the guide &amp; learn about page number ' || page_id % 2 || ' of this site today ''/>'",
    3: "'<meta content=\"' || repeat('A long description that goes on. ', 6) || page_id % 3 || '\" name=description>'",
    4: "'<meta property=\"og:description\" content=\"Discover the page called ' || page_id || ' and what it has to offer to all readers\">'",
})
CANONICAL = _case(6, {
    1: "'<link rel=\"canonical\" href=\"' || url || '\">'",
    2: "'<link href=''/primary-page'' rel=''Canonical''>'",
    3: "'<link rel=\"canonical\" href=\"' || replace(url, 'http://', 'https://') || '\">'",
    4: "'<link rel=\"canonical\" href=\"' || url || '\"><link rel=\"canonical\" href=\"/other\">'",
    5: "'<link rel=\"canonical\" href=\"../up/' || page_id || '/\">'",
})
VIEWPORT = _case(4, {
    1: "'<meta name=\"viewport\" content=\"width=device-width, initial-scale=1.0\">'",
    2: "'<meta name=\"viewport\" content=\"width=1024, user-scalable=no\">'",
    3: "'<meta name=\"Viewport\" content=\"width=device-width, maximum-scale=10\">'",
})
OPEN_GRAPH = _case(3, {
    1: "'<meta property=\"og:title\" content=\"First\"><meta property=\"og:title\" content=\"Shared title ' || page_id || '\"><meta property=\"og:image\" content=\"/i.png\"><meta property=\"og:url\" content=\"/relative/' || page_id || '\">'",
    2: "'<meta property=\"OG:Title\" content=\"Shared ' || page_id || '\"><meta name=\"og:description\" content=\" Shared description \"><meta property=\"og:image\" content=\"https://cdn.example.org/i.png\">'",
})
TWITTER = _case(4, {
    1: "'<meta name=\"twitter:card\" content=\"summary\"><meta property=\"twitter:title\" content=\"T ' || page_id || '\">'",
    2: "'<meta name=\"twitter:card\" content=\"summary_large_image\">'",
})
ICON = _case(2, {1: "'<link rel=\"shortcut icon\" href=\"/favicon.ico\">'"})
ROBOTS_META = _case(10, {
    3: "'<meta name=\"robots\" content=\"noindex, nofollow\">'",
    7: "'<meta name=\"robots\" content=\"max-snippet:50, NoSnippet, max-image-preview: large\">'",
})
HREFLANG = _case(7, {
    2: "'<link rel=\"alternate\" hreflang=\"en-US\" href=\"' || url || '\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"/\"><link rel=\"alternate\" hreflang=\"fr\" href=\"/fr/' || page_id || '\">'",
})
PAGING = _case(9, {
    4: "'<link rel=\"next\" href=\"?page=' || (page_id + 1) || '\">'",
    5: "'<link rel=\"prev\" href=\"/list/' || page_id || '\"><link rel=\"next\" href=\"/list/n' || page_id || '\">'",
})
AMP = _case(11, {5: "'<link rel=\"amphtml\" href=\"/amp/' || page_id || '\">'"})
HTTP_EQUIV = _case(13, {
    6: "'<meta http-equiv=\"refresh\" content=\"5; url=/moved/' || page_id || '\">'",
    7: "'<meta http-equiv=\"Content-Language\" content=\"en\">'",
})
JSON_LD = _case(8, {
    1: "'<script type=\"application/ld+json\">{\"@context\":\"https://schema.org\",\"@type\":\"Article\",\"headline\":\"Page ' || page_id || '\"}</script>'",
    2: "'<script type=\"application/ld+json\">{\"@context\":\"https://schema.org\",\"@type\":\"FAQPage\",\"@id\":\"#faq' || page_id || '\",\"mainEntity\":[{\"@type\":\"Question\",\"name\":\"Q\",\"acceptedAnswer\":{\"@type\":\"Answer\",\"text\":\"A\"}},{\"@type\":\"Thing\"}]}</script>'",
    3: "'<script type=\"application/ld+json\">{ invalid json here }</script>'",
    4: "'<script type=\"application/ld+json\"> {\"@context\":\"https://schema.org\",\"@type\":\"Product\",\"name\":\"P' || page_id || '\",\"image\":\"/p.png\",\"description\":\"d\"} </script><script type=\"application/ld+json\">{\"@type\":\"Organization\",\"url\":\"/\"}</script>'",
    5: "'<script type=\"application/ld+json\">[{\"@type\":\"WebSite\",\"name\":\"n\"},{\"@type\":\"HowTo\"}]</script>'",
    6: "'<script type=\"application/ld+json\">{\"@context\":\"http://example.org\",\"@type\":\"NewsArticle\",\"headline\":\"h\",\"image\":\"i\",\"author\":\"a\"}</script>'",
    7: "'<script type=\"application/ld+json\">{\"@context\":\"https://schema.org\",\"@type\":\"BreadcrumbList\",\"itemListElement\":[{\"name\":\"Home\",\"position\":1},{\"position\":2},{\"name\":\"x\"}]}</script>'",
})
SCRIPT_STATE = _case(100, {
    9: "'<script>window.__NEXT_DATA__ = {\"props\":{\"pageProps\":{\"title\":\"State title ' || page_id || '\",\"description\":\"A description kept in page state only\"}}};</script>'",
    34: "'<script>window.__NUXT__ = {\"head\":{\"title\":\"Nuxt head ' || page_id || '\"}};</script>'",
    51: "'<script>window.__INITIAL_STATE__ = {\"app\":[{\"id\":1},{\"view\":{\"title\":\"Initial title ' || page_id || '\",\"desc\":\"An initial description kept in state\"}}]};</script>'",
    72: "'<script>window.__APP_DATA__ = {\"a\":{\"b\":{\"c\":{\"d\":{\"e\":{\"title\":\"Deep title ' || page_id || '\",\"description\":\"A description that is five levels down\"}}}}}};</script>'",
    88: "'<script>window.__APP_DATA__ = {\"a\":{\"b\":{\"c\":{\"d\":{\"e\":{\"f\":{\"title\":\"Too deep ' || page_id || '\"}}}}}}};</script>'",
})
SOFT_404 = _case(29, {13: "'<meta name=\"keywords\" content=\"Page  Not Found\">'"})

HEADINGS = _case(5, {
    1: "'<h2>What is page ' || page_id || '?</h2><h3>Details <b>here</b></h3>'",
    2: "'<h3>Skipped &amp; level, caf&eacute; &times; &#38;lt; &#xE9;&#233; &iacute;&copy &unknown; a&b</h3>'",
    3: "'<h1>Second main heading</h1><h2> </h2>'",
    4: "'<h2>How to start</h2><h3>Where to go</h3><h4>Which one</h4>'",
})
LINKS = _case(4, {
    1: "'<div class=\"Side-Bar box\"><a href=\"https://other.example.net/x?u=' || page_id || '\" rel=\"nofollow sponsored\" target=\"_blank\">Other site</a></div><a href=\"/more\">Click here</a><a href=\"/img' || page_id || '\"><img src=\"/b.gif\" alt=\"Banner text\"></a><a href=\"mailto:a@b.c\">mail</a><a href=\"#top\">top</a>'",
    2: "'<aside><a href=sub/page.html>2024</a><a href=\"../up\">https://naked.example</a><a href=\"?page=2\" target=\"_blank\">paged</a></aside><a href=\"/dup/' || page_id || '#one\">one</a><a href=\"/dup/' || page_id || '#two\">two</a><a href=\"/nf\" rel=\"NoFollow\">No follow</a>'",
    3: "'<section class=menu><a href=\"//cdn.example.com/lib\">protocol</a></section><a href=\"/empty\"></a><a href=\"http://sub.' || regexp_extract(url, '//([^/?#]*)', 1) || '/s\">sub domain</a><a href=\" javascript:void(0) \">js</a><a href=\"' || url || '\" rel=\"ugc noopener\" target=\"_blank\">self</a>'",
})
IMAGES = _case(3, {
    1: "'<img src=\"/photo' || page_id || '.jpg?v=1\">'",
    2: "'<img src=\"hero.webp\" alt=\"Hero\" width=\"10\" height=\"10\" fetchpriority=\"high\"><img data-src=\"/lazy.png\" alt=\" \" width=5 height=5><img src=\"/c.svg\" alt=\"c\" loading=\"lazy\"><img src=\"/d.tif\" alt=\"d\"><img src=\"/e\" alt=''e > f''><img src=\"/f.JPG#x\" alt=\"f\"><img src=\"http://img.example.com/g.bmp\" alt=\"g\">'",
})
MIXED = _case(6, {
    5: "'<form action=\"http://forms.example.com/' || page_id || '\"></form><p style=\"background:url(http://css.example.com/a.png)\">x</p>'",
})
# What the opening title tag becomes: gone, long, or one title that many pages share.
_COMMON = "'<title>Common page</title><span>'"
TITLE_START = (
    "(CASE page_id % 25 WHEN 9 THEN '<notitle>' WHEN 11 THEN '<title>A title that is made much longer than sixty five characters by this prefix ' "
    f"WHEN 2 THEN {_COMMON} WHEN 7 THEN {_COMMON} WHEN 12 THEN {_COMMON} WHEN 17 THEN {_COMMON} WHEN 22 THEN {_COMMON} ELSE '<title>' END)"
)
HTML_START = "(CASE page_id % 31 WHEN 30 THEN '<html data-l=' ELSE '<html lang=' END)"
H1_START = "(CASE page_id % 23 WHEN 22 THEN '<h5>' ELSE '<h1>' END)"

DERIVED_COLUMNS = {
    "ord": "page_id",
    "site": "regexp_extract(url, '//([^/?#]*)', 1)",
    "url": "url",
    "html": (
        f"replace(replace(replace(replace(replace(html, '<title>', {TITLE_START}), '<html lang=', {HTML_START}), '<h1>', {H1_START}), '</head>', "
        + " || ".join([DESCRIPTION, CANONICAL, VIEWPORT, OPEN_GRAPH, TWITTER, ICON, ROBOTS_META, HREFLANG,
                       PAGING, AMP, HTTP_EQUIV, JSON_LD, SCRIPT_STATE, SOFT_404])
        + " || '</head>'), '<footer>', "
        + " || ".join([HEADINGS, LINKS, IMAGES, MIXED]) + " || '<footer>')"
    ),
    "status_code": "CASE page_id % 20 WHEN 3 THEN 404 WHEN 7 THEN 500 WHEN 11 THEN 403 WHEN 13 THEN 301 ELSE 200 END",
    "h_type": "CASE page_id % 40 WHEN 39 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END",
    "h_length": "CASE page_id % 50 WHEN 49 THEN '99999999' END",
    "h_hsts": "CASE page_id % 2 WHEN 0 THEN 'max-age=31536000' END",
    "h_csp": "CASE page_id % 3 WHEN 0 THEN 'default-src *' END",
    "h_nosniff": "CASE page_id % 4 WHEN 0 THEN 'nosniff' END",
    "h_frame": "CASE page_id % 5 WHEN 0 THEN 'DENY' WHEN 1 THEN '' END",
    "h_referrer": "CASE page_id % 7 WHEN 0 THEN 'no-referrer' END",
    "h_robots": "CASE page_id % 30 WHEN 17 THEN 'noindex, nosnippet' END",
    "hist": (
        "CASE page_id % 16 WHEN 5 THEN url || '?old=1' WHEN 6 THEN url || '?a|' || url || '?b|' || url || '?c|' || url || '?d' "
        "WHEN 7 THEN url || '?x|' || url END"
    ),
    "hist_codes": "CASE page_id % 16 WHEN 5 THEN '301' WHEN 6 THEN '301|302|302|308' WHEN 7 THEN '302' END",
    "total_ms": "CASE WHEN page_id % 17 = 16 THEN NULL ELSE (page_id * 37) % 4000 + 0.5 END",
    "ttfb_ms": "CASE WHEN page_id % 17 = 16 THEN NULL ELSE (page_id * 13) % 1500 + 0.25 END",
    "crawl_depth": "page_id % 6",
}


def derived_select() -> list[str]:
    """The derivation as select expressions over `pages`, the same for both engines."""
    return [f"{v} AS {k}" for k, v in DERIVED_COLUMNS.items()]


def crawl_from_pages(pages: DataFrame) -> DataFrame:
    """Adapter for a plain (page_id, url, html) table: successful fetches with no headers."""
    return pages.select(
        F.expr(get_domain("url")).alias("site"),
        F.col("page_id").alias("ord"),
        "url",
        F.col("url").alias("final_url"),
        "html",
        F.lit(200).alias("status_code"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.array().cast("array<string>").alias("redirect_history"),
        F.array().cast("array<int>").alias("redirect_status_codes"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("double").alias("ttfb_ms"),
        F.lit(None).cast("double").alias("total_ms"),
        F.octet_length("html").cast("bigint").alias("html_size_bytes"),
        F.lit(None).cast("bigint").alias("compressed_size"),
        F.lit(0).alias("crawl_depth"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )


def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def derive_crawl(pages: DataFrame) -> DataFrame:
    """The derived crawl in the CRAWL contract. One projection, for batches and streams alike."""
    raw = pages.selectExpr(*derived_select())
    headers = {
        "Content-Type": "h_type", "Content-Length": "h_length", "strict-transport-security": "h_hsts",
        "Content-Security-Policy": "h_csp", "X-CONTENT-TYPE-OPTIONS": "h_nosniff", "x-frame-options": "h_frame",
        "Referrer-Policy": "h_referrer", "X-Robots-Tag": "h_robots",
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in headers.items()])
    size = F.octet_length("html").cast("bigint")
    return raw.select(
        "site",
        F.col("ord").cast("bigint").alias("ord"),
        "url",
        F.col("url").alias("final_url"),
        "html",
        "status_code",
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("headers"),
        F.coalesce(F.split("hist", r"\|"), F.array().cast("array<string>")).alias("redirect_history"),
        F.coalesce(F.split("hist_codes", r"\|").cast("array<int>"), F.array().cast("array<int>")).alias("redirect_status_codes"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("ttfb_ms").cast("double").alias("ttfb_ms"),
        F.col("total_ms").cast("double").alias("total_ms"),
        size.alias("html_size_bytes"),
        F.when(F.col("ord") % 3 != 0, F.floor(size / 4)).cast("bigint").alias("compressed_size"),
        F.col("crawl_depth").cast("int").alias("crawl_depth"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("ord")).alias("fetched_at"),
    )


SITE_OF = "regexp_extract(url, '//([^/?#]*)', 1)"

# One sitemap entry per page: every fourth names a page that was not crawled.
SITEMAP_COLUMNS = [
    f"{SITE_OF} AS site", "page_id AS ord",
    f"CASE WHEN page_id % 4 = 0 THEN 'https://' || {SITE_OF} || '/orphan/' || page_id ELSE url END AS loc",
    "CASE WHEN page_id % 3 = 0 THEN '2024-01-0' || (page_id % 9 + 1) END AS lastmod",
]
# One stored sitemap document per page, and every seventh an index naming the next one.
SITEMAP_DOCUMENT_COLUMNS = [
    f"'https://' || {SITE_OF} || '/sitemap-' || page_id || '.xml' AS url",
    f"CASE WHEN page_id % 7 = 6 THEN '<sitemapindex><sitemap><loc> https://' || {SITE_OF} || '/sitemap-' || (page_id + 1) || '.xml </loc></sitemap></sitemapindex>' "
    "ELSE '<urlset><url><loc> ' || replace(url, '&', '&amp;') || '</loc><lastmod>2024-02-0' || (page_id % 9 + 1) || '</lastmod></url>"
    "<url><loc>' || replace(url, '&', '&amp;') || '</loc></url></urlset>' END AS body",
]
# One robots.txt per row; the first row of a host is the one that is kept.
ROBOTS_DOCUMENT_COLUMNS = [
    "page_id AS ord",
    f"'https://' || {SITE_OF} || '/robots.txt' AS url",
    "'# rules' || chr(10) || 'User-agent: OtherBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) "
    "|| 'Allow: /en/' || (page_id % 10) || chr(10) || 'Disallow: /en/ # english' || chr(10) || 'Disallow: /fr/' || (page_id % 10) AS body",
]


def derived_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_crawl(load_pages(spark, sf_dir))
