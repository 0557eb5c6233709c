"""Small hand-made crawls."""

from __future__ import annotations

from pagelens.schemas import CRAWL, SITE_PROBE

FIELDS = [
    "site", "ord", "url", "final_url", "html", "status_code", "headers", "redirect_history", "redirect_status_codes", "error_message",
    "ttfb_ms", "total_ms", "html_size_bytes", "compressed_size", "crawl_depth", "fetched_at",
]


def crawl(spark, *pages):
    rows = []
    for i, p in enumerate(pages):
        url = p.get("url", f"https://example.com/{i}")
        row = {
            "site": "example.com", "ord": i, "url": url, "final_url": url, "html": "", "status_code": 200, "headers": {}, "redirect_history": [],
            "redirect_status_codes": [], "error_message": None, "ttfb_ms": None, "total_ms": None, "html_size_bytes": len(p.get("html", "")),
            "compressed_size": None, "crawl_depth": 0, "fetched_at": None, **p,
        }
        rows.append(tuple(row[f] for f in FIELDS))
    return spark.createDataFrame(rows, CRAWL)


def probe(spark, robots=True, sitemap=True, site="example.com", start="https://example.com/"):
    return spark.createDataFrame([(site, start, robots, sitemap)], SITE_PROBE)


def head(*tags, body="", html_attrs=""):
    return f"<html{html_attrs}><head>{''.join(tags)}</head><body>{body}</body></html>"
