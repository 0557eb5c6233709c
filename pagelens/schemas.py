"""Declared schemas of the stored inputs. Nothing is inferred at read time."""

CRAWL = """
    site string, ord bigint, url string, final_url string, html string, status_code int,
    headers map<string,string>, redirect_history array<string>,
    redirect_status_codes array<int>, error_message string, ttfb_ms double,
    total_ms double, html_size_bytes bigint, compressed_size bigint, crawl_depth int,
    fetched_at timestamp
"""

SITE_PROBE = "site string, start_url string, robots_txt_found boolean, sitemap_xml_found boolean"

URL_STATUS = "url string, status_code int"

SITEMAP_ENTRY = "site string, loc string, lastmod string"

STORED_DOCUMENT = "url string, body string"

DOM_NODE = """
    site string, url string, tag string, n int, css_selector string, xpath string,
    link_position string,
    ancestors array<struct<tag:string,nth:int,n_same:int,id:string,class:string>>
"""
