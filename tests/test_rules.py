from pagelens.operators import assets, site
from pagelens.operators.catalog import ISSUES
from pagelens.operators.extract import page
from pagelens.operators.rules import page_issues, rules
from tests.fixtures import crawl, head, probe

F1 = head("<title>Test Page</title>", '<meta name="description" content="Too short">', '<link rel="canonical" href="https://example.com/0">',
          '<script type="application/ld+json">{bad</script>', body='<img src="/a.webp">')


def types(spark, **kw):
    return {r.issue_type: r for r in page_issues(page(crawl(spark, kw))).collect()}


def test_every_catalog_type_has_a_rule():
    page_types = [i for i, _, _ in rules()]
    assert len(page_types) == len(set(page_types)) == 50
    assert set(ISSUES) - set(page_types) == {
        "Hreflang Broken Target", "Broken Link", "Broken Image", "Duplicate Page Content", "Duplicate Page Title", "Duplicate Meta Description", "Orphan Pages"}


def test_one_poor_page(spark):
    p = page(crawl(spark, {"html": F1}))
    found = [r.issue_type for r in page_issues(p).orderBy("seq").collect()]
    assert found == [
        "Title Too Short", "Meta Description Too Short", "Missing Viewport Tag", "Missing Lang Attribute", "Missing H1 Heading", "Missing Favicon", "Missing Open Graph Tags",
        "Missing Twitter Cards", "Invalid JSON-LD", "Missing Alt Text", "Image Missing Dimensions"]
    assert site.page_scores(p, probe(spark)).first().score == 53


def test_http_and_timing_edges(spark):
    loop = types(spark, html="x", redirect_history=["https://example.com/0", "b", "c", "d"], status_code=404, total_ms=3001.0, ttfb_ms=1001.0, html_size_bytes=1048577, crawl_depth=4)
    for name in ("Redirect Loop", "Too Many Redirects", "Page Not Found", "Slow Response Time", "Large Page Size", "Deep Page Depth"):
        assert name in loop
    assert "High TTFB" not in loop and loop["Large Page Size"].description == "HTML page size is 1024KB (over 1MB)."
    fast = types(spark, html="x", status_code=500, total_ms=3000.0, ttfb_ms=1000.5, html_size_bytes=1048576, crawl_depth=3)
    assert "High TTFB" in fast and "Server Error" in fast and not {"Slow Response Time", "Large Page Size", "Deep Page Depth"} & set(fast)


def test_script_pages_soften(spark):
    found = types(spark, html=head(body='<div id="root"></div>'))
    assert found["Missing Title"].severity == "WARNING" and found["Missing Title"].description.endswith("(page appears JavaScript-rendered)")
    assert "JavaScript Rendered Page" in found


def test_canonical_rules(spark):
    found = types(spark, url="http://example.com/0", html=head('<link rel=canonical href="https://example.com/0">'))
    assert "Canonical Protocol Mismatch" in found and "Canonical Mismatch" in found and "Canonical Relative URL" not in found
    assert "Multiple Canonical Tags" in types(spark, html=head("<link rel=canonical href=/a>", "<link rel=canonical href=/b>"))


GOOD = [
    "<title>{t}</title>", '<meta name="description" content="{d}">', '<link rel="canonical" href="{u}">', '<meta name=viewport content="width=device-width">', '<link rel=icon href=/i>',
    '<meta property="og:title" content=x>', '<meta property="og:description" content=x>',
]


def good(url, title, desc):
    return {"url": url, "html": head(*[g.format(t=title, d=desc, u=url) for g in GOOD], body="<h1>Head</h1>", html_attrs=" lang=en")}


def test_two_page_site(spark):
    long = "A sufficiently long description of the page, number {}, for the limits."
    urls = ["https://example.com/a", "https://example.com/b"]
    p = page(crawl(spark, good(urls[0], "Same long title", long.format(1)), good(urls[1], "Same long title", long.format(2))))
    maps = spark.createDataFrame([("example.com", u, None) for u in [urls[0] + "/", urls[1], "https://example.com/orphan"]], "site string, loc string, lastmod string")
    orphans = site.orphan_pages(maps, p)
    assert [r.loc for r in orphans.collect()] == ["https://example.com/orphan"]
    scores = site.page_scores(p, probe(spark))
    report = site.website_report(p, scores, orphans, probe(spark)).first()
    assert (report.duplicate_titles, report.duplicate_contents, report.orphans) == (1, 0, 1)
    # Each page lacks og:image, so it scores 97; two pages with Open Graph tags lift the AI score.
    assert report.site_score == 97 - 5 - 5 and report.ai_visibility_score == 100 - 20 - 10 - 5 and report.site_speed_score == 90
    assert report.site_health_score == int(87 * 0.4 + 65 * 0.2 + 90 * 0.2 + 20)
    issue = site.duplicate_issues(p, "title").first()
    assert issue.description == "Duplicate title 'Same long title' shared by 2 pages."


def test_broken_assets(spark):
    p = page(crawl(spark, {"html": head(body='<a href="/x">x y</a><img src="/i.png" alt=a width=1 height=1>')}))
    none = spark.createDataFrame([], "url string, status_code int")
    checked = assets.checked_references(assets.references(p), none)
    found = {r.issue_type: r for r in assets.broken_issues(checked).collect()}
    assert set(found) == {"Broken Link", "Broken Image"} and {r.severity for r in found.values()} == {"CRITICAL"}
    assert found["Broken Link"].description == "Broken internal link: https://example.com/x (Status: Timeout)"
    s = site.page_scores(p, probe(spark), checked).first()
    assert s.score == s.base_score - 10


def test_hreflang_return_links(spark):
    def alt(target):
        return head(f'<link rel=alternate hreflang=fr href="{target}">')

    p = page(crawl(spark, {"url": "https://example.com/a", "html": alt("/b")}, {"url": "https://example.com/b", "html": alt("/a")}, {"url": "https://example.com/c", "html": alt("/a")}))
    status = spark.createDataFrame([("https://example.com/a", 200), ("https://example.com/b", 404)], "url string, status_code int")
    got = {(r.source_url[-1], r.target_url[-1]): (r.has_return_link, r.is_broken_target) for r in assets.hreflang_targets(p, status).collect()}
    assert got == {("a", "b"): (True, True), ("b", "a"): (True, False), ("c", "a"): (False, False)}
