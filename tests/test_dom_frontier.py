from types import SimpleNamespace
from urllib.robotparser import RobotFileParser

import pytest

from pyspark.sql import functions as F

from pagelens.functions.urls import normalize_url
from pagelens.operators import assets, dom, frontier
from pagelens.operators.extract import page
from pagelens.operators.rules import page_issues
from pagelens.session import ensure_checkpoint_dir
from pagelens.sources import robots
from tests.fixtures import crawl, head


def test_paths_and_positions(spark):
    html = (
        '<html><head><title>t</title><meta a><meta b></head><body><div id="top"><p>x<p>y <a href="/1">1</a></div><div class="Side-Bar"><a href="/2">2</a></div>'
        '<footer><ul><li><a href="/3">3</a><li><a href="/4">4</a></ul></footer><section class="nav-menu"><img src=a></section><a href="/5">5</a></body></html>'
    )
    rows = {(r.tag, r.n): r for r in dom.dom_nodes(crawl(spark, {"html": html})).collect()}
    assert rows["title", 1].css_selector == "html > head > title" and rows["title", 1].xpath == "/html/head/title"
    assert rows["meta", 2].css_selector == "html > head > meta:nth-of-type(2)" and rows["meta", 2].xpath == "/html/head/meta[2]"
    assert rows["a", 1].css_selector == "div#top > p:nth-of-type(2) > a" and rows["a", 1].xpath == "/html/body/div[1]/p[2]/a"
    assert [rows["a", i].link_position for i in range(1, 6)] == ["content", "sidebar", "footer", "footer", "content"]
    assert rows["a", 4].css_selector == "html > body > footer > ul > li:nth-of-type(2) > a"
    assert rows["img", 1].link_position == "navigation"


def test_findings_get_their_element(spark):
    c = crawl(spark, {"html": head("<title>Short</title>", '<meta charset=x>', '<meta name=description content="tiny">', body="<div><img src=/a><img src=/b alt=b></div>")})
    p = page(c)
    at = {r.issue_type: (r.css_selector, r.xpath) for r in dom.issue_locators(page_issues(p), dom.dom_nodes(c)).collect()}
    assert at["Title Too Short"] == ("html > head > title", "/html/head/title")
    assert at["Meta Description Too Short"][1] == "/html/head/meta[2]"
    assert at["Missing Alt Text"][0] == "html > body > div > img:nth-of-type(1)"
    assert at["Missing Favicon"] == (None, None)


def test_findings_are_not_multiplied(spark):
    html = head("<title>Short</title>", body="<img src=/a>")
    c = crawl(spark, {"url": "https://example.com/1", "final_url": "https://example.com/x", "html": html}, {"url": "https://example.com/2", "final_url": "https://example.com/x", "html": html})
    issues = page_issues(page(c))
    assert dom.issue_locators(issues, dom.dom_nodes(c)).count() == issues.count()


def test_links_inside_attribute_values_are_no_links(spark):
    html = head(body='<p title="<a b">x</p><nav><a href="/1">one</a></nav><img alt="1 < 2" src=/i><footer><a href="/2">two</a></footer>')
    c = crawl(spark, {"html": html})
    p = page(c)
    got = {r.link_url.rsplit("/", 1)[1]: r.link_position for r in dom.link_positions(dom.dom_nodes(c), assets.link_rows(p)).collect()}
    assert got == {"1": "navigation", "2": "footer"}
    assert assets.image_rows(p).first().alt == "1 < 2"


def test_depth_over_links(spark):
    def links(*hrefs):
        return head(body="".join(f'<a href="{h}">l</a>' for h in hrefs))

    c = crawl(
        spark, {"url": "https://example.com/", "html": links("/about", "https://external.org/x", "#a")}, {"url": "https://example.com/about", "html": links("/contact/", "/")},
        {"url": "https://example.com/contact", "html": links("/deep")}, {"url": "https://example.com/deep", "html": links("/deeper")},
        {"url": "https://example.com/err", "html": links("/hidden"), "status_code": 500},
    )
    seeds = spark.createDataFrame([("example.com", "https://example.com/")], "site string, url_key string")
    got = {r.url_key.removeprefix("https://example.com"): r.depth for r in frontier.crawl_depth(seeds, frontier.page_edges(c), 2).collect()}
    assert got == {"/": 0, "/about": 1, "/contact": 2}


def test_depth_on_a_random_graph(spark):
    edges = [(f"k{i}", f"k{(i * 7 + j * 13) % 60}") for i in range(60) for j in range(2)]
    want, level = {"k0": 0}, {"k0"}
    for d in range(1, 5):
        level = {b for a, b in edges if a in level} - want.keys()
        want.update(dict.fromkeys(level, d))
    e = spark.createDataFrame([("s", a, b) for a, b in edges], "site string, source_key string, target_key string")
    got = frontier.crawl_depth(spark.createDataFrame([("s", "k0")], "site string, url_key string"), e, 4).collect()
    assert {r.url_key: r.depth for r in got} == want


def test_levels_join_edges_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.createDataFrame([("s", f"k{i % 40}", f"k{i}", i) for i in range(400)] + [("s", "hub", f"h{i}", i) for i in range(300)], "site string, source_key string, target_key string, pos int")
        hot = frontier.hot_keys(e, ["site", "source_key"])
        assert ("s", "hub") in {tuple(r) for r in hot.collect()}
        lying, seen = frontier.placed_edges(e, hot, 4), frontier.kept_in_place(e.selectExpr("site", "source_key as url_key").distinct(), 4, "site", "url_key")
        start = spark.createDataFrame([("s", "hub", [0]), ("s", "k1", [1])], "site string, url_key string, path array<int>")
        step = frontier.next_level(lying, start, hot, [seen], 1)
        lines = step._jdf.queryExecution().executedPlan().toString().split("\n")
        scans = [k for k, x in enumerate(lines) if "InMemoryTableScan" in x]
        assert len(scans) == 2
        for k in scans:  # from the scan up to its join, over less indented lines only
            depth = len(lines[k]) - len(lines[k].lstrip(" :+-"))
            for x in reversed(lines[:k]):
                at = len(x) - len(x.lstrip(" :+-"))
                if at < depth:
                    depth = at
                    assert "Exchange" not in x
                    if "Join" in x:
                        break
        assert {r.url_key for r in step.collect()} == {f"h{i}" for i in range(300)} | {f"k{i}" for i in range(41, 400, 40)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_discovered_link_kinds(spark):
    c = crawl(spark, {"html": head('<link rel="next" href="/n">', '<link rel="icon" href="/i">', '<meta http-equiv="refresh" content="0; url=/r">', body='<a href="/a">a</a><area href="/m"><a href="mailto:x">')})
    assert {r.target_url.rsplit("/", 1)[1] for r in frontier.discovered_links(c).collect()} == {"n", "r", "a", "m"}


ROBOTS = [
    "User-agent: *\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: PageLens\nDisallow: /only # note\nDisallow:\n",
    "# c\nUser-agent: Other\nUser-agent: *\nAllow: /a/b\nDisallow: /a\n\nDisallow: /late\nCrawl-delay: 3\n",
    "", "User-agent: pagelens\n\nDisallow: /x\n", "User-agent: *\r\nDisallow: /\r\n",
]
PATHS = ["/", "/private", "/private/ok", "/only/x", "/a", "/a/b/c", "/late", "/x?q=/a", "/z"]


def test_robots_match_standard_library(spark):
    docs = spark.createDataFrame([(f"https://h{i}.org/robots.txt", t) for i, t in enumerate(ROBOTS)], "url string, body string")
    urls = spark.createDataFrame([(f"https://h{i}.org{p}",) for i in range(len(ROBOTS)) for p in PATHS], "url string")
    rules = robots.rules_for_agent(robots.robots_rules(docs), "PageLens/1.0")
    got = {r.url: r.allowed for r in frontier.robots_filter(urls, rules).collect()}
    bad = []
    for i, text in enumerate(ROBOTS):
        rp = RobotFileParser()
        rp.parse(text.splitlines())
        bad += [(i, p) for p in PATHS if got[f"https://h{i}.org{p}"] != rp.can_fetch("PageLens/1.0", f"https://h{i}.org{p}")]
    assert bad == []


def test_long_robots_files_and_many_rules(spark):
    import time

    body = "User-agent: a\nUser-agent: PageLens\n" + "".join(f"Disallow: /d{i:05}/x\nAllow: /d{i:05}\n" for i in range(25_000)) + "\nUser-agent: *\nDisallow: /\n"
    docs = spark.createDataFrame([("https://h.org/robots.txt", body)] * 2 + [("https://k.org/robots.txt", "User-agent: *\nDisallow: *\n")], "url string, body string")
    urls = spark.createDataFrame([(f"https://h.org/d{i:05}/{x}",) for i in range(0, 25_000, 5) for x in "xy"] + [("https://h.org/other",), ("https://k.org/a",), ("https://none.org/",), (None,)] * 2, "url string")
    start = time.perf_counter()
    rules = robots.rules_for_agent(robots.robots_rules(docs), "PageLens/1.0")
    got = frontier.robots_filter(urls, rules).collect()
    assert len(got) == 10_008 and rules.where("host = 'h.org'").count() == 50_000 and time.perf_counter() - start < 60
    assert all(r.allowed != (r.url is not None and (r.url.endswith("/x") or "k.org" in r.url)) for r in got)


def test_blocked_rows_are_kept_and_limit(spark):
    rules = spark.createDataFrame([("e.org", 1, False, "/no")], "host string, ord int, allow boolean, path string")
    out = frontier.robots_filter(spark.createDataFrame([("https://e.org/no/x",), ("https://e.org/yes",)], "url string"), rules)
    assert {r.url[-1]: (r.allowed, r.error_message) for r in out.collect()} == {"x": (False, "Blocked by robots.txt"), "s": (True, None)}
    reached = spark.createDataFrame([("s", f"k{i}", i % 3, [9 - i]) for i in range(9)], "site string, url_key string, depth int, path array<int>")
    assert [r.url_key for r in frontier.frontier_limit(reached, 4).orderBy("rn").collect()] == ["k6", "k3", "k0", "k7"]


def test_discovery_order_follows_links(spark):
    c = crawl(spark, {"url": "https://example.com/", "html": head(body='<a href="/z">z</a><a href="/a">a</a>')}, {"url": "https://example.com/z", "html": head(body='<a href="/y">y</a>')},
              {"url": "https://example.com/a", "html": head(body='<a href="/b">b</a>')}, {"url": "https://example.com/y", "html": head(body='<a href="/q">q</a>'), "status_code": 404})
    seeds = spark.createDataFrame([("example.com", "https://example.com/")], "site string, url_key string")
    got = frontier.frontier_limit(frontier.crawl_depth(seeds, frontier.page_edges(c), 5), 9).orderBy("rn").collect()
    assert [r.url_key.rsplit("/", 1)[1] for r in got] == ["", "z", "a", "y", "b"]


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_seeds_are_deduplicated(spark):
    maps = spark.createDataFrame([("e.org", "https://e.org/", None), ("e.org", "https://e.org/a/index.html", None), ("e.org", "https://e.org/a", None)], "site string, loc string, lastmod string")
    start = spark.createDataFrame([("e.org", "https://e.org", True, True)], "site string, start_url string, robots_txt_found boolean, sitemap_xml_found boolean")
    got = sorted(r.url for r in frontier.seed_frontier(maps, start).collect())
    assert got == ["https://e.org/", "https://e.org/a", "https://e.org/a/index.html"]
    assert spark.range(1).select(F.expr(normalize_url("'https://e.org/a/index.html'"))).first()[0] == "https://e.org/a/"
