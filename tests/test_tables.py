import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from pagelens.operators import advanced, assets, dom, reporting, rules, site, structured, visibility
from pagelens.operators.extract import page
from pagelens.operators.skew import salted_join, sized_join
from pagelens.plans import derived
from pagelens.plans.snapshot import Snapshot
from pagelens.sources import commit, crawl as crawl_source
from pagelens.sources import sinks, sitemap
from pagelens.functions.urls import normalize_url
from pagelens.streaming import audit
from tests.fixtures import crawl, head, probe


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 500)) as k", "id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k499", 4), ("none", 5)], "k string, v int")
    for how in ("left", "inner"):
        want = sorted(left.join(right, "k", how).select("id", F.coalesce("v", F.lit(0))).collect())
        assert sorted(salted_join(left, right, ["k"], ["id"], how).select("id", F.coalesce("v", F.lit(0))).collect()) == want
    dim = right.groupBy("k").agg(F.max("v").alias("v"))
    want = sorted(left.join(dim, "k", "left").select("id", F.coalesce("v", F.lit(0))).collect())
    assert sorted(sized_join(left, dim, ["k"], ["id"], dim).select("id", F.coalesce("v", F.lit(0))).collect()) == want


def test_large_duplicate_group_keeps_all_members(spark):
    p = page(crawl(spark, *[{"html": head("<title>Same title here</title>")} for _ in range(60)], {"html": head("<title>Other title</title>")}))
    members = site.duplicate_members(p, "title").collect()
    assert len(members) == 60 and sum(m.is_first for m in members) == 1 and {m.n_pages for m in members} == {60}
    text = site.duplicate_issues(p, "title").first().description
    assert text == "Duplicate title 'Same title here' shared by 60 pages." and {m.dup_key for m in members} == {"Same title here"}


def test_redirects_headers_and_scores(spark):
    c = crawl(spark, {"html": head(body="<h1>a</h1><a href=/x>here</a>"), "final_url": "https://example.com/target", "redirect_history": ["https://example.com/start", "https://example.com/hop"],
                      "redirect_status_codes": [301], "headers": {"strict-transport-security": "x", "X-Frame-Options": ""}, "compressed_size": 10, "html_size_bytes": 40})
    p = page(c)
    chain = advanced.redirect_chain(p).first()
    assert chain.chain[-1] == "https://example.com/target" and chain.total_redirects == 2 and not chain.is_too_long and not p.first().has_redirect_loop
    assert p.select(F.expr(site.redirect_display())).first()[0] == "[301] https://example.com/start → [?] https://example.com/hop → [200] https://example.com/target"
    assert p.select(F.expr(site.COMPRESSION)).first()[0] == 75.0
    got = {r.header: (r.present, r.severity) for r in advanced.security_headers(p).collect()}
    assert got["HSTS"] == (True, "INFO") and got["X-Frame-Options"] == (False, "WARNING") and len(got) == 7
    a = advanced.advanced_page(p).first()
    assert a.missing_headers == 3 and a.internal_link_score == 100 - 10 - 3 - 5


def test_visibility_edges(spark):
    pages = [
        {"html": head(body="<h1>What is this</h1><h2>b</h2><h3>c</h3>" + "word " * 797), "headers": {}},
        {"html": head(body="word " * 299)},
    ]
    f = visibility.factor_scores(advanced.advanced_page(page(crawl(spark, *pages)))).orderBy("ord").collect()
    assert (f[0].hs, f[0].cd, f[0].an, f[0].md, f[0].im, f[0].il) == (100, 75, 45, 0, 100, 15)
    assert (f[1].hs, f[1].cd, f[1].te) == (0, 20, 100 - 20 - 20)
    assert f[1].grade == "F" and f[0].sd == 20


def test_fetch_guard_and_success(spark):
    html = {"Content-Type": "text/html"}
    c = crawl(spark, {"html": "abc", "headers": html}, {"html": "abc", "headers": {"content-type": "image/png"}}, {"html": "abc", "headers": {**html, "content-length": "99"}},
              {"html": "x" * 50, "headers": html}, {"html": "abc", "headers": html, "status_code": 404}, {"html": "a", "headers": {}, "error_message": "Timeout"})
    got = crawl_source.fetch_guard(c, max_bytes=40).orderBy("ord").collect()
    assert [r.error_message for r in got] == [None, "Non-HTML content: image/png", "Content length exceeds maximum limit.", "Download size exceeded limit.", None, "Timeout"]
    assert [r.html for r in got[:2]] == ["abc", ""]
    assert [r.ord for r in crawl_source.successful(crawl_source.fetch_guard(c, 40)).collect()] == [0]


def test_sitemaps(spark, tmp_path):
    docs = spark.createDataFrame([
        ("https://e.org/index.xml", "<sitemapindex><sitemap><loc> https://e.org/s1.xml </loc></sitemap></sitemapindex>"),
        ("https://e.org/s1.xml", "<urlset><url><loc>https://e.org/a?x=1&amp;y=2</loc><lastmod>2024-01-01</lastmod></url><url><loc> </loc></url></urlset>"),
        ("https://e.org/s2.xml", "<urlset><url><loc>https://e.org/b</loc></url></urlset>"),
    ], "url string, body string")
    got = {(r.loc, r.lastmod, r.from_index) for r in sitemap.expand_index(docs).collect()}
    assert got == {("https://e.org/a?x=1&y=2", "2024-01-01", True), ("https://e.org/b", None, False)}
    (tmp_path / "m.xml").write_text('<?xml version="1.0"?><urlset><url><loc>https://e.org/c</loc></url><url><loc>https://e.org/d</loc><lastmod>2024</lastmod></url></urlset>')
    assert {(r.site, r.loc, r.lastmod) for r in sitemap.read_sitemap_files(spark, str(tmp_path)).collect()} == {("e.org", "https://e.org/c", None), ("e.org", "https://e.org/d", "2024")}


@pytest.fixture
def snap(spark, tmp_path):
    c = crawl(spark, {"html": head("<title>Short</title>")}, {"html": head("<title>A title, \"quoted\" enough</title>", body='<a href="/0">to zero</a>')})
    maps = spark.createDataFrame([("example.com", "https://example.com/lost", None)], "site string, loc string, lastmod string")
    status = spark.createDataFrame([("https://example.com/0", 200)], "url string, status_code int")
    return Snapshot(c, probe(spark, start="https://example.com/0"), maps, str(tmp_path / "tables"), status)


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.range(100).selectExpr("id", "concat('line\n', id) as t").repartition(3)

    def write(df):
        return lambda to: df.write.option("header", True).csv(to)

    def killed(to):
        rows.write.option("header", True).csv(to)
        raise RuntimeError("lost")

    with pytest.raises(FileNotFoundError):
        commit.published(spark, path)
    commit.publish(spark, path, write(rows), lambda at: sinks._csv(spark, at))
    first = commit.published(spark, path, verify=True)
    assert commit.manifest(spark, path).agg(F.count("file"), F.sum("rows")).first()[:] == (3, 100)
    with pytest.raises(RuntimeError):
        commit.publish(spark, path, killed, lambda at: sinks._csv(spark, at))
    assert commit.published(spark, path, verify=True) == first and sinks.read_issues_csv(spark, path).count() == 100
    commit.publish(spark, path, write(rows.limit(7)), lambda at: sinks._csv(spark, at))
    assert sinks.read_issues_csv(spark, path, verify=True).count() == 7
    rows.limit(1).write.mode("append").csv(commit.published(spark, path))
    with pytest.raises(ValueError):
        commit.published(spark, path, verify=True)


def test_exports(spark, snap, tmp_path):
    located = dom.issue_locators(snap.issues, dom.dom_nodes(snap.crawl))
    sinks.write_issues_csv(located, str(tmp_path / "csv"))
    rows = [r for f in sorted(glob.glob(sinks.published(spark, str(tmp_path / "csv")) + "/*.csv")) for r in list(csv.reader(open(f)))[1:]]
    assert len(rows) == snap.issues.count() and rows[0][2] == "Orphan Pages" and len(rows[0]) == 8
    parts = {"sites": snap.report, "pages": sinks.page_documents(snap.page, located, snap.scores, snap.checked), "site_issues": snap.issues.where("ord < 0"), "orphans": snap.orphans}
    sinks.write_report_json(parts, str(tmp_path / "json"))
    report = sinks.report_folder(spark, str(tmp_path / "json"), verify=True)
    assert {d["issue_type"] for f in glob.glob(f"{report}/site_issues/*/*.json") for d in map(json.loads, open(f))} == {r.issue_type for r in snap.issues.where("ord < 0").collect()}
    assert len(glob.glob(f"{report}/pages/site=*/*.json")) == 1
    docs = [json.loads(line) for f in glob.glob(f"{report}/pages/*/*.json") for line in open(f)]
    assert {d["url"] for d in docs} == {"https://example.com/0", "https://example.com/1"} and all(d["issues"] for d in docs)
    sinks.write_sitemap_xml(structured.sitemap_export(snap.scores, snap.probe, "2024-06-01"), str(tmp_path / "xml"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "xml/*/*.xml")))
    assert text.count("<url>") == 2 and "<priority>1.0</priority>" in text
    sinks.write_site_texts(structured.llms_txt(snap.llms_sites), str(tmp_path / "txt"))
    llms = "".join(open(f).read() for f in glob.glob(str(tmp_path / "txt/*/*.txt")))
    assert llms.startswith("# example.com\n> Page audit report") and "- [Short](https://example.com/0)\n" in llms and "## FAQs" not in llms
    sinks.write_keyword_csv(snap.top_keywords.select("site", "keyword", "count"), str(tmp_path / "kw"))
    assert spark.read.option("header", True).csv(str(tmp_path / "kw")).columns == ["site", "keyword", "count"]


def test_reports_on_snapshot(snap):
    top = reporting.top_issues(snap.issues).orderBy("rank").collect()
    assert [t.rank for t in top] == list(range(1, len(top) + 1)) and len(top) <= 15
    assert [t.severity for t in top] == sorted((t.severity for t in top), key=["CRITICAL", "WARNING", "INFO"].index)
    chapters = reporting.report_chapters(snap.issues).where("section is null").agg(F.sum("total")).first()[0]
    assert chapters == snap.issues.count()
    plan = reporting.fix_plan(snap.issues).orderBy("priority").collect()
    assert plan[0].severity == "CRITICAL" and plan[0].urls


def test_json_ld_builders(spark):
    row = spark.range(1).select(
        F.expr(structured.product("'P'", "'u'", price="'9.90'", brand="'B'")).alias("p"), F.expr(structured.organization("'O'", "'u'")).alias("o"),
        F.expr(structured.breadcrumb(structured.crumbs_from_url("'https://e.org/my-page/sub_page'", "'Home'"))).alias("b"),
        F.expr(structured.local_business("'L'", "'u'", latitude="0", longitude="5")).alias("l"), F.expr(structured.faq_fallback("'T'", "''")).alias("f"),
    ).first()
    assert json.loads(row.p)["offers"] == {"@type": "Offer", "price": "9.90", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}
    assert json.loads(row.o) == {"@context": "https://schema.org", "@type": "Organization", "name": "O", "url": "u"}
    crumbs = json.loads(row.b)["itemListElement"]
    assert [(c["position"], c["name"], c["item"]) for c in crumbs] == [(1, "Home", "https://e.org/"), (2, "My Page", "https://e.org/my-page/"), (3, "Sub Page", "https://e.org/my-page/sub_page/")]
    assert "geo" not in json.loads(row.l) and json.loads(row.f)["mainEntity"][0]["acceptedAnswer"]["text"] == "Information about T"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "crawl")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    derived.derive_crawl(pages).repartition(3).write.parquet(src)
    stream = audit.crawl_stream(spark, src, max_files=1)
    out = str(tmp_path / "issues")
    audit.append_to(audit.stream_page_audit(stream), out, str(tmp_path / "ck1")).awaitTermination()
    batch = rules.page_issues(page(spark.read.parquet(src)))
    assert spark.read.parquet(out).count() == batch.count()
    table = str(tmp_path / "scores")
    probe = pages.groupBy(F.expr(derived.SITE_OF).alias("site")).agg(F.min_by("url", "page_id").alias("start_url")).selectExpr("*", "true as robots_txt_found", "false as sitemap_xml_found")
    sitemap = pages.selectExpr(*derived.SITEMAP_COLUMNS)
    audit.stream_site_scores(stream, probe, table, str(tmp_path / "ck3")).awaitTermination()
    assert len(audit._score_tables(spark, table)["facts"].folders()) == 3
    columns = ["site", "pages", "site_score", "ai_visibility_score", "site_speed_score", "site_health_score"]
    whole = page(spark.read.parquet(src))
    want = site.website_report(whole, site.page_scores(whole, probe), site.orphan_pages(sitemap, whole), probe)
    got = audit.running_site_scores(spark, table, probe, sitemap)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_asset_status_counts(spark):
    p = page(crawl(spark, *[{"html": head(body='<a href="/hub">hub page</a>')} for _ in range(5)]))
    s = assets.asset_status(assets.references(p), spark.createDataFrame([("https://example.com/hub", 301)], "url string, status_code int")).first()
    assert (s.n_refs, s.status_code, s.is_broken) == (5, 301, False)
