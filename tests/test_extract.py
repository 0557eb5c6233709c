from pagelens.operators.extract import page
from tests.fixtures import crawl, head


def one(spark, html, **kw):
    return page(crawl(spark, {"html": html, **kw})).first()


def test_head_fields(spark):
    html = head(
        "<title> Test Page Title </title>", '<meta name="description" content="This is a test description for SEO.">', '<meta name="robots" content="noindex, nofollow">',
        '<link rel="canonical" href="/primary-page">', '<link rel="icon" href="/favicon.png">', '<meta name="viewport" content="width=device-width, initial-scale=1.0">',
    ).replace("<body>", '<body lang="en">')
    p = one(spark, html, url="https://example.com/sub/index.html")
    assert (p.title, p.meta_description, p.meta_robots) == ("Test Page Title", "This is a test description for SEO.", "noindex, nofollow")
    assert p.canonical_url == "https://example.com/primary-page" and p.canonical_is_relative and not p.canonical_is_self_ref
    assert p.favicon_url == "https://example.com/favicon.png" and p.lang is None
    assert [d.directive for d in p.robots_directives] == ["noindex", "nofollow"]
    assert not p.indexability.is_indexable and p.indexability.noindex_source == "meta-robots"


def test_quotes_entities_and_case(spark):
    p = one(spark, "<HTML lang='en-US'><HEAD><TITLE>A &amp;amp; B &#8217;&#x41; &eacute;</TITLE><META CONTENT=\"a > b 'c'\" NAME=Description></HEAD></HTML>")
    assert p.lang == "en-US" and p.title == "A &amp; B ’A é" and p.meta_description == "a > b 'c'"


def test_social_maps(spark):
    p = one(spark, head('<meta property="og:title" content="OG Title">', '<meta property="OG:Title" content="Later">', '<meta name="twitter:card" content="summary">',
                        '<meta name="twitter:title" content="T">', '<!-- <meta property="og:image" content="x"> -->'))
    assert p.open_graph == {"og:title": "Later"} and p.twitter_cards == {"twitter:card": "summary", "twitter:title": "T"}
    assert p.title == "Later"


def test_json_ld_blocks(spark):
    def block(text):
        return f'<script type="application/ld+json">{text}</script>'

    p = one(spark, head(
        block('{"@context":"https://schema.org","@type":"WebSite","name":"x"}'), block("{ invalid json here }"), block('[{"@type":"Article"},{"@type":["A","B"]},{"x":1}]'),
        block('{"@context":"http://other.org","@type":"NewsArticle","headline":"h","image":"i"}'), block('{"name":"n"}'), block('{"@type":["Product","Thing"],"@id":"#p"}')))
    valid, bad, many, news, untyped, listed = p.json_ld
    assert valid.valid and valid.schema_type == "WebSite" and valid.warnings == ["No Google Rich Results requirements defined for schema type: WebSite"]
    assert not bad.valid and bad.error.startswith("JSON parsing error")
    assert many.schema_types == ["Article", "A", "B"] and many.schema_type is None
    assert news.rich_result_compatible and news.recommended_missing == ["author", "datePublished", "description"]
    assert news.validation_errors == ["@context should be 'https://schema.org', found: http://other.org"]
    assert untyped.warnings == ["No @type property found"] and untyped.schema_types == []
    assert listed.schema_type == "Product" and listed.schema_types == ["Product", "Thing"] and listed.schema_id == "#p"


def test_links(spark):
    body = (
        '<a href="/a#one">First</a><a href="/a#two">Second</a><a href="/empty"></a><a href="/img"><img src=x alt=" Pic "></a><a href="/g">Click Here</a>'
        '<a href="/n">https://x.org</a><a href="/d">2024</a><a href="/nf" rel="NoFollow sponsored" target=_blank>x y</a><a href="https://o.org" target="_blank">o</a>'
        '<a href="#top">t</a><a href=" mailto:a@b.c">m</a><a>none</a><a href="/open">un<b>clo</b>sed'
    )
    links = one(spark, head(body=body), url="https://example.com/").links
    assert [link.url.rsplit("/", 1)[-1] for link in links] == ["a#one", "empty", "img", "g", "n", "d", "nf", "o.org", "open"]
    assert [link.anchor_text_type for link in links] == ["partial-match", "empty", "partial-match", "generic", "naked-url", "brand", "partial-match", "partial-match", "partial-match"]
    assert links[2].text == "Pic" and links[8].text == "unclosed"
    assert links[6].is_nofollow and links[6].is_sponsored and links[6].rel == "NoFollow sponsored" and links[6].target == "_blank"
    assert not links[7].is_internal and links[0].is_internal


def test_images(spark):
    body = '<img data-src="/l.WEBP?x" alt=""><img src="" data-original="o.tif" alt="a > b" width=1 height=2><img alt=x><img src="/p.jpg" loading="lazy">'
    images = one(spark, head(body=body), url="https://example.com/d/").images
    assert [i.src for i in images] == ["https://example.com/l.WEBP?x", "https://example.com/d/o.tif", "https://example.com/p.jpg"]
    assert [i.format for i in images] == ["webp", "tiff", "jpeg"] and [i.is_next_gen_format for i in images] == [True, False, False]
    assert [i.is_lazy_loaded for i in images] == [True, False, True] and [i.is_missing_alt for i in images] == [True, False, True]


def test_headings_viewport_hreflang(spark):
    p = one(spark, head('<meta name=viewport content="width=1024, maximum-scale=10">', '<link rel="alternate" hreflang="EN-us" href="/en">', '<link rel=alternate hreflang=x-default href="/">',
                        body="<h1>One <i>two</i></h1><h2> </h2><h3>Three</h3>"))
    assert [(h.level, h.text) for h in p.headings] == [(1, "One two"), (3, "Three")]
    assert not p.viewport_allows_scaling and not p.viewport_has_device_width
    assert [(h.language_code, h.country_code, h.is_x_default) for h in p.hreflang] == [("en", "us", False), ("x", "default", True)]


def test_header_robots_and_mixed_case(spark):
    p = one(spark, head(), headers={"x-ROBOTS-tag": "noindex, max-snippet: 20, max-snippet: x"})
    assert p.indexability.noindex_source == "x-robots-tag" and p.indexability.max_snippet == 20


def test_state_json(spark):
    html = head('<script>window.__INITIAL_STATE__ = {"a":{"b":[{"title":"abc"},{"title":"Deep title"}]},"z":{"title":"Later title"},"meta":{"desc":"A description that is long enough"}};</script>')
    p = one(spark, html)
    assert p.title == "Deep title" and p.meta_description == "A description that is long enough"
    nuxt = one(spark, head('<script>window.__NUXT__={"head":{"title":"Nuxt page"}};</script>'))
    assert nuxt.title == "Nuxt page"


def test_broken_quotes_do_not_overflow(spark):
    html = '<a href="x>' + "<a href='/ok'>ok</a>\" " * 20000 + "<meta name=\"description content=x>"
    assert one(spark, html).title is None


def test_mixed_content_and_soft_404(spark):
    srcs = "".join(f'<img src="http://i.org/{k}">' for k in range(21))
    p = one(spark, head(body=srcs + "<p style=\"x:url('http://c.org/a.png')\">Sorry, PAGE  not found"))
    assert len(p.mixed_content) == 22 and p.mixed_content[0].resource_url == "http://i.org/0" and p.is_soft_404
    plain = one(spark, head(body='<form action="http://f.org/"></form><p style="x:url(http://c.org/a.png)">'))
    assert [(m.resource_type, m.resource_url) for m in plain.mixed_content] == [("form", "http://f.org/"), ("css", "http://c.org/a.png")]


def test_page_state_at_any_depth_and_place(spark):
    import json

    from pagelens.functions.jsstate import js_description, js_title, nesting, states

    deep = {"title": "Nine levels down", "description": "A description that stands nine levels down"}
    for k in range(9):
        deep = {f"k{k}": deep}
    entries = [{"no": "]}[{\\\""}] * 39 + [{"x": {"title": "In the fortieth entry", "desc": "A description in the fortieth entry"}}]
    rows = [(1, "__INITIAL_STATE__", deep), (2, "__APP_DATA__", {"list": entries})]
    html = spark.createDataFrame([(i, f"<script>window.{m} = {json.dumps(v)};</script>", json.dumps(v)) for i, m, v in rows], "id int, html string, state string")
    found = html.selectExpr("id", f"{states('html')} as st", f"{nesting('state')} as depth")
    whole = {r.id: (r.t, r.d, r.depth) for r in found.selectExpr("id", f"{js_title('st')} as t", f"{js_description('st')} as d", "depth").collect()}
    assert whole == {1: ("Nine levels down", "A description that stands nine levels down", 10), 2: ("In the fortieth entry", "A description in the fortieth entry", 4)}
    assert {r.t for r in found.selectExpr(f"{js_title('st', 5, 10)} as t").collect()} == {None}


def test_verdicts_read_whole_pages(spark):
    late = crawl(spark, {"html": head() + "<p>x</p>" * 20000 + "<p>Page not found</p><div id=__next></div><script>window.__NEXT_DATA__ = {}</script>", "status_code": 200})
    whole, cut = page(late).first(), page(late, js_window=50000, soft_404_window=5000).first()
    assert whole.is_soft_404 and whole.is_js_rendered and not cut.is_soft_404 and not cut.is_js_rendered
