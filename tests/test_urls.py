from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagelens.functions import urls as U

BASES = ["https://example.com/a/b/c.html?q=1#f", "http://example.com", "https://example.com/dir/"]
REFS = [
    "", "/", "/x/y", "x", "./x", "../x", "../../x", "../../../x", "?p=2", "#frag", "//cdn.example.org/z", "https://other.org/p#q", "mailto:a@b.c",
    "x/../y", "x/./y", "/a//b", "..", ".", "x?y=/../z", "ftp://h/p", "tel:1",
]


def test_join_matches_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", F.expr(U.url_join("b", "r")).alias("j")).collect()
    bad = [(x.b, x.r, x.j, urljoin(x.b, x.r)) for x in got if x.j != urljoin(x.b, x.r)]
    assert bad == []


def test_internal_and_keys(spark):
    df = spark.createDataFrame([("https://sub.example.com/x",), ("https://notexample.com/",), ("about.html",), ("/x",), ("",), ("mailto:a@b.c",)], "u string")
    got = [r[0] for r in df.select(F.expr(U.is_internal_url("u", "'https://example.com/p'"))).collect()]
    assert got == [True, False, True, True, False, False]
    keys = spark.createDataFrame([("HTTPS://e.com/a/Index.html?x=1",), ("https://e.com",), ("https://e.com/a/;p=1",), ("https://e.com/a/b///",)], "u string")
    assert [r[0] for r in keys.select(F.expr(U.normalize_url("u"))).collect()] == ["https://e.com/a/", "https://e.com/", "https://e.com/a", "https://e.com/a/b"]


def test_structure_score_edges(spark):
    def score(url):
        return spark.createDataFrame([(url,)], "u string").select(F.expr(U.url_structure_score("u"))).first()[0]

    assert score("https://e.com/a/b") == 100
    assert score("https://e.com/" + "a" * 61) == 100  # 75 characters
    assert score("https://e.com/" + "a" * 62) == 95
    assert score("https://e.com/" + "a" * 87) == 90  # 101 characters
    assert score("https://e.com/a/b/c/d") == 95
    assert score("https://e.com/a/b/c/d/e") == 85
    assert score("https://e.com/a_b/C.php?x=1") == 100 - 10 - 5 - 5 - 10
