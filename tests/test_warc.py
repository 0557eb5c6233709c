import gzip
import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from pagelens.plans import derived
from pagelens.schemas import CRAWL
from pagelens.sources.crawl import read_crawl
from pagelens.sources.warc import index_archives, write_crawl_warc
from tests.fixtures import crawl

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["site"], r["ord"], str(r["url"])))


def index(spark, folder):
    return spark.read.parquet(f"{folder}/index")


def test_derived_crawl_comes_back_whole(spark, tmp_path):
    want = derived.derived_crawl(spark, SF)
    folder = str(tmp_path / "a")
    write_crawl_warc(want, folder, roll_bytes=20_000, range_bytes=6_000)
    ranges = index(spark, folder)
    assert ranges.select("archive").distinct().count() < ranges.count() < want.count()
    got = read_crawl(spark, folder, fmt="warc")
    assert got.schema.simpleString() == spark.createDataFrame([], CRAWL).schema.simpleString()
    assert rows(got) == rows(want.select(*got.columns))
    assert got.rdd.getNumPartitions() == ranges.count()


def test_edges(spark, tmp_path):
    long = "x\r\n\r\né" * 1_000_000
    given = crawl(
        spark, {"html": "a\r\n\r\nb", "headers": {"Set-Cookie": "a\r\nb", "X": None}}, {"status_code": None, "error_message": "timed out", "headers": None},
        {"html": long, "ttfb_ms": 0.1, "fetched_at": datetime(2024, 5, 1, 2, 3, 4, 567)}, {"html": ""}, {"html": ""}, {"html": "  \U0001f600", "url": "https://e.com/a b\n"},
    ).unionByName(crawl(spark, {"html": ""}))
    given = given.coalesce(1).withColumn("html", F.expr("if(error_message is null, html, null)")).withColumn("extra", F.lit(1))
    folder = str(tmp_path / "b")
    write_crawl_warc(given, folder)
    assert rows(read_crawl(spark, folder, fmt="warc")) == rows(given.drop("extra"))
    few = ["site", "ord", "url", "html_size_bytes", "headers"]
    assert rows(read_crawl(spark, folder, fmt="warc", columns=few)) == rows(given.select(few))
    empty = str(tmp_path / "c")
    write_crawl_warc(given.where("false"), empty)
    assert read_crawl(spark, empty, fmt="warc").count() == 0


def test_headers_alone_leave_large_bodies_unread(spark, tmp_path):
    # Bodies that do not pack: damage in them is seen by whoever reads bodies, and by nobody else.
    body = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(6000))
    folder = str(tmp_path / "d")
    write_crawl_warc(crawl(spark, {"html": body}, {"html": body}).coalesce(1), folder)
    first = index(spark, folder).first()
    with open(first.archive, "r+b") as f:
        f.seek(first.n_bytes // 4)
        f.write(b"\xff" * 5000)
    assert read_crawl(spark, folder, fmt="warc", columns=["ord", "html_size_bytes"]).where(f"html_size_bytes = {len(body)}").count() == 2
    try:
        read_crawl(spark, folder, fmt="warc").collect()
    except Exception as e:
        assert "Error" in str(e)
    else:
        raise AssertionError("damage was not seen")


def foreign(*records):
    return b"".join(gzip.compress(b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head.items(), ("Content-Length", len(block))]).encode() + b"\r\n" + block + b"\r\n\r\n") for head, block in records)


def test_archives_of_other_writers(spark, tmp_path):
    target = {"WARC-Type": "response", "WARC-Target-URI": "https://Ex.com/p", "WARC-Date": "2024-05-01T00:00:00Z"}
    packed = gzip.compress("café".encode("latin-1"))
    path, other = tmp_path / "x.warc.gz", tmp_path / "y.warc.gz"
    path.write_bytes(foreign(
        ({"WARC-Type": "warcinfo"}, b"software: s"),
        (target, b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\ncontent-type: text/plain\r\nContent-Type: a\r\n\r\ngone"),
        ({"WARC-Type": "request", "WARC-Target-URI": "https://ex.com/p"}, b"GET / HTTP/1.1\r\n\r\n"),
        (target, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n"),
        (target, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + packed),
        (target, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n\xff\r\n\r\n"),
    ))
    other.write_bytes(b"")
    folder = str(tmp_path / "i")
    index_archives(spark.createDataFrame([(str(path),), (str(other),), (str(path),), (None,)], "path string"), folder, range_bytes=300)
    got = rows(read_crawl(spark, folder, fmt="warc"))
    assert [(r["status_code"], r["html"]) for r in got] == [(404, "gone"), (200, "abcde"), (200, "café"), (200, "�\r\n\r\n")]
    assert {r["site"] for r in got} == {"ex.com"} and got[0]["headers"]["Content-Type"] == "text/html" and got[0]["html_size_bytes"] == 4
    assert got[0]["fetched_at"] == datetime(2024, 5, 1) and len({r["ord"] for r in got}) == 4
    assert index(spark, folder).agg(F.sum("n_records")).first()[0] == 6 and index(spark, folder).count() > 1


def test_an_archive_that_ends_inside_a_record_is_an_error(spark, tmp_path):
    path = tmp_path / "z.warc.gz"
    path.write_bytes(foreign(({"WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\n\r\nabc"))[:-9])
    try:
        index_archives(spark.createDataFrame([(str(path),)], "path string"), str(tmp_path / "j"))
    except Exception as e:
        assert "ends inside a record" in str(e)
    else:
        raise AssertionError("a cut archive passed")
