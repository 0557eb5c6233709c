import re
from collections import Counter

from pyspark.sql import functions as F

from pagelens.functions.text import content_metrics, readability_band, reading_ease, visible_text
from pagelens.operators import keywords as K

STOPS = set(K.STOP_WORDS)


def brute_tokens(text):
    return [w.strip("-") for w in re.sub(r"[^a-z\s\-]", " ", text.lower()).split() if len(w.strip("-")) >= 3]


def brute_terms(tokens):
    for n in (1, 2, 3):
        for i in range(len(tokens) - n + 1):
            if not any(t in STOPS for t in tokens[i:i + n]):
                yield n, i, " ".join(tokens[i:i + n])


def texts(spark, rows):
    return K.tokens(spark.createDataFrame(rows, "site string, ord bigint, url string, title string, description string, headings array<string>, text string"))


ROWS = [
    ("s", 0, "https://s/guide", "seo guide", None, ["the guide book"], "SEO guide for small-business owners -- the best SEO guide"),
    ("s", 1, "https://s/x", None, "about pricing", [], "pricing guide pricing guide pricing"),
    ("s", 2, "https://s/y", "", "", [], "one"),
    ("t", 3, "https://t/", "Zebra", None, [], "zebra zebra crossing x-ray"),
    ("t", 4, "https://t/e", None, None, [], ""),
]


def test_keyword_table_against_brute_force(spark):
    got = {(r.site, r.keyword): r for r in K.keyword_table(texts(spark, ROWS)).collect()}
    count, pages, total, first, flags = Counter(), {}, Counter(), {}, {}
    for site, ord_, url, title, desc, heads, text in ROWS:
        toks = brute_tokens(text)
        total[site] += len(toks)
        for n, pos, term in brute_terms(toks):
            key = (site, term)
            count[key] += 1
            pages.setdefault(key, set()).add(url)
            first.setdefault(key, (ord_, n, pos))
            f = flags.setdefault(key, [False] * 4)
            if n == 1:
                f[0] |= term in (title or "")
                f[1] |= term in (desc or "")
                f[2] |= any(term in h for h in heads)
                f[3] |= term in url
    assert set(got) == set(count)
    for key, r in got.items():
        assert (r["count"], r.n_pages) == (count[key], len(pages[key]))
        assert tuple(r.first_seen) == first[key]
        assert [r.in_title, r.in_meta, r.in_headings, r.in_url] == flags[key]
        assert abs(r.density - count[key] / total[key[0]] * 100) <= 0.005001
    rows = K.keyword_pages(texts(spark, ROWS)).collect()
    assert {(r.site, r.keyword, r.url) for r in rows} == {(s, k, u) for (s, k), us in pages.items() for u in us}


def test_ranking_ties_gaps_and_vocabulary(spark):
    tok = texts(spark, ROWS)
    table = K.keyword_table(tok)
    first = [r.keyword for r in K.primary_keywords(table).where("site = 's'").orderBy("rank").collect()]
    assert first[:3] == ["guide", "pricing", "seo"]
    gaps = [r.keyword for r in K.keyword_gaps(table, tok).where("site = 's'").orderBy("rank").collect()]
    assert gaps[:3] == ["tutorial", "top", "review"] and "guide" not in gaps and "how to" in gaps and len(gaps) == 10
    vocab = {r.site: (r.total_tokens, r.unique_tokens) for r in K.vocabulary(tok).collect()}
    assert vocab["t"] == (4, 3)
    lsi = {r.keyword for r in K.lsi_keywords(table).collect()}
    assert not lsi & {r.keyword for r in K.secondary_keywords(table).collect()}


def test_document_counts_on_samples(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = Counter()
    for r in docs.collect():
        want.update((r.source, t) for _, _, t in brute_terms(brute_tokens(r.text)))
    got = {(r.site, r.keyword): r["count"] for r in K.keyword_table(K.tokens(K.document_text(docs))).collect()}
    # Python lower-cases a dotted capital I to two characters; no such letter is in the data.
    assert got == dict(want)


def test_readability_edges(spark):
    def band(words, sentences, syllables):
        e = reading_ease(str(words), str(sentences), str(syllables))
        return spark.range(1).select(F.expr(readability_band(e))).first()[0]

    assert band(0, 1, 0) == "N/A"
    assert band(10, 1, 10) == "Very Easy (5th grade)"
    assert band(100, 1, 300) == "Very Difficult (Graduate level)"
    m = spark.createDataFrame([("<p>One two.</p> three!! <br>",), ("<b></b>",)], "h string").select(F.expr(content_metrics(visible_text("h")))).collect()
    # "One two. three!!": o-e, o, ee.
    assert tuple(m[0][0]) == (3, 16, 2, 4) and tuple(m[1][0]) == (0, 0, 1, 0)


def test_counts_by_chunk_equal_the_occurrences(spark, monkeypatch):
    """Rows of equal and null ids, null texts and sites, hyphens and placement, in chunks of a row or of all rows."""
    rows = [
        ("a", 1, "u/Hello-World", "hello world", "guide", ["big hello"], "Hello hello world guide hello world the big"), ("a", 2, "x/guide", None, None, [], "guide guide hello world"),
        ("a", None, "x/guide", None, None, [], "zebra guide hello world"), (None, 3, None, None, None, [None, "zebra"], "--- -zebra zebra- xylo guide"), ("b", 4, "q", "t", "d", ["h"], None),
        ("b", 7, "q", "cat", "d", None, "straße cat-dog -- --abc"), ("a", 1, "u", "", "", [""], "big hello world hello"), ("b", 7, "q", "cat", "d", None, "dog cat cat"), ("c", 9, "q", "t", "d", [], ""),
    ]
    tokenized = K.tokens(spark.createDataFrame(rows, "site string, ord long, url string, title string, description string, headings array<string>, text string").coalesce(1))
    plain = K.occurrences(tokenized).groupBy("site", "term", "n").agg(
        F.count("*").alias("count"), F.expr("sum(int(is_first))").alias("n_pages"), F.min(F.expr(K.FIRST_SEEN)).alias("seen"), *[F.max(f).alias(f) for f in K.FLAGS]
    )
    place = "cast(seen as bigint) as ord", "cast((seen - floor(seen)) * 10000000000 as int) as pos"
    want = sorted(map(repr, plain.selectExpr("site", "term as keyword", "n", "count", "n_pages", *place, *K.FLAGS).collect()))
    table = K.keyword_table(tokenized).selectExpr("site", "keyword", "n", "count", "n_pages", "first_seen.ord as ord", "first_seen.pos as pos", *K.FLAGS)
    assert sorted(map(repr, table.collect())) == want

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["abc def", None, "ghi"])})
    monkeypatch.setattr(K, "CHUNK_BYTES", 1)
    assert [c.num_rows for c in K.chunks(batch)] in ([1, 1, 1], [1, 2], [2, 1])


def test_a_task_counts_phrases_once(spark):
    """What is dealt out is a row for each phrase of a chunk, not one for each occurrence."""
    texts = spark.createDataFrame([("s", k, "alpha beta gamma alpha beta gamma") for k in range(50)], "source string, doc_id long, text string").coalesce(1)
    plan = K.keyword_table(K.tokens(K.document_text(texts)))._jdf.queryExecution().executedPlan().toString()
    assert "inline" not in plan and "MapInArrow" in plan


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path):
    """An input of any size is dealt out by its bytes, though it lies in one row group."""
    from pagelens.session import spread

    spark.range(200_000).selectExpr("id", "uuid() as body").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert size > 64 * cores << 10
    parts = spread(df, 64 << 10).rdd.getNumPartitions()
    assert parts >= size // (64 << 10) and spread(df, 1 << 40).rdd.getNumPartitions() == max(cores, df.rdd.getNumPartitions())


def moved(plan):
    """Bytes that the shuffles of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return moved(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return moved(plan.plan())
    own = plan.metrics().get("shuffleBytesWritten").get().value() if kind == "ShuffleExchangeExec" else 0
    below = plan.children()
    return own + sum(moved(below.apply(k)) for k in range(below.size()))


def test_phrases_move_in_fewer_bytes_than_their_text(spark, tmp_path):
    import random

    from pagelens.plans.registry import QUERIES

    some = random.Random(5)
    words = ["".join(some.choice("abcdefghijklmnop") for _ in range(some.randint(3, 10))) for _ in range(4000)]
    rows = [(k, " ".join(some.choice(words) for _ in range(600)), f"s{k % 5}") for k in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["document_keyword_count"](spark, str(tmp_path)).selectExpr("sum(count) as n", "count(*) as rows")
    n = found.first().n
    want = sum(1 for _, text, _ in rows for _ in brute_terms(brute_tokens(text)))
    assert n == want and moved(found._jdf.queryExecution().executedPlan()) == 0  # first() runs a plan of its own
    found.collect()
    assert 0 < moved(found._jdf.queryExecution().executedPlan()) < 2.5 * sum(len(text) for _, text, _ in rows)


def test_buckets_hold_every_phrase_once(monkeypatch):
    """Phrases of several chunks, of common and other first words, of null sites and with wide numbers, meet once each."""
    import random

    import pyarrow as pa

    some = random.Random(3)
    words = ["alpha", "beta-gamma", "the", "delta", "epsilon", "zeta", "of", "x-ray"] + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows = [(some.choice(["a", "b", None, ""]), k, " ".join(some.choice(words[:8] if some.random() < 0.5 else words) for _ in range(some.randint(0, 60)))) for k in range(200)]
    rows += [("a", 1 << 40, None), ("c", -5, "alpha delta"), ("c", None, "alpha delta delta")]
    none = [None] * len(rows)
    table = {"site": [r[0] for r in rows], "ord": pa.array([r[1] for r in rows], pa.int64()), "title": pa.array(none, pa.string()), "description": pa.array(none, pa.string()),
             "headings": pa.array(none, pa.list_(pa.string())), "url": [f"u/{'delta' if k % 50 == 0 else ''}" for k in range(len(rows))], "text": pa.array([r[2] for r in rows], pa.string())}
    batches = pa.Table.from_pydict(table).to_batches(max_chunksize=17)
    want = {}
    for k, (site, order, text) in enumerate(rows):
        for n, pos, term in brute_terms(brute_tokens(text or "")):
            x = want.setdefault((site, term, n), [0, set(), [], False])
            x[0] += 1
            x[1].add(k)
            x[2] += [(order, pos)] if order is not None else []
            x[3] |= n == 1 and term in table["url"][k]
    for chunk_bytes in (1, 900, 1 << 20):
        monkeypatch.setattr(K, "CHUNK_BYTES", chunk_bytes)
        for placed in (False, True):
            sent = pa.Table.from_batches(K.part_counts(iter(batches), [7, 3, 9], ["alpha", "delta"], (1, 2, 3), placed))
            got = {}
            for bucket in (7, 3, 9):
                mine = sent.filter(pa.compute.equal(sent["bucket"], bucket))
                assert mine.num_rows
                for r in (r for rb in K.merged(iter(mine.to_batches()), placed) for r in rb.to_pylist()):
                    assert (r["site"], r["term"], r["n"]) not in got
                    got[r["site"], r["term"], r["n"]] = r
            assert set(got) == set(want)
            for key, (count, pages, seen, in_url) in want.items():
                assert (got[key]["count"], got[key]["n_pages"]) == (count, len(pages))
                if placed:
                    assert (got[key]["ord"], got[key]["pos"] if seen else 0) == (min(seen) if seen else (None, 0)) and got[key]["in_url"] == in_url and not got[key]["in_title"]
    once = [r for rb in K.part_counts(iter(batches), [0], [], (1,), False) for r in rb.to_pylist()]
    assert {r["n"] for rb in K.merged(iter([pa.RecordBatch.from_pylist(once)]), False) for r in rb.to_pylist()} == {1}


def test_a_common_word_does_not_fill_a_bucket():
    import numpy as np
    import pyarrow as pa

    words = pa.array([f"word{k}" for k in range(1000)], pa.large_string())
    found = {"w1": np.ones(1000, np.int32), "w2": np.arange(1, 1001, dtype=np.int32), "w3": np.zeros(1000, np.int32), "site": np.zeros(1000, np.int32)}
    plain, dealt = (np.bincount(K.share_of(words, pa.array(["s"]), found, 10, common), minlength=10) for common in ([], ["word0"]))
    assert plain.max() == 1000 and dealt.max() < 200


def test_keys_beyond_64_bits_stay_apart():
    import numpy as np
    import pyarrow as pa

    key = K.next_key(np.array([1 << 61, 5, 1 << 61, 7]), 1 << 20, np.array([3, 3, 3, 4]))
    assert key[0] == key[2] > key[3] > key[1]
    words, sites = pa.array([f"w{k}" for k in range(3_000_000)], pa.large_string()), pa.array(["a", "b"], pa.large_string())
    found = {"w1": [5, 5, 5, 6], "w2": [2_999_999] * 4, "w3": [7, 7, 8, 7], "site": [1, 1, 1, 0], "count": [1, 2, 4, 8], "n_pages": [1] * 4}
    rows = [r for rb in K.merged_share(words, sites, {k: np.array(v, np.int32) for k, v in found.items()}, False) for r in rb.to_pylist()]
    assert sorted((r["term"], r["site"], r["count"]) for r in rows) == [("w4 w2999998 w6", "a", 3), ("w4 w2999998 w7", "a", 4), ("w5 w2999998 w6", None, 8)]


def test_tokens_between_hyphens():
    import random

    import pyarrow as pa

    some = random.Random(9)
    texts = ["".join(some.choice("ab-- é.") for _ in range(some.randint(0, 40))) for _ in range(3000)] + ["", "---", "abc-", "-def", "--abc--", "ab-", "-c", "a--b"]
    tokens, size = K.text_tokens(pa.array(texts))
    assert size.tolist() == [len(brute_tokens(t)) for t in texts] and tokens.to_pylist() == [w for t in texts for w in brute_tokens(t)]


def test_buckets_are_dealt_to_partitions_of_their_own(spark):
    keys = K.even_keys(spark, 7)
    parts = spark.createDataFrame([(k,) for k in keys], "bucket long").repartition(7, "bucket").selectExpr("spark_partition_id() as p").distinct()
    assert len(set(keys)) == 7 and parts.count() == 7
