"""Near-duplicates, vectors and repeated substrings against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pagelens.llm import graph, minhash, shingles, substrings, vectors
from tests.llm.data import WORDS, documents, mixed_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(WORDS) + "x"
    return " ".join(w)


def near_rows():
    rows = mixed_rows()
    for k in range(40):
        rows.append((200 + k, edited(prose(k % 4 + 50, 120), k, k % 7)))
    for k in range(330):  # one large group, over several blocks
        rows.append((1000 + k, edited(prose(77, 60), k, k % 3)))
    return rows


@pytest.mark.parametrize("size, percent, hot_share", [(3, 85, minhash.HOT_SHARE), (5, 80, 30)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, size, percent, hot_share):
    monkeypatch.setattr(minhash, "HOT_SHARE", hot_share)
    rows = near_rows() + [(3000 + k, prose(91, 70)) for k in range(40)]  # a common class and many rare ones
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingle_set(t, size))
    flat = [(i, s) for i, many in sets.items() for s in many if s]
    links = [(a, b) for (a, x), (b, y) in combinations(flat, 2) if minhash.similar(len(x), len(y), len(x & y), percent)]
    root = roots(list(sets), links)
    got = minhash.near_duplicates(documents(spark, rows), size, percent).collect()
    assert len(got) == len(rows)
    wanted = sorted((str(i), len(shingle_set(t, size)), str(root.get(i)), i is None or root[i] == i) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == wanted
    one = minhash.one_of_each(documents(spark, rows), size, percent)
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted(i for i in root if root[i] == i)
    assert one.columns == documents(spark, []).columns and one.where("doc_id is null").count() == 2


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_sketch_agrees_like_the_similarity():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.concatenate([a[:600], np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64))])
    s = minhash.sketches([a, np.unique(b), a[:1], a[:3]], 400)
    assert (s != minhash._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1


def test_shingles_are_told_apart_by_text_boundaries():
    a, b, c, d = shingles.sets(pa.array(["A b c d", "a B\tc  d", "a b", "ab"]), 3)
    assert (a == b).all() and len(a) == 2 and len(c) == len(d) == 1 and c[0] != d[0]


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 60), (60, 80), (7, 7), (200, 201), (200, 202), (200, 203)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    wanted = roots({x for l in links if l[0] != l[1] for x in l}, [l for l in links if l[0] != l[1]])
    assert got == wanted
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def vector_rows():
    r = np.random.default_rng(5)
    out = []
    for k in range(300):
        v = r.normal(size=8)
        out.append((k, v.tolist(), k % 3))
        if k % 4 == 0:
            out.append((1000 + k, (v * 2 + r.normal(size=8) * 0.05).tolist(), k % 3))
        if k % 9 == 0:
            out.append((2000 + k, v.tolist(), k % 3))
    v = r.normal(size=8)
    out += [(3000 + k, (v + r.normal(size=8) * 0.06).tolist(), 1) for k in range(150)]
    out += [(1, None, 0), (4000, None, 0), (4001, [0.0] * 8, 0), (4002, [float("nan")] * 8, 0), (4003, [None] * 8, 0), (4004, [float("inf")] + [1.0] * 7, 0), (4005, [], 0), (4006, v.tolist(), None), (None, v.tolist(), 1), (4007, [1.0, 2.0], 0), (4008, [2.0, 4.0], 0), (3, out[3][1], out[3][2]), (4009, [-0.0, 1.0], 0), (4010, [0.0, 1.0], 0)]
    return out


@pytest.mark.parametrize("per_pivot, block", [(1000, 4096), (20, 16)])
def test_vectors_match_brute_force(spark, per_pivot, block):
    rows = vector_rows()
    good = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v) / np.linalg.norm(v), label)
    links = [(a, b) for a, b in combinations(sorted(good), 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.98 - 1e-15]
    ids = {i for i, _, _ in rows if i is not None}
    root = roots(ids, links)
    count = {i: 0 for i in ids}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    table = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], "vec_id long, embedding array<double>, label int, n int, body string, cell int")
    got = vectors.near_vectors(table, 0.98, per_pivot=per_pivot, block=block).collect()
    wanted = sorted((str(i), count.get(i, 0), str(root.get(i)), i is None or root[i] == i) for i, _, _ in rows)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == wanted
    assert len(links) > 1000
    assert vectors.near_vectors(table.limit(0)).count() == 0


def repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None:
                s = b[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                cover[k : k + length] = b"\1" * length
        spans = sum(cover[k] and not (k and cover[k - 1]) for k in range(len(b)))
        out.append((str(i), len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return sorted(out)


def substring_rows():
    rows = mixed_rows()
    line = "This very line stands in many of the documents here, word for word."
    for k in range(60):
        rows.append((300 + k, f"{prose(k + 400, 15)}\n{line}\n{prose(k + 500, 15)} {line}"))
    half = prose(900, 60)
    rows += [(500, half), (501, half[40:200] + "ö" * 30), (502, "ü" + half[41:120] + half[41:120]), (503, "ab" * 60), (504, "b" + "ab" * 40), (505, half[:50]), (506, half[1:50])]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 700, "hot": 5, "bucket_bytes": 60}, {"chunk_bytes": 3000, "hot": 40}])
def test_repeated_substrings_match_brute_force(spark, options):
    rows = substring_rows()
    got = substrings.repeat_report(documents(spark, rows), 50, **options).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats(rows, 50)


def test_buckets_are_even_for_least_identifiers():
    raw = np.frombuffer(np.random.default_rng(3).bytes(400_000), np.uint8)
    keys = np.unique(substrings.least(substrings.identifiers(raw, substrings.Q), 31))
    buckets = 1000
    sizes = np.bincount(substrings.place(keys, buckets), minlength=buckets)
    assert sizes.min() > 0 and sizes.max() < 3 * sizes.mean()
    few = np.bincount(substrings.place(keys, 1 << 24), minlength=1 << 24)
    assert few.max() <= 3


def test_repeats_are_cut_by_whole_characters(spark):
    rows = [(1, "é" * 40), (2, "aé" + "é" * 40 + "z"), (3, None), (4, "keep this")]
    out = substrings.without_repeats(documents(spark, rows))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == documents(spark, []).columns
    assert got[1].text == "é" * 40 and got[2].text == "az" and got[2].n_chars == 2 and got[3].text is None and got[4].key == "k"
    assert substrings.without_repeats(documents(spark, [])).count() == 0
    assert substrings.whole_characters("éé".encode(), np.array([[1, 3]])).tolist() == []
