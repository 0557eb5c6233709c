"""Counting quotient filters and phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pagelens.llm import collocations, quotient
from tests.llm.data import documents, mixed_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("bits", [2, 6, 16, 20, 22, 30, 42])
def test_permutation_is_invertible(bits):
    r = np.random.default_rng(bits)
    ids = [r.integers(0, 1 << bits, 500).astype(np.int64) for _ in range(3)]
    high, low = quotient.permuted(ids, bits)
    assert all((a == b).all() for a, b in zip(ids, quotient.restored(high, low, bits)))
    assert len({*zip(high.tolist(), low.tolist())}) == len({*zip(*(x.tolist() for x in ids))})


@pytest.mark.parametrize("bits, prefix", [(2, 0), (8, 3), (16, 6), (22, 0), (30, 9), (42, 20)])
def test_filters_hold_every_count(bits, prefix):
    r = np.random.default_rng(prefix)
    ids = [r.integers(0, min(1 << bits, 900), 3000).astype(np.int64) for _ in range(3)]
    counts = r.choice([1, 1, 1, 2, 255, 256, 257, 70000, 1 << 40], 3000).astype(np.int64)
    high, low, sums = quotient.counted(*quotient.permuted(ids, bits), counts)
    want = Counter()
    for *key, c in zip(*(x.tolist() for x in ids), counts.tolist()):
        want[tuple(key)] += c
    got = {}
    for top, data in quotient.split(high, low, sums, bits, prefix):
        f = quotient.Filter(data)
        h, l, c = f.items()
        assert f.top == top and f.entries == len(c)
        got |= zip(zip(*(x.tolist() for x in quotient.restored(h, l, bits))), c.tolist())
        for k in range(0, len(c), 37):
            assert f.count(int(h[k]), int(l[k])) == c[k]
        absent = [x for x in range(int(l[0]) + 1, int(l[0]) + 5) if x not in set(l.tolist())]
        assert all(f.count(int(h[0]), x) == 0 for x in absent)
    assert got == dict(want)


def test_filters_merge_as_lists():
    r = np.random.default_rng(4)
    shards = [quotient.counted(*quotient.permuted([r.integers(0, 12, 800).astype(np.int64) for _ in range(3)], 4)) for _ in range(5)]
    h, l, c = quotient.merged([quotient.build(*s, 4, 0) for s in shards])
    want = Counter()
    for _, low, counts in shards:
        for a, n in zip(low.tolist(), counts.tolist()):
            want[a] += n
    assert dict(zip(l.tolist(), c.tolist())) == want and (np.diff(l.astype(np.int64)) > 0).all()


def test_parts_cut_behind_pieces():
    text = ("word " * 30 + ". ").encode() * 20 + b"x" * 1000
    cut = list(collocations.parts(text, 400))
    assert b"".join(cut) == text and len(cut) > 5 and all(p.rstrip().endswith(b".") or p is cut[-1] for p in (x.rstrip(b" ") for x in cut[:-1]))
    assert list(collocations.parts(b"x" * 1000 + b".a b", 100)) == [b"x" * 1000 + b".", b"a b"] and list(collocations.parts(b"", 9)) == []


def brute(rows, least, percent, most):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= percent * a for q, b in c.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def corpus():
    r, few = random.Random(8), ["al", "Be", "ce", "dü", "e f", "퟿"]
    rows = [("en", t) for _, t in mixed_rows()] + [(None, prose(k, 80)) for k in range(6)] + [("und", prose(3, 50)), ("de", None), ("fr", ""), ("xx", "\t .. ,")]
    rows += [("de", "".join(r.choice(few) + r.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for _ in range(r.randint(1, 400)))) for _ in range(12)]
    return rows + [("es", "uno dos tres. ") for _ in range(40)] + [("es", "uno dos, tres dos tres") for _ in range(30)]


@pytest.mark.parametrize("least, percent, most, how", [(10, 50, 2000, {}), (3, 70, 40, {"least_bits": 36}), (2, 50, 2000, {"block": 40})])
def test_collocations_match_brute_force(spark, monkeypatch, least, percent, most, how):
    if how:
        monkeypatch.setattr(collocations, "CHUNK_BYTES", 900)
    rows = corpus()
    docs = spark.createDataFrame([(k, t, lang, "f", 1.0, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, f double, top string").repartition(5)
    got = collocations.collocations(docs, least, percent, most, **how)
    assert {tuple(r) for r in got.collect()} == brute(rows, least, percent, most)


def test_no_phrases(spark):
    empty = documents(spark, [(1, None), (2, "one word")])
    assert collocations.collocations(empty).count() == 0 and collocations.collocations(empty.limit(0)).count() == 0
