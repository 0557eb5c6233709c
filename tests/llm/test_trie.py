"""The z-fast trie against brute force."""

import hashlib
import random
import zlib

import pytest

from pagelens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, x string, depth string, host long, n_convs long"


def brute(rows):
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    members = {}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    children, out = {}, set()
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in range(0, 420):
        if c in (100, 257) or r.random() < 0.1:
            continue
        for t in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]) if r.random() < 0.3 else "user", r.choice(["a", "é", "same text", ""]) if t else "hello"))
    trunk = [(t, "user", f"turn {t}") for t in range(70)]
    for k in range(60):  # a comb: one trunk, cut everywhere, some with an own end
        rows += [(100_000 + 1000 * k, t, role, text) for t, role, text in trunk[: k + 5]]
        rows += [(100_000 + 1000 * k, 99, "user", f"end {k}")] * (k % 2)
    for k in range(150):  # copies
        rows += [(500_000 + 700 * k, t, "user", "copy") for t in range(8)]
    return rows + [(1, None, None, None), (1, None, "a", None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 0, "user", "hello"), (999_900, 0, "user", "x" * 200_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "d", k, k) for k, row in enumerate(rows)], SCHEMA).repartition(5)


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"growth": 3, "first": 9})])
def test_trie_matches_brute_force(spark, seed, how):
    rows = conversations(seed)
    got = [tuple(x) for x in trie.conversation_trie(frame(spark, rows), **how).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want


def test_edges_of_the_table(spark):
    assert trie.conversation_trie(frame(spark, []).limit(0)).count() == 0
    assert trie.conversation_trie(frame(spark, [(None, 0, "user", "a")])).count() == 0
    rows = [(c, 0, "user", "a") for c in (3, 4, 9, 11, 205, 206)]  # most have no turn left
    assert {tuple(x) for x in trie.conversation_trie(frame(spark, rows)).collect()} == brute(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.two_fattest("a", "b").alias("f")).collect()
    assert all(x.f == max(range(x.a + 1, x.b + 1), key=lambda n: n & -n) for x in got)
