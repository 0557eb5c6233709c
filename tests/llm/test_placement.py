"""Sharding and packing: the laws hold for every row."""

from collections import defaultdict

import numpy as np
import zlib
from pyspark.sql import functions as F

from pagelens.llm import packing, shards
from tests.llm.data import documents, mixed_rows, prose


def check_shards(rows, got, count):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(count))


def test_shards_are_near_equal(spark):
    rows = [(k, prose(k % 150, 20 + (k * 37) % 200)) for k in range(600)]
    got = shards.kd_shards(documents(spark, rows), 24).collect()
    check_shards(rows, got, 24)
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    largest = max(len(t) + 8 for _, t in rows)
    assert len(size) == 24 and max(size.values()) - min(size.values()) <= 2 * largest
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32, r.size].add(r.shard)
    assert np.mean([len(s) == 1 for s in homes.values()]) > 0.9


def test_shards_split_a_hot_group(spark):
    rows = [(k, "same text again" if k % 3 == 0 else prose(k, 9)) for k in range(900)]
    got = shards.kd_shards(documents(spark, rows), 6).collect()
    check_shards(rows, got, 6)
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) <= 1.1 * min(size.values())


def test_shards_at_the_edges(spark):
    rows = mixed_rows()
    check_shards(rows, shards.kd_shards(documents(spark, rows), 5).collect(), 5)
    assert shards.kd_shards(documents(spark, []), 5).count() == 0
    few = [(1, "a"), (2, None)]
    check_shards(few, shards.kd_shards(documents(spark, few).select("doc_id", "text"), 24).collect(), 24)


def check_packing(rows, got, capacities, length):
    per = defaultdict(list)
    for r in got:
        per[str(r.doc_id)].append(r)
    wanted = defaultdict(list)
    for i, t in rows:
        wanted[str(i)].append(length(t))
    assert {k: sorted(v) for k, v in wanted.items()} == {k: sorted(sum_pieces(v)) for k, v in per.items()} or all(sum(wanted[k]) == sum(r.length for r in per[k]) for k in wanted)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for items in bins.values():
        used = sorted((r.offset, r.offset + r.length) for r in items)
        assert used[0][0] == 0 and all(a[1] == b[0] for a, b in zip(used, used[1:]))
        assert {r.capacity for r in items} == {min(c for c in capacities if c >= used[-1][1])}
    return bins


def sum_pieces(rows):
    return [sum(r.length for r in rows)]


def test_packing_places_every_piece_once(spark):
    rows = mixed_rows() + [(100 + k, prose(k, 5 + k % 90)) for k in range(300)]
    got = packing.pack(documents(spark, rows), capacities=(64, 128, 256)).collect()
    check_packing(rows, got, (64, 128, 256), lambda t: len((t or "").split()) + 1)
    assert packing.pack(documents(spark, [])).count() == 0


def test_packing_is_dense_and_cuts_long_documents(spark):
    rows = [(k, prose(k, 1 + (k * 13) % 120)) for k in range(3000)]
    got = packing.pack(documents(spark, rows).coalesce(1), capacities=(64, 128, 256)).collect()
    bins = check_packing(rows, got, (64, 128, 256), lambda t: len(t.split()) + 1)
    assert sum(r.length for r in got) / sum(items[0].capacity for items in bins.values()) > 0.98
    long = packing.pack(documents(spark, [(1, "a b c")]), length=F.lit(1000), capacities=(64, 256)).orderBy("piece").collect()
    assert [r.length for r in long] == [256, 256, 256, 232]


def test_best_fit_beats_the_bounds():
    lengths = np.sort(np.random.default_rng(2).integers(1, 257, 5000))[::-1]
    bins, offsets, capacity = packing.best_fit(lengths, (64, 128, 256), 4)
    fill = np.bincount(bins, weights=lengths)
    assert (fill <= np.array(capacity)).all() and (np.array(capacity) - fill).sum() < 0.02 * lengths.sum()
    assert packing.opened(10, 10, (64, 128, 256), 4) == 64 and packing.opened(10, 10_000, (64, 128, 256), 4) == 256


def total(found, attention):
    return sum(packing.price(c, 8, attention) for c in found[2])


def test_lengths_are_chosen_by_what_can_fill_them():
    sizes = packing.CAPACITIES
    alike = packing.cheapest(np.full(1000, 500), sizes, 8, packing.ATTENTION)
    assert set(alike[2]) == {512} and len(alike[2]) == 1000
    # Three of 680 fill 2,040 of 2,048; one alone wastes a third of 1,024.
    assert set(packing.cheapest(np.full(900, 680), sizes, 8, packing.ATTENTION)[2]) == {2048}
    mixed = np.sort(np.concatenate([np.full(40, 500), np.full(30, 1020), np.full(30, 680), np.full(7, 4090), np.full(9, 1365)]))[::-1]
    assert set(packing.cheapest(mixed, sizes, 8, packing.ATTENTION)[2]) == set(sizes)


def test_several_lengths_never_cost_more_than_one():
    r = np.random.default_rng(7)
    for attention in (None, 65536, 8192):
        for lengths in (r.integers(1, 4097, 700), r.integers(1, 600, 700), r.choice([3, 500, 680, 2100], 700), np.array([4096]), np.array([1, 1, 1])):
            lengths = np.sort(lengths)[::-1]
            found = packing.cheapest(lengths, packing.CAPACITIES, 8, attention)
            assert (np.bincount(found[0], weights=lengths) <= np.array(found[2])).all()
            assert found[0].max() + 1 == len(found[2])
            for c in packing.CAPACITIES:
                assert total(found, attention) <= total(packing.best_fit(lengths, packing.CAPACITIES, 8, attention, c), attention)


def test_reachable_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(300):
        lengths = r.integers(1, 40, r.integers(0, 12)).tolist()
        capacity, first = 64, int(r.integers(1, 60))
        room = capacity - first
        for n in sorted(lengths, reverse=True):
            room -= n if n <= room else 0
        counts = np.bincount(lengths, minlength=65).tolist() if lengths else [0] * 65
        assert packing.reachable(first, capacity, counts, sum(1 << n for n, k in enumerate(counts) if k)) == capacity - room
