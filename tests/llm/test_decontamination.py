"""Leaks: exact copies and paraphrases are found, shared vocabulary is not."""

import random

import numpy as np
import pyarrow as pa

from pagelens.llm import decontaminate
from tests.llm.data import documents, mixed_rows, prose

ITEM_WORDS = [a + b + c for a in ("qua", "zor", "fen", "jul") for b in ("mi", "ta", "bo") for c in ("k", "st", "rn", "ll", "x")]


def setting(spark):
    items = [(k, prose(7000 + k, 12 + 3 * k, ITEM_WORDS)) for k in range(12)] + [(50, None), (51, ""), (None, prose(1, 20)), (52, "!!! ...")]
    docs = mixed_rows() + [(100 + k, prose(k + 60, 150)) for k in range(60)]
    r = random.Random(4)
    wanted = set()
    for k in range(12):
        words = prose(900 + k, 120).split()
        at = r.randrange(100)
        docs.append((400 + k, " ".join(words[:at] + items[k][1].upper().split() + words[at:])))
        wanted.add((400 + k, k))
        changed = items[k][1].split()
        for j in range(2, len(changed), 6):
            changed[j] = r.choice(["other", "words", "here"])
        docs.append((500 + k, " ".join(words[:at] + changed + words[at:])))
        wanted.add((500 + k, k))
        mixed = items[k][1].split()
        r.shuffle(mixed)
        docs.append((600 + k, " ".join(words[:at] + mixed[: len(mixed) // 3] + words[at:])))
    return documents(spark, docs), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, z int"), wanted


def crowded():
    """Nine short items, 40 long ones, documents with copies of the short ones, and the pairs."""
    words = [a + b + c for a in ITEM_WORDS for b in ("a", "o") for c in ("n", "th", "mm")]
    items = [(k, prose(8000 + k, 10 + k % 7, [f"s{k}{w}" for w in words])) for k in range(9)] + [(100 + k, prose(8100 + k, 120, words)) for k in range(40)]
    docs, wanted = [(k, prose(k + 60, 150)) for k in range(60)], set()
    for k in range(9):
        around = prose(9000 + k, 120).split()
        docs.append((1000 + k, " ".join(around[:40] + items[k][1].split() + around[40:])))
        wanted.add((1000 + k, k))
    return items, docs, wanted


def test_leaks_are_found(spark):
    docs, items, wanted = setting(spark)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == wanted
    assert all(got[400 + k, k].lcs_share == 1.0 for k in range(12))
    small = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, block_items=5).collect()}
    assert small == wanted
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 24


def test_leaks_of_nothing(spark):
    docs, items, _ = setting(spark)
    assert decontaminate.leaks(documents(spark, []), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_lcs():
    r = random.Random(2)
    for _ in range(50):
        a, b = [r.randrange(5) for _ in range(r.randrange(12))], [r.randrange(5) for _ in range(1 + r.randrange(12))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.lcs(a, decontaminate.bit_positions(b), len(b)) == table[-1, -1]


def test_the_bound_loses_no_candidate(spark):
    docs, items, _ = setting(spark)
    block = next(decontaminate.benchmark_blocks(items, 250))
    space = decontaminate.latent_space(docs, block, 16, 40, 2, 0.4, 0.6, 0.5)
    ids, counts = decontaminate.text_words(pa.array([r.text for r in docs.collect()]))
    numbers = space.vocabulary.numbers(ids)

    def close(reach):
        text, start, _, norm, w, word, weight = decontaminate.passages(numbers, counts, space.idf, space.other, 16, reach)
        folded = decontaminate.summed(w, space.basis[word] * weight[:, None], len(text)) / norm[:, None]
        r, p = np.nonzero(folded @ space.latent.T >= 0.4)
        return set(zip(start[r].tolist(), p.tolist()))

    assert close(None) == close(space.reach) and close(None)


def test_short_items_among_many_long_ones(spark):
    """More passages than `rank`: copies of the short items are found as well."""
    items, docs, wanted = crowded()
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), rank=30).collect()}
    assert got == wanted


def test_passages_keep_their_length(spark):
    items, docs, _ = crowded()
    long = (901, prose(1, 900))
    runs = list(decontaminate.by_passages([*items, (900, ""), long], 16, 30))
    assert [i for run in runs for i in run] == [*items, long]
    counts = [[len(decontaminate.window_starts(len(t.split()), 16)) for _, t in run] for run in runs]
    assert len(runs) > 2 and all(sum(c) <= 30 or len(c) == 1 for c in counts)
    for run in (runs[0], runs[-1]):
        space = decontaminate.latent_space(documents(spark, docs), run, 16, 30, 2, 0.3, 0.6, 0.5)
        ids, n = decontaminate.text_words(pa.array([t for _, t in run]))
        _, _, _, norm, w, word, weight = decontaminate.passages(space.vocabulary.numbers(ids), n, space.idf, space.other, 16)
        folded = decontaminate.summed(w, space.basis[word] * weight[:, None], len(norm))
        assert (np.linalg.norm(folded, axis=1) / np.sqrt(np.bincount(w, weight**2))).min() > 0.99


def test_short_items_in_a_third_of_the_documents(spark):
    """Copies count whatever stands around them, at every offset, and however many documents have them."""
    items = [(k, prose(8500 + k, 9 + k, [f"s{k}{w}" for w in ITEM_WORDS])) for k in range(6)]
    docs, wanted = [(10_000 + k, prose(k + 60, 40)) for k in range(400)], set()
    for k, text in items:
        for n in range(40):
            around = [f"w{k}x{n}y{j}" for j in range(60 + n % 8)]
            docs.append((100 * k + n, " ".join(around[: 30 + n % 8] + text.split() + around[30 + n % 8 :])))
            wanted.add((100 * k + n, k))
    got = decontaminate.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted
    assert all(r.cosine > 0.99 for r in got)
    everywhere = [(k, t + " " + items[0][1]) if k % 3 else (k, t) for k, t in docs if k >= 10_000]
    got = decontaminate.leaks(documents(spark, everywhere), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, 0) for k, t in everywhere if k % 3}


def scores(space, texts):
    """(text of each window, exact and latent scores of all windows with all passages, what `passages` tells), without lists or bounds."""
    ids, counts = decontaminate.text_words(pa.array(texts))
    text, _, _, norm, w, word, weight = decontaminate.passages(space.vocabulary.numbers(ids), counts, space.idf, space.other, 16, None, 8)
    rows = np.zeros((len(text), len(space.idf)))
    rows[w, word] = weight
    over = np.minimum(norm[:, None], space.length)
    return text, rows @ space.units / over, rows @ (space.basis @ space.latent.T) / over, (norm, w, word, weight)


def paraphrases():
    """Nine short items and eight long ones, and documents with the long ones, every third word replaced."""
    items, docs, _ = crowded()
    items = items[:17]
    for k, text in items[9:]:
        words = text.split()
        words[k % 3 :: 3] = [f"r{k}x{j}" for j in range(len(words[k % 3 :: 3]))]
        docs.append((2000 + k, " ".join(words)))
    return items, docs


def test_the_truncated_space_retrieves(spark):
    """Fewer directions than passages, pairs only through them, no exact candidate lost, latent ones besides."""
    items, docs = paraphrases()
    space = decontaminate.latent_space(documents(spark, docs), items, 16, 1000, 2, 0.3, 0.6, 0.5)
    assert space.basis.shape[1] == space.latent.shape[1] < 0.95 * len(space.length)
    near = space.basis @ space.latent.T
    assert 0.01 < ((space.units - near) ** 2).sum(axis=0).max() <= decontaminate.TAIL + 1e-3
    _, exact, latent, windows = scores(space, [t for _, t in docs])
    got = {(k, p): s for ks, ps, ss in decontaminate.retrieved(*windows, space, step=50) for k, p, s in zip(ks.tolist(), ps.tolist(), ss.tolist())}
    assert set(zip(*(x.tolist() for x in np.nonzero((exact >= 0.3 + 1e-5) | (latent >= 0.3 + 1e-5))))) <= set(got)
    assert all(max(exact[pair], latent[pair]) >= 0.3 - 1e-5 for pair in got)
    assert all(abs(s - (exact if exact[pair] >= 0.3 else latent)[pair]) < 1e-4 for pair, s in got.items() if abs(exact[pair] - 0.3) > 1e-5)
    assert any(exact[pair] < 0.29 for pair in got) and any(latent[pair] < 0.299 for pair in got)


def test_a_leak_that_only_the_latent_space_reaches(spark):
    """The limit lies between the best exact and the best latent score of a document's windows with its item."""
    items, rows = paraphrases()
    docs, table = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    space = decontaminate.latent_space(docs, items, 16, 1000, 2, 0.3, 0.6, 0.5)
    known = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table).collect()}
    text, exact, latent, _ = scores(space, [t for _, t in rows])
    best = []
    for n, (doc, _) in enumerate(rows):
        if (doc, doc - 2000) in known:
            own = np.ix_(text == n, [items[i][0] == doc - 2000 for i in space.passage_item])
            best.append((latent[own].max() - exact[own].max(), exact[own].max(), latent[own].max(), doc))
    gap, low, high, doc = max(best)
    assert gap > 0.002
    limit = float(low + high) / 2
    got = {(r.doc_id, r.item_id): r.cosine for r in decontaminate.leaks(docs, table, cosine=limit).collect()}
    assert limit < got[doc, doc - 2000] <= high + 1e-4
