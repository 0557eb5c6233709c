"""Quality and toxicity: held-out accuracy, the penalty, and defined results at the edges."""

import random
import zlib

import numpy as np
import pytest

from pagelens.llm import quality, toxicity
from tests.llm.data import documents, mixed_rows, prose


def held(i, of):
    return zlib.crc32(str(i).encode()) % of


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for k in range(240):
        text = prose(k, 30 + k % 60)
        bad, rude = k % 5 == 0, k % 7 == 0
        if bad:
            text = text.upper().replace(" ", "!! ")
        if rude:
            words = text.split()
            words.insert(len(words) // 2, random.Random(k).choice(["idiot", "scum", "loweiner", "loweiung"]))
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, int(not bad), int(rude)))
    labels += [(None, 1, 1), (3, None, None), (9999, 1, 0)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates_held_out_rows(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 240
    fold = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in fold} == {k for k in range(240) if held(k, 5) == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in fold]) >= 0.95


def test_quality_ignores_labels_of_the_held_out_fold(spark, labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - quality, quality) quality", "toxic")
    a = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_discriminant_matches_the_gaussian_density():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    mean, factor = np.array([1.0, 0.0, -1.0]), np.linalg.cholesky(np.array([[2.0, 0.3, 0.0], [0.3, 1.0, 0.1], [0.0, 0.1, 0.5]]))
    model = quality.Discriminant(0.5, (0.0, 0.0), (mean, mean), (factor, factor))
    cov = factor @ factor.T
    wanted = -0.5 * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) - 0.5 * np.log(np.linalg.det(cov))
    assert np.allclose(model.log_density(x, 0), wanted)


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_at_the_edges(spark, labelled, operator):
    _, labels = labelled
    rows = mixed_rows()
    got = operator(documents(spark, rows), labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert operator(documents(spark, []), labels).count() == 0
    none = operator(documents(spark, rows[:3]), labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1


def test_toxicity_finds_words_and_beginnings(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    fold = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in fold} == {k for k in range(240) if held(k, 3) == 1}
    assert np.mean([r.predicted == int(r.doc_id % 7 == 0) for r in fold]) >= 0.95
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_counterfactual_penalty_takes_weight_from_groups(spark):
    rows, labels = [], []
    for k in range(400):
        words = prose(k, 20).split()
        rude = k % 2 == 0
        if rude:
            words.insert(5, "idiot" if k % 4 else "scum")
        if (rude and k % 6 != 0) or k % 10 == 1:
            words.insert(9, "muslim")  # the group is named mostly in rude texts
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(rude)))
    docs = documents(spark, rows)
    known = toxicity.training_rows(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", 3, 1)
    plain = toxicity.fit(docs, known, counterfactual=0.0)
    fair = toxicity.fit(docs, known, counterfactual=1.0)
    neutral = "The muslim family lives here. " + prose(1, 12)
    base = prose(1, 12)
    assert abs(fair.score(neutral) - fair.score(base)) < 0.02
    assert abs(fair.score(neutral) - fair.score(base)) < abs(plain.score(neutral) - plain.score(base))
    assert fair.score("What an idiot. " + base) > 0.7


def test_swaps_exchange_a_term_in_its_sentence():
    pairs = list(toxicity.swaps("The gay man sings. Nobody else.", ("gay", "straight")))
    assert [b for _, b in pairs] == [{"the", "straight", "man", "sings"}, {"the", "man", "sings"}]
