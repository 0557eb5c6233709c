"""Toxicity classifier: a logistic model whose score must not move when identity terms are swapped.

Features are the presence of a word or of a word's beginning (4 to 6 letters, for inflected insults).
The most telling ones are counted with DataFrame operations over a bounded, class-balanced sample of the
labelled rows (`sample_per_class`, the rows with the smallest hash). For every sentence of that sample
which names a group, the term is exchanged for another group's and for none; the squared change of the
score is added to the loss with weight `counterfactual`. The change is linear in the weights, so the
penalty is a matrix that the tasks sum up, and a group's name alone cannot carry a verdict.

Defined results
  * null and empty texts have no feature: their score is that of the intercept;
  * a null label is no label; a doc_id with several label rows counts once for each; null ids never train;
  * without training rows of both classes the score is the share of label 1 among what there is (0 with none);
  * repeated rows are scored each for itself; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.shared import is_remainder, stored, text_batches, text_of

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
SHORTEST, LONGEST = 4, 6
IDENTITY_TERMS = (
    "women", "men", "black", "white", "asian", "latino", "arab", "african", "european", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu",
    "buddhist", "atheist", "gay", "lesbian", "bisexual", "transgender", "straight", "deaf", "blind", "disabled", "elderly", "young", "immigrant", "immigrants",
    "refugee", "refugees", "frauen", "männer", "juden", "muslime", "christen", "schwarze", "femmes", "hommes", "juifs", "musulmans", "noirs", "mujeres", "hombres",
    "judíos", "musulmanes", "negros",
)


def word_features(word: str) -> list[str]:
    """`word$` for the whole word and its beginnings."""
    return [word + "$", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def text_features(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())):
        out.update(word_features(w))
    return out


@dataclass(frozen=True)
class Lexicon:
    """Weights of the chosen features; `opening` are the first letters that any of them has."""

    index: dict[str, int]
    weights: np.ndarray
    intercept: float
    flat: float | None = None

    def found(self, words: set[str]) -> set[int]:
        if not self.index:
            return set()
        opening = self.opening
        hits = (f for w in words if w[:SHORTEST] in opening for f in word_features(w))
        return {self.index[f] for f in hits if f in self.index}

    @property
    def opening(self) -> frozenset[str]:
        if "_opening" not in self.__dict__:
            object.__setattr__(self, "_opening", frozenset(f.rstrip("$")[:SHORTEST] for f in self.index))
        return self.__dict__["_opening"]

    def score(self, text: str) -> float:
        if self.flat is not None:
            return self.flat
        z = self.intercept + sum(self.weights[k] for k in self.found(set(WORD.findall(text.lower()))))
        return float(1.0 / (1.0 + np.exp(-max(-500.0, min(500.0, z)))))


def sampled(docs: DataFrame, known: DataFrame, per_class: int) -> DataFrame:
    """(y, t) of at most `per_class` labelled documents of each class. Only ids are sorted; the ids are few by that bound."""
    picks = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picks = one if picks is None else picks.unionByName(one)
    return docs.select(docs["doc_id"].alias("id"), text_of(docs).alias("t")).join(F.broadcast(picks), "id").select("y", "t")


def telling_features(sample: DataFrame, sizes: tuple[int, int], count: int, least: int, z: float) -> list[str]:
    """The `count` features that differ most between the classes, by the z value of their document shares."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(text_features(t)) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], ["y", "fs"])

    seen = sample.mapInArrow(batches, "y int, fs array<string>").select("y", F.explode("fs").alias("f"))
    counts = seen.groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= least)
    n0, n1 = sizes
    share = (F.col("a") + F.col("b")) / (n0 + n1)
    value = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share + 1e-9) * (1.0 / n0 + 1.0 / n1))
    top = counts.select("f", value.alias("z")).where(F.col("z") >= z).orderBy(F.desc("z"), "f").limit(count)
    return [r["f"] for r in top.collect()]


def swaps(text: str, terms: tuple[str, ...]) -> Iterator[tuple[set[str], set[str]]]:
    """Word sets of each sentence that names a group, and of the same sentence with another group and with none."""
    place = {t: k for k, t in enumerate(terms)}
    for sentence in SENTENCE.findall(text.lower()):
        words = set(WORD.findall(sentence))
        for w in sorted(words & place.keys()):
            rest = words - {w}
            yield words, rest | {terms[(place[w] + 1) % len(terms)]}
            yield words, rest


def design(sample: DataFrame, lexicon: Lexicon, terms: tuple[str, ...]) -> tuple[list[tuple[int, list[int]]], np.ndarray]:
    """Rows (label, features) of the sample, and the summed outer products of all counterfactual differences."""
    k = len(lexicon.index)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram: dict[tuple[int, int], float] = {}
        shape = pa.schema([("y", pa.int32()), ("fs", pa.list_(pa.int32())), ("v", pa.float64())])
        named = set(terms)
        for batch in it:
            rows = []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(t.lower()))
                rows.append({"y": y, "fs": sorted(lexicon.found(words)), "v": None})
                for a, b in swaps(t, terms) if words & named else ():
                    fa, fb = lexicon.found(a), lexicon.found(b)
                    diff = [(f, 1.0) for f in fa - fb] + [(f, -1.0) for f in fb - fa]
                    for i, x in diff:
                        for j, z in diff:
                            gram[i, j] = gram.get((i, j), 0.0) + x * z
            yield pa.RecordBatch.from_pylist(rows, schema=shape)
        yield pa.RecordBatch.from_pylist([{"y": None, "fs": [i, j], "v": v} for (i, j), v in gram.items()], schema=shape)

    rows, penalty = [], np.zeros((k, k))
    for r in sample.mapInArrow(batches, "y int, fs array<int>, v double").collect():  # at most two classes of the bounded sample, and k x k
        if r["y"] is None:
            penalty[tuple(r["fs"])] += r["v"]
        else:
            rows.append((r["y"], r["fs"]))
    return rows, penalty


def newton(rows: list[tuple[int, list[int]]], penalty: np.ndarray, ridge: float, counterfactual: float, prior: float = 0.3, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic loss; label 1 has the share `prior` of the weight, however rare it is."""
    k = len(penalty)
    x = np.zeros((len(rows), k + 1))
    x[:, k] = 1.0
    for i, (_, fs) in enumerate(rows):
        x[i, fs] = 1.0
    y = np.array([r[0] for r in rows], float)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    fixed = np.zeros((k + 1, k + 1))
    fixed[:k, :k] = ridge * np.eye(k) + counterfactual * penalty
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + fixed @ w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + fixed + 1e-6 * np.eye(k + 1)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:k], float(w[k])


def fit(
    docs: DataFrame, known: DataFrame, sample_per_class: int = 3000, features: int = 400, least: int = 4, z: float = 5.0, ridge: float = 0.02,
    counterfactual: float = 1.0, terms: tuple[str, ...] = IDENTITY_TERMS,
) -> Lexicon:
    """`known`: rows (id, y) that may train."""
    text_batches(docs.sparkSession)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    if not n.get(0) or not n.get(1):
        return Lexicon({}, np.zeros(0), 0.0, flat=n.get(1, 0) / total if total else 0.0)
    sample = stored(sampled(docs, known, sample_per_class), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon({}, np.zeros(0), 0.0, flat=n[1] / total)
    chosen = telling_features(sample, (sizes[0], sizes[1]), features, least, z)
    blank = Lexicon({f: i for i, f in enumerate(chosen)}, np.zeros(len(chosen)), 0.0)
    rows, penalty = design(sample, blank, terms)
    weights, intercept = newton(rows, penalty, ridge, counterfactual)
    return Lexicon(blank.index, weights, intercept)


def with_scores(docs: DataFrame, model: Lexicon, text_column: str = "text", score: str = "score") -> DataFrame:
    """(doc_id, score) of every whole text."""
    text_batches(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", score])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs, text_column).alias("t")).mapInArrow(batches, f"doc_id {kind}, {score} double")


def training_rows(labels: DataFrame, label_column: str, folds: int, held_out: int) -> DataFrame:
    known = labels.where(F.col(label_column).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label_column).cast("int").alias("y"))
    return known.where(F.col("id").isNotNull() & ~is_remainder(F.col("id"), folds, held_out))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label_column: str = "toxic", folds: int = 3, held_out: int = 1, threshold: float = 0.7, sample_per_class: int = 3000, **options
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows of the held-out fold never train."""
    model = fit(docs, training_rows(labels, label_column, folds, held_out), sample_per_class, **options)
    scored = with_scores(docs, model)
    return scored.select("doc_id", is_remainder(F.col("doc_id"), folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """`docs` without the documents that the classifier rejects; every other row stays, null ids and repeated rows too."""
    model = fit(docs, training_rows(labels, "toxic", 3, 1), **options)

    def verdicts(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([model.score(t or "") < threshold for t in texts], dtype=bool)

    verdicts.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(verdicts, "boolean")(docs["text"].cast("string")))
