"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

One pass turns every whole text into a short vector of statistics (shares, lengths, repetition),
each pulled towards normality by a log. Per class, the mean and covariance come from partial sums of
the labelled rows (a row per task, never the rows themselves), the covariance is shrunk towards the
diagonal of the pooled one, and its Cholesky factor is computed once and sent with the scoring tasks.
The score is a logistic of the difference of the two log densities.

Defined results
  * null and empty texts are the text without words: they have statistics and get a score;
  * a null label is no label; a doc_id with several label rows counts once for each;
  * without training rows of both classes every score is `prior` of what there is (0.5 with none);
  * a null doc_id is scored, is not held out and never trains;
  * repeated rows are scored each for itself; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.shared import is_remainder, stored, text_batches, text_of

_FLOOR = 1e-3
FEATURES = [
    "words", "bytes_per_word", "distinct_words", "lines_per_word", "distinct_lines", "upper", "digit", "space", "stop", "comma", "bar", "mark",
    "symbol", "other_punct", "high", "entropy", "short_words", "long_words", "shouted_words", "plain_words", "repeated_pairs",
]
_CLASS = np.zeros((256, 10))
for _k, _set in enumerate((range(65, 91), range(48, 58), b" \t\n\r\v\f", b".", b",", b"|", b"!?", b"#$%&*", b"\"'()+-/:;<=>@[\\]^_`{}~", range(128, 256))):
    _CLASS[list(_set), _k] = 1.0


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one whole text."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    shares = (counts @ _CLASS) / n
    seen = counts[counts > 0] / n
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:])))
    out = np.array([
        np.log1p(len(words)),
        np.log1p(len(raw) / m),
        np.log(_FLOOR + len(set(words)) / m) if words else 0.0,
        np.log(_FLOOR + len(lines) / m),
        np.log(_FLOOR + len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
        *np.log(_FLOOR + shares),
        -(seen * np.log(seen)).sum() if len(seen) else 0.0,
        np.log(_FLOOR + (lengths <= 3).sum() / m),
        np.log(_FLOOR + (lengths >= 12).sum() / m),
        np.log(_FLOOR + sum(map(str.isupper, words)) / m),
        np.log(_FLOOR + sum(map(str.isalpha, words)) / m),
        np.log(_FLOOR + 1.0 - pairs / max(len(words) - 1, 1)) if len(words) > 1 else np.log(_FLOOR),
    ])
    return out


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, x): the statistics vector of every document."""
    text_batches(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["id", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("t")).mapInArrow(batches, f"id {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): log prior, mean and Cholesky factor of the shrunk covariance; then the logistic."""

    prior: float
    log_priors: tuple[float, float] | None = None
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    temperature: float = 1.0

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        """Up to a constant that both classes share: the Mahalanobis distance by a triangular solve."""
        z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
        return self.log_priors[k] - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(self.factors[k])).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        gap = (self.log_density(x, 1) - self.log_density(x, 0)) / self.temperature
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -500, 500)))


def class_sums(labelled: DataFrame) -> DataFrame:
    """(label, n, s, ss): per task and class the count, the sum and the sum of outer products."""
    d = len(FEATURES)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
        for batch in it:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k, s in sums.items():
                part = x[label == k]
                s[0] += len(part)
                s[1] += part.sum(axis=0)
                s[2] += part.T @ part
        yield pa.RecordBatch.from_pylist([{"label": k, "n": s[0], "s": s[1].tolist(), "ss": s[2].ravel().tolist()} for k, s in sums.items() if s[0]], schema=pa.schema([("label", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("ss", pa.list_(pa.float64()))]))

    parts = labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(batches, "label int, n long, s array<double>, ss array<double>")
    cells = parts.select("label", "n", F.posexplode(F.concat("s", "ss")).alias("at", "v"))
    return cells.groupBy("label", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def fit(labelled: DataFrame, shrinkage: float = 0.3, temperature: float = 4.0) -> Discriminant:
    """From rows (x, label 0/1). Only the sums of the two classes reach the driver: 2 x (d + d x d) numbers."""
    d = len(FEATURES)
    table = {0: np.zeros(d + d * d), 1: np.zeros(d + d * d)}
    n = {0: 0, 1: 0}
    for row in class_sums(labelled).collect():
        table[row["label"]][row["at"]] = row["v"]
        n[row["label"]] = row["n"]
    total = n[0] + n[1]
    if min(n.values()) < 2:
        return Discriminant(prior=n[1] / total if total else 0.5)
    means, scatter = {}, {}
    for k in (0, 1):
        means[k] = table[k][:d] / n[k]
        scatter[k] = table[k][d:].reshape(d, d) - n[k] * np.outer(means[k], means[k])
    pooled = np.diag(scatter[0] + scatter[1]) / total + 1e-6
    factors = tuple(np.linalg.cholesky((1 - shrinkage) * scatter[k] / n[k] + shrinkage * np.diag(pooled)) for k in (0, 1))
    return Discriminant(n[1] / total, tuple(np.log(n[k] / total) for k in (0, 1)), (means[0], means[1]), factors, temperature)


def score_statistics(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score) of (id, x); the model is a few kilobytes and travels with the task."""
    d = len(FEATURES)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["id", "score"])

    return stats.mapInArrow(batches, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, label_column: str = "quality", folds: int = 5, held_out: int = 0, threshold: float = 0.3, shrinkage: float = 0.3,
    temperature: float = 4.0,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows of the held-out fold never train."""
    stats = stored(document_statistics(docs), "quality-statistics")
    known = labels.where(F.col(label_column).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label_column).alias("label"))
    known = known.where(F.col("id").isNotNull() & ~is_remainder(F.col("id"), folds, held_out))
    model = fit(stats.join(known, "id").select("x", "label"), shrinkage, temperature)
    scored = score_statistics(stats, model)
    return scored.select(
        F.col("id").alias("doc_id"), is_remainder(F.col("id"), folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
