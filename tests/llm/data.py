"""Small made-up documents for the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, class string, id long, t string, chunk long, body string, unit long, shard int, rep long, score string"
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa") for b in ("na", "po", "ri", "tel", "sum", "vek", "dor", "lin")]


def prose(seed: int, count: int, words: list[str] = WORDS) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < count:
        sentence = [r.choice(words) for _ in range(r.randint(4, 11))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:count])


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (doc_id, text) with further columns whose names the operators use inside."""
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), k, "k", "c", k, "t", k, "b", k, k % 5, k, "s") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3, "n")


def mixed_rows() -> list[tuple]:
    """Nulls, empty and very long texts, repeated rows, copies and near copies."""
    base = [(k, prose(k, 40 + 7 * k)) for k in range(12)]
    near = prose(3, 61).split()
    near[30] = "changed"
    return [
        *base, (20, base[3][1]), (21, " ".join(near)), (22, None), (23, ""), (24, "   "), (25, "one"), (26, "one"), (27, "two words"), (28, prose(99, 6000)),
        (29, "É" * 70), (30, "é" * 70), (31, base[5][1] + " " + base[6][1]), (32, "x" * 49), (33, "x" * 49), (34, "y" * 50), (35, "y" * 51), (None, base[1][1]), (None, None), (4, base[4][1]), (4, base[4][1]),
    ]
