"""Connected components of links, by repeated stars; nothing is collected."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.shared import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of links(u long, v long): the smallest node that it reaches.

    Large and small star steps alternate until the edges stand still. A step is a grouped minimum,
    combined before the shuffle, and a join on the node, which adaptive execution splits where one
    node has very many edges. Every round is stored, so lineage stays short.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = stored(tidy(links), name)
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Each half of a round is stored: its plan is small and read once.
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        edges = stored(tidy(ends), name)
        # Stars everywhere: no node has two roots, and no root is a node of another star.
        sides = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        if sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(ids: np.ndarray, blocks) -> np.ndarray:
    """Smallest id that each position reaches. `blocks()` yields (rows, columns, linked) matrices over positions."""
    root = ids.copy()
    while True:
        before = root.copy()
        for rows, columns, linked in blocks():
            if not linked.any():
                continue
            big = np.iinfo(np.int64).max
            root[rows] = np.minimum(root[rows], np.where(linked, root[columns][None, :], big).min(axis=1))
            root[columns] = np.minimum(root[columns], np.where(linked, root[rows][:, None], big).min(axis=0))
        if (root == before).all():
            return root
