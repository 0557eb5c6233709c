"""Near-duplicate vectors by an exact metric range join.

Unit vectors with cosine >= c are at most eps = sqrt(2 - 2c) apart. A few pivots (a bounded number of
vectors with the smallest hash) partition each label's vectors: a vector is native to the cell of its
nearest pivot. It also visits every other cell that may hold a native within eps of it, which the
triangle inequality bounds twice: by the cell's nearest and farthest native (grouped minima and
maxima), and by the distance to the plane between the two pivots. So every link is found in the home
cell of each of its ends, and a native's links are all in its own cell: cells join independently.

Equal vectors are one point with a weight. A cell is cut into blocks of at most `block` vectors and the
blocks meet pairwise, each pair in a task of bounded size, so a crowded cell is many tasks. A task
returns a count per native and a spanning forest, never pairs.

Defined results
  * vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
    link with nothing; so do vectors of different lengths;
  * a row with a null vec_id links with nothing and is kept, with a null component;
  * rows that repeat a vec_id with equal vector and label are one vector; they do not count as links;
  * cosines are computed in double precision and compared with >=; equal vectors always link;
  * an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.graph import components, local_roots
from pagelens.llm.shared import stored

MOST_PIVOTS = 256
SLACK = 1e-9


def units(bodies: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f8") for b in bodies]) if bodies else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def points(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, body) of the vectors that can link; body holds the doubles."""
    usable = vectors.where("vec_id is not null and label is not null and vector is not null and size(vector) > 0")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            ids, labels, lists = rb.column(0), rb.column(1), rb.column(2)
            bodies, keep = [], []
            for k, v in enumerate(lists.to_pylist()):
                a = np.array([math.nan if x is None else x for x in v], "<f8")
                a += 0.0  # -0.0 becomes 0.0, so equal vectors have equal bytes
                if np.isfinite(a).all() and np.isfinite(norm := np.linalg.norm(a)) and norm > 0:
                    keep.append(k)
                    bodies.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), labels.take(pa.array(keep, pa.int64())), pa.array(bodies, pa.binary())], ["vec_id", "label", "body"])

    return usable.mapInArrow(batches, "vec_id long, label string, body binary")


def choose_pivots(reps: DataFrame, per_pivot: int) -> dict[int, np.ndarray]:
    """Pivots by vector length: one for every `per_pivot` points, between 1 and MOST_PIVOTS in all lengths."""
    sizes = {r["d"]: r["n"] for r in reps.groupBy((F.octet_length("body") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(MOST_PIVOTS).collect()}
    out = {}
    for d, n in sizes.items():
        count = max(1, min(MOST_PIVOTS // len(sizes), n // per_pivot))
        rows = reps.where(F.octet_length("body") == 8 * d).select("body").orderBy(F.xxhash64("body"), "body").limit(count).collect()
        out[d] = units([bytes(r["body"]) for r in rows])
    return out


def homes(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, label, n, body, dim, cell, distance): each point's nearest pivot; lengths without pivots have cell 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            cell, far, dims = [], [], []
            for b in rb.column(3):
                x = units([b.as_py()])[0]
                p = pivots.get(len(x))
                dims.append(len(x))
                if p is None:
                    cell.append(0)
                    far.append(0.0)
                else:
                    gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ x)))
                    cell.append(int(gap.argmin()))
                    far.append(float(gap.min()))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(dims, pa.int32()), pa.array(cell, pa.int32()), pa.array(far, pa.float64())], [*rb.schema.names, "dim", "cell", "distance"])

    return reps.select("vec_id", "label", "n", "body").mapInArrow(batches, "vec_id long, label string, n long, body binary, dim int, cell int, distance double")


def visits(homed: DataFrame, rings: DataFrame, pivots: dict[int, np.ndarray], eps: float) -> DataFrame:
    """One row per point and cell it must meet: its own, and those the bounds cannot exclude."""
    kinds = "vec_id long, label string, n long, body binary, dim int, cell int, native boolean"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = {d: np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T))) for d, p in pivots.items()}
        shape = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("n", pa.int64()), ("body", pa.binary()), ("dim", pa.int32()), ("cell", pa.int32()), ("native", pa.bool_())])
        for rb in it:
            rows = []
            for r in rb.to_pylist():
                row = {k: r[k] for k in ("vec_id", "label", "n", "body", "dim")}
                rows.append(row | {"cell": r["cell"], "native": True})
                p = pivots.get(r["dim"])
                if p is None:
                    continue
                dot = p @ units([r["body"]])[0]
                gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))
                for other in r["rings"]:
                    j = other["cell"]
                    if j == r["cell"] or not other["low"] - eps <= gap[j] <= other["high"] + eps:
                        continue
                    if (dot[r["cell"]] - dot[j]) <= eps * between[r["dim"]][r["cell"], j] + SLACK:
                        rows.append(row | {"cell": j, "native": False})
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return homed.join(rings, ["label", "dim"]).select("vec_id", "label", "n", "body", "dim", "cell", "rings").mapInArrow(batches, kinds)


def joined_cells(visiting: DataFrame, cosine: float, block: int) -> DataFrame:
    """(u, v, n): a count of weighted links of a native u (v null), or an edge u-v of a block's spanning forest."""
    cell = ["label", "dim", "cell"]
    counts = visiting.groupBy(*cell).agg(F.ceil(F.sum(F.col("native").cast("int")) / block).cast("int").alias("a"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("b"))
    salted = visiting.join(counts, cell).withColumn("i", F.pmod(F.xxhash64("vec_id"), F.greatest("a", F.lit(1))).cast("int")).withColumn("j", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("b")).cast("int"))

    def upto(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    left = salted.where("native").select(*cell, "vec_id", "n", "body", "i", F.explode(upto("b")).alias("j"), F.lit(True).alias("first"))
    right = salted.select(*cell, "vec_id", "n", "body", F.explode(upto("a")).alias("i"), "j", F.lit(False).alias("first"))

    def meet(table: pa.Table) -> pa.Table:
        first = table["first"].to_numpy(zero_copy_only=False)
        ids, weight = table["vec_id"].to_numpy(), table["n"].to_numpy()
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        x = units(table["body"].to_pylist())
        total = np.zeros(len(a), np.int64)
        blocks = []
        for at in range(0, len(a), 1024):
            rows = a[at : at + 1024]
            for to in range(0, len(b), 1024):
                columns = b[to : to + 1024]
                linked = (x[rows] @ x[columns].T) >= cosine
                linked &= ids[rows][:, None] != ids[columns][None, :]
                total[at : at + 1024] += linked @ weight[columns]
                if linked.any():
                    blocks.append((rows, columns, np.packbits(linked, axis=1)))
        root = local_roots(ids, lambda: ((r, c, np.unpackbits(m, axis=1, count=len(c)).astype(bool)) for r, c, m in blocks))
        moved = np.unique(np.stack([ids[root != ids], root[root != ids]], axis=1), axis=0) if (root != ids).any() else np.zeros((0, 2), np.int64)
        some = total > 0
        return pa.table({
            "u": pa.array(np.concatenate([ids[a][some], moved[:, 0]]), pa.int64()),
            "v": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(moved[:, 1], pa.int64())]),
            "n": pa.array(np.concatenate([total[some], np.zeros(len(moved), np.int64)]), pa.int64()),
        })

    return left.unionByName(right).groupBy(*cell, "i", "j").applyInArrow(meet, "u long, v long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", per_pivot: int = 8000, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = vectors.schema[id_column].dataType.simpleString()
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).alias("vector"))
    usable = stored(points(rows), "vector-points")
    classes = usable.groupBy("label", "body").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n"))
    classes = stored(classes, "vector-classes")
    reps = classes.select(F.col("rep").alias("vec_id"), "label", "n", "body")
    pivots = choose_pivots(reps, per_pivot)
    eps = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLACK
    homed = stored(homes(reps, pivots), "vector-homes")
    ring = homed.groupBy("label", "dim", "cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    rings = ring.groupBy("label", "dim").agg(F.collect_list(F.struct("cell", "low", "high")).alias("rings"))  # at most MOST_PIVOTS cells each
    found = stored(joined_cells(visits(homed, rings, pivots, eps), cosine - 1e-15, block), "vector-links")
    roots = components(found.where("v is not null").select("u", "v"), "vector-components")
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    members = usable.join(classes, ["label", "body"]).select("vec_id", "rep", "n").distinct()
    linked = members.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.groupBy("vec_id").agg(F.max(F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.min(F.coalesce("root", "rep")).alias("root"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    root = F.coalesce("root", "vec_id")
    return out.select(F.col("vec_id").cast(kind), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.cast("long").alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))
