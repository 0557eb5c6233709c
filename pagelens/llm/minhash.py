"""Near-duplicates by fast similarity sketching, banding and exact verification.

A set's sketch has t coordinates. In round i < t every element is thrown into a hashed bin with a
hashed value, and values of earlier rounds win; in round t + j all elements go to bin j, so after at
most 2t rounds every coordinate is filled. Rounds stop as soon as they are. Two sketches agree in a
coordinate with the probability of the similarity, concentrated as independent minima would be.

Bands of `rows` coordinates are bucket keys; the number of bands follows from the threshold, so that a
pair at the threshold is missed with probability `miss` at most. Equal sets are one class with one
representative. Representatives of a bucket are tied to its smallest one (a grouped minimum, no
pairs), and ties make clusters. Clusters are cut into blocks of bounded size by set size (sets that
differ too much in size cannot be similar), block pairs are compared inside a task on full sets, and
a task returns a spanning forest of its links, never pairs.

Defined results
  * texts without words, and null texts, have no shingle and are linked with nothing;
  * a text with fewer words than a shingle is one shingle; words are cut at ASCII white space, A-Z lowered;
  * rows with one doc_id are one document; null doc_ids are linked with nothing and are kept;
  * an empty table gives no row; other columns of the input are ignored by the report.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.graph import components, local_roots
from pagelens.llm.shared import stored, text_batches
from pagelens.llm.shingles import digest, mixed, sets, text_parts

BLOCK_SETS = 256
BLOCK_SHINGLES = 200_000
_EMPTY = np.iinfo(np.uint64).max


def sketches(shingles: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each non-empty set."""
    count = len(shingles)
    out = np.full((count, t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(count), [len(s) for s in shingles])
    values = np.concatenate(shingles) if count else np.zeros(0, np.uint64)
    open_ = np.ones(count, bool)
    for i in range(2 * t):
        h = mixed(values + np.uint64((i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        bins = (h >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        np.minimum.at(flat, owner * t + bins.astype(np.int64), (h & np.uint64((1 << 40) - 1)) | np.uint64(i << 40))
        rows = np.flatnonzero(open_)
        done = rows[(out[rows] != _EMPTY).all(axis=1)]
        if len(done):
            open_[done] = False
            stay = open_[owner]
            owner, values = owner[stay], values[stay]
        if not len(values):
            break
    return out


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1.0 - threshold**rows))


def rows_for(threshold: float) -> int:
    """Coordinates per band: as selective as keeps the number of bands near 50."""
    return max(1, round(math.log(0.3) / math.log(threshold)))


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for r in range(rows):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def features(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n, class, keys) of every row; class and keys are null for the empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            at = 0
            for texts in text_parts(rb.column(1), most=500):
                part = rb.slice(at, len(texts))
                at += len(texts)
                shingles = sets(texts, size)
                full = [s for s in shingles if len(s)]
                keys = band_keys(sketches(full, rows * bands), rows, bands) if full else np.zeros((0, bands), np.int64)
                lengths = np.array([bands if len(s) else 0 for s in shingles])
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in shingles], pa.int64()), pa.array([digest(s) if len(s) else None for s in shingles], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel(), pa.int64())),
                    ],
                    ["doc_id", "n", "class", "keys"],
                )

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(batches, f"doc_id {kind}, n long, class binary, keys array<long>")


def similar(a: int, b: int, both, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * both >= percent * (a + b - both)


def linked_matrix(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of `left` are similar to which of `right`, from exact intersections."""
    na, nb = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    if len(left) * len(right) <= 16:
        both = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left]).reshape(len(left), len(right))
    else:
        shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
        both = np.zeros((len(left), len(right)), np.float32)

        def places(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            who = np.repeat(np.arange(len(group)), [len(s) for s in group])
            values = np.concatenate(group)
            at = np.searchsorted(shared, values)
            found = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(len(values), bool)
            return who[found], at[found]

        (wa, pa_), (wb, pb) = places(left), places(right)
        for base in range(0, len(shared), 8192):
            ma, mb = np.zeros((len(left), 8192), np.float32), np.zeros((len(right), 8192), np.float32)
            ia, ib = (pa_ >= base) & (pa_ < base + 8192), (pb >= base) & (pb < base + 8192)
            ma[wa[ia], pa_[ia] - base] = 1
            mb[wb[ib], pb[ib] - base] = 1
            both += ma @ mb.T
        both = both.astype(np.int64)
    return similar(na[:, None], nb[None, :], both, percent)


def block_forest(table: pa.Table, percent: int) -> pa.Table:
    """(u, v): a spanning forest of the links between block a and block b of a cluster (or within a)."""
    ids = table["doc_id"].to_numpy()
    first = table["first"].to_numpy(zero_copy_only=False)
    bodies = [np.frombuffer(x, "<u8") for x in table["body"].to_pylist()]
    left = np.flatnonzero(first)
    right = np.flatnonzero(~first)
    if not len(right):
        right = left
    if len(left):
        linked = linked_matrix([bodies[k] for k in left], [bodies[k] for k in right], percent)
        root = local_roots(ids, lambda: [(left, right, linked)])
        moved = root != ids
        return pa.table({"u": pa.array(ids[moved], pa.int64()), "v": pa.array(root[moved], pa.int64())})
    return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})


def block_plan(members: DataFrame, threshold: float) -> DataFrame:
    """members(doc_id, n, cluster) -> (doc_id, cluster, visits): the block pairs in which each member is compared.

    Sets are classed by the logarithm of their size, so similar sets are in one class or in neighbouring
    ones; a class of a cluster has as many blocks as keep each within BLOCK_SETS and BLOCK_SHINGLES.
    """
    step = math.log(1.0 / threshold)
    placed = members.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int"))
    counts = placed.groupBy("cluster", "c").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    below = counts.select("cluster", (F.col("c") + 1).alias("c"), F.col("blocks").alias("below"))
    above = counts.select("cluster", (F.col("c") - 1).alias("c"), F.col("blocks").alias("above"))
    wide = counts.join(below, ["cluster", "c"], "left").join(above, ["cluster", "c"], "left").fillna(0, ["below", "above"])
    own = placed.join(wide, ["cluster", "c"]).withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))

    def numbers(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def visit(c, i, d, j, first):
        return F.struct(c.alias("a"), i.alias("i"), d.alias("b"), j.alias("j"), first.alias("first"))

    c, i = F.col("c"), F.col("i")
    same = F.transform(numbers("blocks"), lambda j: visit(c, F.least(i, j), c, F.greatest(i, j), i <= j))
    up = F.transform(numbers("above"), lambda j: visit(c, i, c + 1, j, F.lit(True)))
    down = F.transform(numbers("below"), lambda j: visit(c - 1, j, c, i, F.lit(False)))
    return own.select("doc_id", "cluster", F.concat(same, up, down).alias("visits"))


def links(docs: DataFrame, feats: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links between class representatives, enough of them to connect whatever is similar."""
    threshold = percent / 100.0
    known = feats.where("class is not null and doc_id is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    reps = known.join(classes, ["class", "doc_id"], "left_semi").select("doc_id", "n", "keys")
    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("key", "m")
    ties = keyed.join(least, "key").where("doc_id <> m").select(F.col("doc_id").alias("u"), F.col("m").alias("v"))
    clusters = components(ties, "minhash-ties")
    members = reps.select("doc_id", "n").distinct().join(clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")), "doc_id")
    plan = stored(block_plan(members, threshold), "minhash-plan")
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(plan.hint("merge"), "doc_id")  # one plan at every size
    sent = "cluster long, a int, i int, b int, j int, first boolean, doc_id long, body binary"
    shape = pa.schema([("cluster", pa.int64()), ("a", pa.int32()), ("i", pa.int32()), ("b", pa.int32()), ("j", pa.int32()), ("first", pa.bool_()), ("doc_id", pa.int64()), ("body", pa.binary())])

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            at = 0
            for texts in text_parts(rb.column(1), most=200):
                part = rb.slice(at, len(texts))
                at += len(texts)
                rows, held = [], 0
                for number, cluster, visits, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), sets(texts, size)):
                    body = s.tobytes()
                    for v in visits:
                        rows.append({**v, "cluster": cluster, "doc_id": number, "body": body})
                        held += len(body)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=shape)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    blocks = texts.select("doc_id", "text", "cluster", "visits").mapInArrow(send, sent)
    return blocks.groupBy("cluster", "a", "i", "b", "j").applyInArrow(lambda t: block_forest(t, percent), "u long, v long")


HOT_SHARE = 200


def class_roots(feats: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n, class, root) of every row: the component of its class of equal sets.

    Components meet the classes, one row each, before the rows do. A class with more than 1/HOT_SHARE of the rows is
    joined by broadcast (there are fewer than HOT_SHARE of them), and rows without a class meet nothing, so no key is hot.
    """
    narrow = feats.select("doc_id", "n", "class")
    classes = narrow.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    joined = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = stored(joined.select("class", "members", F.coalesce("root", "rep").alias("root")), "minhash-classes")
    common = F.col("members") * HOT_SHARE > feats.count()
    hot = F.broadcast(known.where(common).select("class", "root"))
    classed = narrow.where("class is not null")
    of_hot = classed.join(hot, "class")
    others = classed.join(hot.select("class"), "class", "left_anti").join(known.where(~common).select("class", "root"), "class", "left")
    without = narrow.where("class is null").withColumn("root", F.lit(None).cast("long"))
    return of_hot.unionByName(others).unionByName(without)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text)."""
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(docs["doc_id"].cast("long"), "text")
    rows = rows_for(percent / 100.0)
    feats = stored(features(docs, size, rows, bands_for(percent / 100.0, rows, miss)), "minhash-features")
    found = components(links(docs, feats, size, percent), "minhash-components")
    rooted = class_roots(feats, found)
    root = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    out = rooted.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))
    return out.select(F.col("doc_id").cast(kind), "n_shingles", F.col("component_id").cast(kind), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """`docs` with one document of each group of near-duplicates.

    Null ids stay. Where a doc_id stands on different texts, all of them stay unless every one belongs to the group of a
    smaller id; of equal rows with one doc_id and text one stays.
    """
    judged = near_duplicates(docs, size, percent, miss).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    kept = docs.join(judged.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))
