"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

The units that are placed are groups of equal texts (a group is taken apart by row only when it is
larger than a quarter of a shard). Each has its bytes and a point: log of its size, source, language
and smallest doc_id, all scaled to 0..1. A node that is to become k shards is split along the dimension
in which its points spread widest, at the weighted quantile that gives each side its share of the bytes.
The quantile is found by grouped histograms over narrow rows: each round looks into one of 1024 cells,
until the cell no longer matters. Equal coordinates are told apart by a hash, so a source that holds a
third of the rows splits like any other. Only histograms and ranges reach the driver.

Units larger than a thirty-second of a shard (at most 32 for each shard, whatever the input) are dealt
out first, largest to the emptiest shard, and the shares of the tree's leaves are what is left.

Defined results (law `bytes`)
  * a row's size is the UTF-8 bytes of its text and 8; a null text has 8 and the checksum of no bytes;
  * null doc_ids are rows like any other; identical rows share a shard and have slots of their own;
  * slots count from 0 without gap in every shard; an empty table gives no row; other columns are ignored,
    and lang and source may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelens.llm.shared import stored, text_of

CELLS = 1024
SCALE = 1 << 30
SLOT_PARTS = 64


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, crc, digest, lang, source): the narrow rows; the text is read once and never shuffled."""
    raw = text_of(docs).cast("binary")
    named = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("digest"), *named)


def code(column: Column) -> Column:
    return F.coalesce(F.crc32(column.cast("binary")), F.lit(0)) / F.lit(float(1 << 32))


def heavy_first(units: DataFrame, total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """Shard of each heavy unit, and the bytes that each shard has got by them."""
    load, where = [0] * shards, {}
    for r in units.where(F.col("bytes") * (32 * shards) > total).select("unit", "bytes").orderBy(F.desc("bytes"), "unit").collect():
        k = min(range(shards), key=lambda s: (load[s], s))
        load[k] += r["bytes"]
        where[r["unit"]] = k
    return where, load


def split_points(points: DataFrame, wanted: dict[int, tuple[int, float]], tolerance: float) -> dict[int, int]:
    """For each node the key at which the bytes below it come closest to the wanted share.

    points(node, key, bytes); wanted: node -> (unused, share). The histogram of a round has at most CELLS
    rows for each node that still matters.
    """
    spans = {n: [0, SCALE << 32, 0] for n in wanted}  # low, high, bytes below low
    totals = {r["node"]: r["b"] for r in points.groupBy("node").agg(F.sum("bytes").alias("b")).collect()}
    goal = {n: totals.get(n, 0) * share for n, (_, share) in wanted.items()}
    cuts: dict[int, int] = {}
    while spans:
        table = points.sparkSession.createDataFrame([(n, low, max(1, -(-(high - low) // CELLS)), high) for n, (low, high, _) in spans.items()], "node int, low long, width long, high long")
        inside = points.join(F.broadcast(table), "node").where("key >= low and key < high")
        cells = inside.groupBy("node", F.floor((F.col("key") - F.col("low")) / F.col("width")).cast("int").alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        found: dict[int, list] = {n: [] for n in spans}
        for r in cells.collect():
            found[r["node"]].append((r["cell"], r["b"], r["n"]))
        for n in list(spans):
            low, high, below = spans[n]
            width = max(1, -(-(high - low) // CELLS))
            for cell, b, count in sorted(found[n]):
                if below + b >= goal[n]:
                    start, end = low + cell * width, min(high, low + (cell + 1) * width)
                    if count <= 1 or width == 1 or b <= tolerance:
                        cuts[n] = end if below + b - goal[n] < goal[n] - below else start
                        del spans[n]
                    else:
                        spans[n] = [start, end, below]
                    break
                below += b
            else:
                cuts[n] = high
                del spans[n]
    return cuts


def tree_shards(units: DataFrame, shards: int, load: list[int], total: int) -> DataFrame:
    """(unit, shard) of units(unit, bytes, tie, d0..d3) by the k-d tree; `load` is what the shards hold already."""
    dims = [c for c in units.columns if c.startswith("d") and c[1:].isdigit()]
    share = [max(0.0, total / shards - b) for b in load]
    placed = units.withColumn("node", F.lit(0))
    leaves = {0: (0, shards)}
    while any(b - a > 1 for a, b in leaves.values()):
        ranges = placed.groupBy("node").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)]).collect()
        widest = {r["node"]: max(dims, key=lambda c, r=r: (r[f"max_{c}"] - r[f"min_{c}"], -dims.index(c))) for r in ranges}
        wanted, middle = {}, {}
        for n, (a, b) in leaves.items():
            if b - a > 1 and n in widest:
                middle[n] = a + (b - a) // 2
                all_ = sum(share[a:b])
                wanted[n] = (0, sum(share[a : middle[n]]) / all_ if all_ else (middle[n] - a) / (b - a))
        if not wanted:
            break
        low = {r["node"]: r for r in ranges}
        key = F.lit(None).cast("long")
        for n in wanted:
            c = widest[n]
            a, z = low[n][f"min_{c}"], low[n][f"max_{c}"]
            scaled = F.floor((F.col(c) - F.lit(a)) / F.lit(max(z - a, 1e-300)) * (SCALE - 1)).cast("long")
            key = F.when(F.col("node") == n, F.shiftleft(scaled, 32).bitwiseOR(F.col("tie"))).otherwise(key)
        keyed = placed.withColumn("key", key)
        cuts = split_points(keyed.where("key is not null").select("node", "key", "bytes"), wanted, total / shards / 5000)
        node, grown = F.col("node"), {}
        for n, (a, b) in leaves.items():
            if n not in wanted:
                grown[n] = (a, b) if b - a == 1 else (a, a + 1)  # a node without units stays empty
                continue
            left, right = 2 * n + 1, 2 * n + 2
            grown[left], grown[right] = (a, middle[n]), (middle[n], b)
            node = F.when(F.col("node") == n, F.when(F.col("key") < cuts[n], left).otherwise(right)).otherwise(node)
        leaves = grown
        placed = stored(keyed.withColumn("node", node).drop("key"), "kd-level")
    shard = F.lit(0)
    for n, (a, _) in leaves.items():
        shard = F.when(F.col("node") == n, a).otherwise(shard)
    return placed.select("unit", shard.cast("int").alias("shard"))


def kd_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, by the law `bytes`."""
    rows = stored(sized_rows(docs), "shard-rows")
    bounds = rows.agg(F.sum("size").alias("total"), F.min(F.col("doc_id").cast("double")).alias("low"), F.max(F.col("doc_id").cast("double")).alias("high")).first()
    total = bounds["total"] or 0
    group = ["digest", "crc", "size"]
    large = rows.groupBy(*group).agg(F.sum("size").alias("_all")).where(F.col("_all") * (4 * shards) > total).select(*group, F.lit(True).alias("large"))
    flagged = rows.join(F.broadcast(large), group, "left")  # fewer than 4 x shards groups are that large
    identity = F.xxhash64(*group, F.when(F.col("large"), F.struct("doc_id", "lang", "source")))
    flagged = stored(flagged.withColumn("unit", identity).drop("large"), "shard-units")
    scale = max((bounds["high"] or 0.0) - (bounds["low"] or 0.0), 1.0)
    number = (F.coalesce(F.min(F.col("doc_id").cast("double")), F.lit(bounds["low"] or 0.0)) - F.lit(bounds["low"] or 0.0)) / F.lit(scale)
    units = flagged.groupBy("unit").agg(
        F.sum("size").alias("bytes"), (F.log(F.max("size").cast("double")) / 25.0).alias("d0"), F.min(code(F.col("source"))).alias("d1"), F.min(code(F.col("lang"))).alias("d2"), number.alias("d3")
    )
    units = stored(units.withColumn("tie", F.xxhash64("unit", F.lit(1)).bitwiseAND(F.lit((1 << 32) - 1))), "shard-points")
    where, load = heavy_first(units, total, shards)
    heavy = docs.sparkSession.createDataFrame(list(where.items()), "unit long, shard int")
    placed = tree_shards(units.join(F.broadcast(heavy), "unit", "left_anti"), shards, load, total).unionByName(heavy)
    dealt = stored(flagged.join(placed, "unit").select("doc_id", "size", "crc", "shard", F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(SLOT_PARTS)).alias("part")), "shard-rows")
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # at most SLOT_PARTS rows a shard
    base = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_part = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "crc", "size")) - 1
    slotted = dealt.join(F.broadcast(counts.select("shard", "part", base.alias("base"))), ["shard", "part"])
    return slotted.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + in_part).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
