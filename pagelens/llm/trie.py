"""Z-fast trie over conversations.

A conversation is the sequence of its turns; a prefix is known by a chained 128-bit digest. Distinct sequences are
inserted in batches in the order of their own digests, which is random, each batch several times the one before.
A sequence owns the nodes of its path that no earlier one has: those below depth `low`, hanging on the path of `host`.
A compacted node ends where sequences hang on an owner's path or where the path ends; it is kept under the digest of its handle, the
prefix whose length is the two-fattest number of the node's depths.

A batch finds its exit nodes by fat binary search: about log2(length) joins of one probe per sequence with the handles,
then one by the first turn of an edge and a comparison along that edge. Only the turns behind the exit are
exploded and grouped, to find the owners among the batch itself. So what many conversations share is looked up, not
shuffled turn by turn. Joins on a prefix that very many share are salted.

Edges are expanded at the end: counts of an owner's hangers are summed by depth, and sums over subtrees are sums
along the owner's path; they go up the chain of hosts in rounds, whose number is logarithmic for a random order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.running import placed
from pagelens.llm.shared import stored, text_batches
from pagelens.operators.skew import salted_join

ROOT = b"\0" * 16
#: A batch is GROWTH times the one before; the first has about FIRST sequences, and there are two batches at least.
GROWTH, FIRST = 8, 4000
NODE = ("owner", "name", "extent", "edge")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, length, path, chars): the chained digests of a conversation's turns (16 bytes each) and the code points of their texts.

    `conversations` has conv_id, depth (from 1), symbol (binary), chars; a row of depth 0 stands for the conversation itself.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("conv_id", pa.int64()), ("length", pa.int64()), ("path", pa.binary()), ("chars", pa.list_(pa.int64()))])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, chars, digest, rows = None, bytearray(), [], ROOT, []
        for batch in batches:
            for conv, symbol, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if conv != now:
                    if now is not None:
                        rows.append({"conv_id": now, "length": len(chars), "path": bytes(path), "chars": chars})
                    now, path, chars, digest = conv, bytearray(), [], ROOT
                if symbol is not None:
                    digest = hashlib.blake2b(digest + symbol, digest_size=16).digest()
                    path += digest
                    chars.append(size)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "length": len(chars), "path": bytes(path), "chars": chars}], schema)

    ordered = conversations.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "symbol", "chars")
    return ordered.mapInArrow(chained, "conv_id long, length long, path binary, chars array<long>")


def rebuilt(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, depth, symbol, chars): the first h turns of conversation c - c % every, then c's own turns behind its first h,
    h = crc32(c as text) % heads. Turns in the order of turn (null first), role, text; null roles and texts are empty.
    Depth 0 stands for the conversation itself. Rows without a conv_id belong to no conversation.
    """
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    symbol = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    own = placed(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], F.lit(1), "trie-turns")
    own = stored(own.select("conv_id", "seq", symbol.alias("symbol"), F.length("text").cast("long").alias("chars")), "trie-symbols")
    keys = own.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    first = own.where((F.col("conv_id") % every == 0) & (F.col("seq") < heads - 1)).withColumnRenamed("conv_id", "base")
    sizes = first.groupBy("base").agg(F.count(F.lit(1)).alias("has"))
    taken = keys.join(first, "base").where("seq < h").select("conv_id", (F.col("seq") + 1).alias("depth"), "symbol", "chars")
    rest = own.join(keys.join(sizes, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("before")), "conv_id").where("seq >= h")
    rest = rest.select("conv_id", (F.col("before") + F.col("seq") - F.col("h") + 1).alias("depth"), "symbol", "chars")
    return taken.unionByName(rest).unionByName(keys.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("symbol"), F.lit(0).cast("long").alias("chars")))


def two_fattest(a: str, b: str) -> Column:
    """The number in (a, b] that is divisible by the highest power of two."""
    return F.expr(f"{b} & ~(shiftleft(1L, length(bin({a} ^ {b})) - 1) - 1)")


def prefix(path: str, depth: str) -> Column:
    """The digest at a depth."""
    return F.expr(f"substring({path}, cast(16 * ({depth}) - 15 as int), 16)")


def nodes(placed_rows: DataFrame) -> DataFrame:
    """(handle, first, owner, name, extent, edge): the compacted nodes of rows (x, length, path, low, host).

    A node covers the depths (name, extent] of its owner's path; edge has their digests, first is the one at name + 1.
    """
    hung = placed_rows.groupBy(F.col("host").alias("owner")).agg(F.collect_set("low").alias("stops"))
    owners = placed_rows.where("length > low").select(F.col("x").alias("owner"), "length", "path", "low").join(hung, "owner", "left")
    stops = owners.withColumn("stops", F.expr("array_sort(array_distinct(concat(coalesce(stops, array()), array(length))))"))
    cut = stops.select("owner", "path", "low", "stops", F.posexplode("stops").alias("at", "extent")).withColumn("name", F.expr("if(at = 0, low, stops[at - 1])"))
    cut = cut.withColumn("deep", two_fattest("name", "extent"))
    return cut.select(prefix("path", "deep").alias("handle"), prefix("path", "name + 1").alias("first"), "owner", "name", "extent", F.expr("substring(path, cast(16 * name + 1 as int), cast(16 * (extent - name) as int))").alias("edge"))


def located(batch: DataFrame, trie: DataFrame) -> DataFrame:
    """The batch's rows (x, length, path) with low and host: how deep the trie has each sequence, and whose path that is on."""
    none = [F.lit(None).cast(t).alias(n) for n, t in zip(NODE, ("binary", "long", "long", "binary"))]
    active = stored(batch.select("x", "length", "path", F.lit(0).cast("long").alias("a"), F.col("length").alias("b"), F.lit(ROOT).alias("host"), *none), "trie-search")
    side = trie.select(F.col("handle").alias("probe"), *(F.col(n).alias(f"n_{n}") for n in NODE))
    ended = []
    while True:
        ended.append(active.where("a >= b or owner is not null"))
        active = active.where("a < b and owner is null")
        if active.isEmpty():
            break
        step = active.withColumn("f", two_fattest("a", "b")).withColumn("probe", prefix("path", "f"))
        step = salted_join(step, side, ["probe"], ["x"])
        whole = (F.col("n_extent") <= F.col("length")) & (prefix("path", "n_extent") == F.expr("substring(n_edge, -16, 16)"))
        hit, whole = F.col("n_owner").isNotNull(), F.coalesce(whole, F.lit(False))
        found = [F.when(hit & ~whole, F.col(f"n_{n}")).alias(n) for n in NODE]
        active = stored(step.select("x", "length", "path", F.when(whole, F.col("n_extent")).otherwise(F.col("a")).alias("a"), F.when(hit, F.col("b")).otherwise(F.col("f") - 1).alias("b"), F.when(whole, F.col("n_owner")).otherwise(F.col("host")).alias("host"), *found), "trie-search")
    rows = ended[0]
    for more in ended[1:]:
        rows = rows.unionByName(more)
    # No handle on the way: the exit is the child whose edge begins with the next turn, if there is one.
    side = trie.select(F.col("first").alias("probe"), *(F.col(n).alias(f"n_{n}") for n in NODE))
    open_ends = F.col("owner").isNull() & (F.col("a") < F.col("length"))
    rows = stored(rows.withColumn("probe", F.when(open_ends, prefix("path", "a + 1")).otherwise(F.concat("x", F.lit(b"-")))), "trie-exits")
    rows = salted_join(rows, side, ["probe"], ["x"])
    rows = rows.select("x", "length", "path", "a", "host", *(F.coalesce(n, f"n_{n}").alias(n) for n in NODE))
    same = F.expr("cast(size(filter(sequence(1L, least(extent, length) - name), i -> substring(path, cast(16 * (name + i) - 15 as int), 16) = substring(edge, cast(16 * i - 15 as int), 16))) as long)")
    known = F.col("owner").isNotNull()
    return rows.select("x", "length", "path", F.when(known, F.col("name") + same).otherwise(F.col("a")).alias("low"), F.when(known, F.col("owner")).otherwise(F.col("host")).alias("host"))


def among_themselves(batch: DataFrame) -> DataFrame:
    """Rows (x, length, path, low, host) with low and host moved down to where an earlier sequence of the same batch goes along."""
    turns = stored(batch.where("low < length").select("x", F.explode(F.expr("sequence(low + 1, length)")).alias("depth"), "path").select("x", "depth", prefix("path", "depth").alias("digest")), "trie-new")
    owners = turns.groupBy("digest").agg(F.min("x").alias("owner"))
    shared = salted_join(turns, owners, ["digest"], ["x"], "inner").where("owner <> x").groupBy("x").agg(F.max("depth").alias("deeper"), F.max_by("owner", "depth").alias("along"))
    return batch.join(shared, "x", "left").select("x", "length", "path", F.coalesce("deeper", "low").alias("low"), F.coalesce("along", "host").alias("host"))


def built(distinct: DataFrame, growth: int = GROWTH, first: int = FIRST) -> DataFrame:
    """(x, length, path, low, host) of all distinct sequences (x, length, path), length > 0, inserted in batches."""
    count, batches = distinct.count(), 2
    while count > first * growth ** (batches - 1):
        batches += 1
    share = F.conv(F.hex(F.substring("x", 1, 6)), 16, 10).cast("double") / float(1 << 48)
    number = F.lit(batches - 1)
    for k in range(batches - 2, -1, -1):
        number = F.when(share < float(growth) ** (k + 1 - batches), k).otherwise(number)
    numbered = distinct.select("x", "length", "path", number.alias("batch"))
    done = None
    for k in range(batches):
        batch = numbered.where(F.col("batch") == k).drop("batch")
        if done is None:
            rows = batch.select("x", "length", "path", F.lit(0).cast("long").alias("low"), F.lit(ROOT).alias("host"))
        else:
            rows = stored(located(batch, stored(nodes(done), "trie-nodes")), "trie-located")
        rows = stored(among_themselves(rows), "trie-rows")
        done = rows if done is None else done.unionByName(rows)
    return done


def lifted(values: DataFrame, parents: DataFrame, how: dict[str, str]) -> DataFrame:
    """Values (x, ...) combined over all rows that hang on x, directly or through others; parents(x, host). One round a level."""
    def combined(df, key):
        return df.groupBy(F.col(key).alias("x")).agg(*(F.expr(f"{f}({c})").alias(c) for c, f in how.items()))

    rounds, now = [values], values
    while True:
        now = stored(combined(now.join(parents, "x").where("host is not null"), "host"), "trie-lift")
        if now.isEmpty():
            break
        rounds.append(now)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return stored(combined(out, "x"), "trie-totals")


def ended(members: DataFrame) -> DataFrame:
    """(x, ends_sha256): the digest of each sequence's conversation ids, ascending, comma-joined.

    Ids are range-sorted and joined to blocks of text where they lie; only the blocks of a sequence meet in one task, as a stream.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = pa.schema([("x", pa.binary()), ("first", pa.int64()), ("text", pa.string())])

    def blocks(batches):
        for batch in batches:
            rows = []
            for x, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not rows or rows[-1]["x"] != x:
                    rows.append({"x": x, "first": conv, "text": []})
                rows[-1]["text"].append(str(conv))
            if rows:
                yield pa.RecordBatch.from_pylist([r | {"text": ",".join(r["text"])} for r in rows], block)

    def digests(batches):
        schema, now, sha = pa.schema([("x", pa.binary()), ("ends_sha256", pa.string())]), None, None
        for batch in batches:
            rows = []
            for x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x != now:
                    if now is not None:
                        rows.append({"x": now, "ends_sha256": sha.hexdigest()})
                    now, sha = x, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"x": now, "ends_sha256": sha.hexdigest()}], schema)

    joined = members.repartitionByRange(parts, "x", "conv_id").sortWithinPartitions("x", "conv_id").select("x", "conv_id").mapInArrow(blocks, "x binary, first long, text string")
    return joined.repartition(parts, "x").sortWithinPartitions("x", "first").select("x", "text").mapInArrow(digests, "x binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, **how) -> DataFrame:
    """One row per node of the trie over conversations (conv_id, depth, symbol, chars), see `sequences`.

    conv_id smallest member, depth, parent_conv_id, n_convs members, n_children, n_leaves childless nodes of the subtree,
    saved_tokens over the subtree (members - 1) times the code points of each node's last text, ends_sha256. No conversations, no rows.
    """
    rows = stored(sequences(turns).select("conv_id", "length", "path", "chars", F.when(F.col("length") > 0, F.expr("substring(path, -16, 16)")).otherwise(F.lit(ROOT)).alias("x")), "trie-sequences")
    if rows.isEmpty():
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    copies = rows.groupBy("x").agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("m"))
    distinct = stored(rows.join(copies.select(F.col("x").alias("_x"), F.col("least").alias("conv_id"), "m"), "conv_id").select("x", "length", "path", "chars", "m", F.col("conv_id").alias("least")), "trie-distinct")
    hung = built(distinct.where("length > 0"), **how).select("x", "length", "low", "host")

    # The root is an owner too, of the one node at depth 0.
    top = distinct.where("length = 0").agg(F.coalesce(F.max("m"), F.lit(0)).cast("long").alias("m"), F.max("least").alias("least"))
    root = top.select(F.lit(ROOT).alias("x"), F.lit(0).cast("long").alias("length"), F.lit(-1).cast("long").alias("low"), F.lit(None).cast("binary").alias("host"), "m", "least", F.lit(None).cast("array<long>").alias("chars"))
    paths = stored(hung.join(distinct.select("x", "m", "least", "chars"), "x").unionByName(root), "trie-paths")
    parents = paths.select("x", "host")
    branching = paths.where("length > low and host is not null").select(F.col("host").alias("x"), F.col("low").alias("length")).distinct()
    leaf = F.when((F.col("length") > F.col("low")) & F.col("branching").isNull(), 1).otherwise(0).cast("long")
    values = paths.join(branching.withColumn("branching", F.lit(True)), ["x", "length"], "left").select("x", "m", "least", leaf.alias("leaf"))
    totals = lifted(stored(values, "trie-values"), parents, {"m": "sum", "least": "min", "leaf": "sum"})

    def at_stops(df, *sums):
        return paths.where("host is not null").select("x", "length", "low", "host").join(df, "x").groupBy(F.col("host").alias("x"), F.col("low").alias("depth")).agg(*sums)

    stops = at_stops(totals, F.sum("m").alias("s_m"), F.min("least").alias("s_least"), F.sum("leaf").alias("s_leaf"), F.count_if(F.col("length") > F.col("low")).alias("s_children"), F.max(F.when(F.col("length") == F.col("low"), F.col("x"))).alias("s_end"))
    units = paths.where("length > low").join(values.select("x", "leaf"), "x").select("x", "host", "low", "length", "m", "least", "leaf", "chars", F.explode(F.expr("sequence(low + 1, length)")).alias("depth"))
    below = Window.partitionBy("x").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)

    def summed(column):
        return F.coalesce(F.sum(column).over(below), F.lit(0))

    units = units.withColumn("size", F.expr("coalesce(chars[cast(depth - 1 as int)], 0)")).drop("chars").join(stops, ["x", "depth"], "left")
    units = units.select("x", "depth", "host", "low", (F.col("m") + summed("s_m")).alias("n_convs"), F.least("least", F.min("s_least").over(below)).alias("conv_id"), (F.col("leaf") + summed("s_leaf")).alias("n_leaves"),
                         ((F.col("depth") < F.col("length")).cast("long") + F.coalesce("s_children", F.lit(0))).alias("n_children"), F.when(F.col("depth") == F.col("length"), F.col("x")).otherwise(F.col("s_end")).alias("end"), "size")
    units = stored(units.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "trie-units")
    own = paths.select("x").join(units.groupBy("x").agg(F.sum("saved").alias("saved")), "x", "left").fillna(0, ["saved"])
    saved = at_stops(lifted(stored(own, "trie-saved"), parents, {"saved": "sum"}), F.sum("saved").alias("s_saved"))
    before = Window.partitionBy("x").orderBy("depth")
    units = units.join(saved, ["x", "depth"], "left").withColumn("saved_tokens", summed("saved") + summed("s_saved")).withColumn("above", F.lag("conv_id").over(before)).withColumn("ends_at", F.col("end"))
    tops = units.where("depth = low + 1 and host is not null").select("x", F.col("host").alias("p_x"), F.col("low").alias("p_depth"))
    parent = units.select(F.col("x").alias("p_x"), F.col("depth").alias("p_depth"), F.col("conv_id").alias("p_conv"))
    first = salted_join(tops, parent, ["p_x", "p_depth"], ["x"], "inner").select("x", "p_conv")
    shas = ended(rows.select("x", "conv_id")).select(F.col("x").alias("ends_at"), "ends_sha256")
    out = units.join(first, "x", "left").join(shas, "ends_at", "left")
    parent_id = F.when(F.col("depth") == F.col("low") + 1, F.col("p_conv")).otherwise(F.col("above"))
    return out.select("conv_id", "depth", parent_id.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **how) -> DataFrame:
    """The trie over rebuilt conversations (see `rebuilt` for order, nulls and ties, `prefix_trie` for the columns).

    Repeated rows are further turns; extra columns are not read; an empty table has no nodes.
    """
    text_batches(conversations.sparkSession)
    return prefix_trie(stored(rebuilt(conversations), "trie-rebuilt"), **how)
