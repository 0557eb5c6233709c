"""Phrase collocations counted in lossless counting quotient filters.

Texts are cut into chunks of one language and encoded against the chunk's own word list. Word counts over all
chunks give ids to the words that occur `least` times at least (no phrase with another word can); the ids go
back to the chunks by a join, nothing is broadcast. Every task counts the phrases of its chunks in filters, one for
each range of the permuted keys, and the filters of a range merge as sorted lists. A frequent phrase is one counter
per filter, and the permutation makes ranges even, so no key is hot. Ranges are split by further bits in rounds
of 256 where the corpus needs more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm import quotient
from pagelens.llm.shared import stored, text_batches, text_of
from pagelens.operators.skew import hot_keys, salted_join

CHUNK_BYTES = 4 << 20
#: Phrase occurrences that a task sorts at once, and entries that a range may hold.
BLOCK = 2 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_FIRST = np.uint32(1 << 31)


def encoded(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """(codes, words): each word's place in the list of distinct words; the top bit marks the first word of a piece."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    kind = _KIND[raw]
    solid = kind == 0
    edge = np.diff(solid.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint32), pa.array([], pa.string())
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])]).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.uint32)
    codes[np.diff(piece, prepend=-1) != 0] |= _FIRST
    return codes, words.dictionary


def parts(data: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, cut behind bytes that end a piece: no phrase crosses a cut."""
    at = 0
    while len(data) - at > size:
        window = np.frombuffer(data, np.uint8, size, at)
        found = np.flatnonzero(_KIND[window] == 2)
        if len(found):
            cut = at + int(found[-1]) + 1
        else:
            later = (np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, min(size, len(data) - z), z)] == 2) + z for z in range(at + size, len(data), size))
            cut = next((int(x[0]) + 1 for x in later if len(x)), len(data))
        yield data[at:cut]
        at = cut
    if at < len(data):
        yield data[at:]


CHUNK = "lang string, chunk long, codes binary, size long, words array<string>, counts array<long>"
CHUNK_ARROW = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("codes", pa.binary()), ("size", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[bytes]] = {}
    held, number = 0, TaskContext.get().partitionId() << 33

    def flush(langs):
        nonlocal number
        for lang in langs:
            for part in parts(b"\n".join(waiting.pop(lang)), CHUNK_BYTES):
                codes, words = encoded(part)
                if not len(codes):
                    continue
                counts = np.bincount(codes & ~_FIRST, minlength=len(words))
                packed = pa.compress(codes.tobytes(), codec="zstd", asbytes=True)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([number], pa.int64()), pa.array([packed], pa.binary()), pa.array([codes.nbytes], pa.int64()), *lists], schema=CHUNK_ARROW)
                number += 1

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_buffer().to_pybytes()
            waiting.setdefault(lang, []).append(raw)
            held += len(raw) + 1
            if held >= 2 * CHUNK_BYTES:
                yield from flush(list(waiting))
                held = 0
    yield from flush(list(waiting))


def phrases(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Id triples of all phrases of two and three words within pieces; 0 is a word without an id, and no third word."""
    known = ids > 0
    two = known[:-1] & known[1:] & ~first[1:]
    three = two[:-1] & two[1:]
    a, b = np.flatnonzero(two), np.flatnonzero(three)
    return [np.concatenate([ids[a], ids[b]]), np.concatenate([ids[a + 1], ids[b + 1]]), np.concatenate([np.zeros(len(a), ids.dtype), ids[b + 2]])]


def filters(bits: int, prefix: int):
    """(top, filter) rows from rows (codes, size, at, ids): each task counts BLOCK phrases at a time."""
    schema = pa.schema([("top", pa.int64()), ("entries", pa.int64()), ("filter", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if held:
                rows = list(quotient.split(*quotient.counted(*(np.concatenate(x) for x in zip(*held))), bits, prefix))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), pa.array([quotient.HEAD.unpack_from(f)[4] for _, f in rows], pa.int64()), pa.array([f for _, f in rows], pa.binary())], schema=schema)

        for batch in batches:
            for codes, size, at, ids in zip(*(batch.column(k) for k in range(4))):
                codes = np.frombuffer(pa.decompress(codes.as_buffer(), size.as_py(), codec="zstd"), np.uint32)
                place = codes & ~_FIRST
                table = np.zeros(int(place.max()) + 1, np.int64)
                table[at.values.to_numpy()] = ids.values.to_numpy()
                held.append(quotient.permuted(phrases(table[place], codes >= _FIRST), bits))
                del codes, place, table
                if sum(len(x) for _, x in held) >= BLOCK:
                    yield from flush()
        yield from flush()

    return run


def phrase_counts(docs: DataFrame, least: int, least_bits: int = 2, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, sizes, counts) of a corpus.

    words(id, lang, word, f) has every word with f >= least, sizes(lang, n) the number of word occurrences, and
    counts(w1, w2, w3, f) every phrase of two (w3 = 0) or three words with f >= least. `least_bits` widens the keys.
    """
    spark = docs.sparkSession
    text_batches(spark)
    source = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text_of(docs).alias("text"))
    chunks = stored(source.mapInArrow(chunked, CHUNK), "chunks")
    local = chunks.select("lang", "chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry")).select("lang", "chunk", "at", F.col("entry.words").alias("word"), F.col("entry.counts").alias("f"))
    totals = stored(local.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    sizes = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = totals.where(F.col("f") >= least)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = frequent.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(spread)))
    before = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("before"))  # one row per bucket
    words = stored(placed.join(F.broadcast(before), "bucket").select((F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word")) + F.col("before")).alias("id"), "lang", "word", "f"), "ids")

    known, occurrences = words.count(), sizes.agg(F.sum("n")).first()[0] or 0
    bits = max(quotient.id_bits(known), least_bits)
    prefix = min(max(spread - 1, -(-2 * occurrences // block) - 1, 1).bit_length(), 3 * bits - 1, 31)
    ids = local.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("pairs"))
    rows = chunks.select("chunk", "codes", "size").join(ids, "chunk").select("codes", "size", F.col("pairs.at").alias("at"), F.col("pairs.id").alias("ids"))
    level = min(prefix, 8)
    found = stored(rows.mapInArrow(filters(bits, level), "top long, entries long, filter binary"), "filters")
    while level < prefix:
        # A part of a range holds about a block of entries; the parts of a range merge apart and split by more bits.
        shares = max(1, -(-(found.agg(F.sum("entries")).first()[0] or 0) // (block << level)))
        level = min(prefix, level + 8)
        found = stored(found.withColumn("share", F.pmod(F.xxhash64("filter"), F.lit(shares))).groupBy("top", "share").applyInArrow(_finer(bits, level), "top long, entries long, filter binary"), "filters")
    counts = stored(found.groupBy("top").applyInArrow(_summed(bits, least), "w1 long, w2 long, w3 long, f long"), "phrases")
    return words, sizes, counts


def _finer(bits: int, prefix: int):
    def run(group: pa.Table) -> pa.Table:
        rows = list(quotient.split(*quotient.merged(f.as_buffer() for f in group["filter"].combine_chunks()), bits, prefix))
        return pa.table({"top": pa.array([t for t, _ in rows], pa.int64()), "entries": pa.array([quotient.HEAD.unpack_from(f)[4] for _, f in rows], pa.int64()), "filter": pa.array([f for _, f in rows], pa.binary())})

    return run


def _summed(bits: int, least: int):
    def run(group: pa.Table) -> pa.Table:
        high, low, counts = quotient.merged(f.as_buffer() for f in group["filter"].combine_chunks())
        keep = counts >= least
        ids = quotient.restored(high[keep], low[keep], bits)
        return pa.table({**{f"w{k}": pa.array(x.astype(np.int64)) for k, x in enumerate(ids, 1)}, "f": pa.array(counts[keep])})

    return run


def collocations(docs: DataFrame, least: int = 10, inside_percent: int = 50, most: int = 2000, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of two or three words.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and into words at spaces and tabs;
    a null text is empty, a null lang is `und`. a = f(phrase) >= least; the score floor(1e6 a a / (l r)) is that of the
    worst cut (ties: the first), exact up to a = 10^16. A phrase inside a longer one with 100 f(longer) >= inside_percent * a
    is left out. Order: score and a descending, phrase by bytes. Repeated rows count as often as they stand there; an
    empty table or one without a frequent phrase gives no row; only `text` and `lang` of the table are read.
    """
    words, sizes, counts = phrase_counts(docs, least, **how)
    pairs = counts.where("w3 = 0").select("w1", "w2", "f")
    triples = counts.where("w3 <> 0")
    used = counts.select(F.explode(F.array("w1", "w2", "w3")).alias("id")).where("id <> 0")
    hot_words = stored(hot_keys(used, ["id"]), "hot-words")
    hot_pairs = stored(hot_keys(triples.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p")).select("p.*"), ["w1", "w2"]), "hot-pairs")

    def with_word(df: DataFrame, k: int) -> DataFrame:
        on = f"w{k}"
        names = {"id": on, "word": f"t{k}", "f": f"f{k}"}
        side = words.select(*(F.col(a).alias(b) for a, b in names.items()), *(["lang"] if k == 1 else []))
        return salted_join(df, side, [on], ["w1", "w2", "w3"], "inner", hot_words.select(F.col("id").alias(on)))

    def with_pair(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        side = pairs.select(F.col("w1").alias(a), F.col("w2").alias(b), F.col("f").alias(name))
        return salted_join(df, side, [a, b], ["w1", "w2", "w3"], "inner", hot_pairs.select(F.col("w1").alias(a), F.col("w2").alias(b)))

    def cut(k: int, left: str, right: str):
        score = F.expr(f"cast((cast(f as decimal(20,0)) * cast(f as decimal(20,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0))) as bigint)")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    longer = triples.select("f", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p")).groupBy("p.w1", "p.w2").agg(F.max("f").alias("inside"))
    two = pairs.join(longer, ["w1", "w2"], "left").where(f"inside is null or 100 * inside < {int(inside_percent)} * f").select("w1", "w2", F.lit(0).cast("long").alias("w3"), "f")
    two = with_word(with_word(two, 1), 2).select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "f", cut(1, "f1", "f2").alias("cut"))
    three = with_word(with_word(with_word(triples, 1), 2), 3)
    three = with_pair(with_pair(three, "w2", "w3", "tail"), "w1", "w2", "head")
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "f", F.least(cut(1, "f1", "tail"), cut(2, "head", "f3")).alias("cut"))
    rows = two.unionByName(three).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within 64 parts of a language, so that no task sorts a whole one.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
