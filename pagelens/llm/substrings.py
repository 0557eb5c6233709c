"""Repeated-substring removal: bucket-pointer refinement over sampled suffixes.

A byte is removed where a string of `length` bytes covers it that also starts in a document with a
smaller id. Suffixes are never sorted whole. They are put into buckets by a q-gram, and only buckets
with suffixes of at least two documents are refined, by the bucket identifiers of later offsets:

1. Pack. Documents are packed, in scan order, into chunks of about `chunk_bytes` of text (one Arrow
   batch each, zstd) and the chunks are stored bucketed by chunk number; later steps read that table
   without a shuffle.
2. Initial buckets. Every string of `length` bytes is represented by the least q-gram identifier in it,
   so equal strings are represented alike wherever they stand; about one suffix in 15 is such a
   representative. A chunk sends each of its identifiers once, in packed form (5 bytes; the rest is
   implied by where it is sent), and learns which of them other documents share.
3. Refinement. For the shared ones, a chunk sends the bytes around them. Identifiers of depth 2q come
   from pairs of those of depth q at distance q, the ones of the whole length from pairs of depth 2q
   (each step reuses the identifiers of the one before); suffixes alone in their bucket drop out
   before the next step. The smallest document id of each last bucket decides.
4. The decided runs go back to their chunk, are united, and the chunk's texts are cut.

Identifiers are 64-bit mixes, not ranks: two different strings of one bucket share one with
probability 2^-64. Equal surroundings within a chunk are sent once, for the smallest id; the others are
decided on the spot. Identifiers found in more than `hot` documents are not refined in one place: their
strings are dealt out by the identifier of their whole length, once per chunk. There is a bucket for every
`bucket_bytes` of text, so what a task holds at once does not grow with the table.

Defined results
  * null and empty texts, and texts shorter than `length`, lose nothing; a null text counts as empty;
  * rows with one doc_id are one document: they take nothing from each other; null doc_ids neither lose
    nor take anything; of equal texts only the one with the smallest id stays whole;
  * strings are compared as UTF-8 bytes of whole texts, on the input; matches never cross documents;
  * an empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.shared import partitions, stored, text_batches, work_folder

Q = 20
KEY_BYTES = 5
HOT = 4000
BUCKET_BYTES = 3 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.iinfo(np.int64).max


def paired(ids: np.ndarray, distance: int) -> np.ndarray:
    """Identifiers of twice the depth (or of depth + distance): those at an offset and `distance` later, mixed."""
    out = ids[: len(ids) - distance] * _MUL + ids[distance:]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def identifiers(raw: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of all substrings of `depth` bytes (8 at least); the first ones are the 8 bytes themselves, mixed."""
    if len(raw) < depth:
        return np.zeros(0, np.uint64)
    ids, n = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,)) * _MIX, 8
    ids ^= ids >> np.uint64(31)
    while n < depth:
        step = min(n, depth - n)
        ids, n = paired(ids, step), n + step
    return ids


def least(ids: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbouring values."""
    n = 1
    while n < width:
        step = min(n, width - n)
        if len(ids) <= step:
            return ids[:0]
        ids, n = np.minimum(ids[: len(ids) - step], ids[step:]), n + step
    return ids


class Chunk:
    """Texts of a chunk as one byte array, and the runs of strings that one q-gram identifier represents."""

    def __init__(self, batch: pa.RecordBatch, id_column: str, text_column: str, length: int):
        self.batch = batch
        text = batch.column(batch.schema.get_field_index(text_column)).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = text.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        ids = batch.column(batch.schema.get_field_index(id_column)).cast(pa.int64())
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.length = length

    def runs(self) -> None:
        """Sets starts, ends (of string positions), key and doc (row number) of each run."""
        smallest = least(identifiers(self.raw, Q), self.length - Q + 1)
        n = len(smallest)
        inside = np.ones(n, bool)
        for a, e, known in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), self.known.tolist()):
            inside[max(a, e - self.length + 1) if known else a : e] = False
        head, tail = inside.copy(), inside.copy()
        if n > 1:
            cut = smallest[1:] != smallest[:-1]
            head[1:] &= cut | ~inside[:-1]
            tail[:-1] &= cut | ~inside[1:]
        self.starts = np.flatnonzero(head)
        self.ends = np.flatnonzero(tail) + 1
        self.key = smallest[self.starts]
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1


def place(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each identifier. The upper half decides: least identifiers are small, so fewer bits would not fill many buckets."""
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def short(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def long(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").ravel()


def grouped_by(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(values[part[0]]), part


def cut_at(edges: np.ndarray, mask: np.ndarray, body: bytes, width: int) -> pa.Array:
    """`body`, the `width` bytes of each masked entry, as one binary value for the entries from each edge to the next."""
    before = np.append(0, np.cumsum(mask))
    offsets = (before[np.append(edges, len(mask))] * width).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])


def packed_chunks(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(chunk, body): Arrow batches of whole rows, stored bucketed by chunk; and the bytes of all texts."""
    spark = docs.sparkSession
    text_at = docs.columns.index("text")

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        held, size = [], 0

        def flush():
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])

        for rb in it:
            sizes = np.cumsum(pa.compute.binary_length(rb.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False) + 16)
            at = 0
            while at < rb.num_rows:
                base = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, base + chunk_bytes - size, "right")))
                held.append(rb.slice(at, end - at))
                size += int(sizes[end - 1] - base)
                at = end
                if size >= chunk_bytes or at < rb.num_rows:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    import pyarrow.compute  # noqa: F401  (pa.compute is loaded with it)

    chunks = docs.mapInArrow(pack, "chunk long, body binary")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions(spark, total)
    name = f"pagelens_chunks_{uuid.uuid4().hex}"
    chunks.repartition(parts, "chunk").write.bucketBy(parts, "chunk").option("path", work_folder(spark, "chunks")).option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name), total


def opened(body: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(pa.py_buffer(body)).read_all().combine_chunks()
    return table.to_batches()[0]


def by_bucket(rows: DataFrame, parts: int) -> DataFrame:
    """`rows` dealt out by bucket, over as many partitions as the texts need."""
    return rows.repartition(parts, "bucket")


def shared_keys(chunks: DataFrame, as_chunk: Callable[[pa.RecordBatch], Chunk], buckets: int, parts: int, hot: int) -> DataFrame:
    """(chunk, lists): for each chunk the keys that more than one document has; the hot ones in a list of their own."""
    sent = "chunk long, bucket long, single binary, several binary, counts binary"

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for number, body in zip(rb.column(0).to_pylist(), rb.column(1)):
                c = as_chunk(opened(body.as_py()))
                c.runs()
                order = np.lexsort((c.doc, c.key))
                key, doc = c.key[order], c.ids[c.doc[order]]
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key = key[fresh]
                keys, counts = np.unique(key, return_counts=True)
                bucket = place(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                keys, counts, bucket = keys[order], counts[order], bucket[order]
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
                one = counts == 1
                if len(keys):
                    columns = [
                        pa.array(np.full(len(edges), number)), pa.array(bucket[edges]), cut_at(edges, one, short(keys[one]), KEY_BYTES),
                        cut_at(edges, ~one, short(keys[~one]), KEY_BYTES), cut_at(edges, ~one, counts[~one].astype("<u4").tobytes(), 4),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "single", "several", "counts"])

    answer = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())])

    def decide(table: pa.Table) -> pa.Table:
        numbers = table["chunk"].to_pylist()
        bucket = table["bucket"][0].as_py()
        parts, counts, chunk = [], [], []
        for k, (one, more, n) in enumerate(zip(table["single"].to_pylist(), table["several"].to_pylist(), table["counts"].to_pylist())):
            keys = np.concatenate([long(one), long(more)])
            parts.append(keys)
            counts.append(np.concatenate([np.ones(len(one) // KEY_BYTES, np.int64), np.frombuffer(n, "<u4").astype(np.int64)]))
            chunk.append(np.full(len(keys), k))
        keys, counts, chunk = np.concatenate(parts), np.concatenate(counts), np.concatenate(chunk)
        order = np.argsort(keys, kind="stable")
        keys, counts, chunk = keys[order], counts[order], chunk[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        total = np.repeat(np.add.reduceat(counts, head), np.diff(np.append(head, len(keys)))) if len(keys) else counts
        keep = total > 1
        keys, chunk, total = keys[keep], chunk[keep], total[keep]
        rows = []
        for k, part in grouped_by(chunk):
            mine, n = keys[part], total[part]
            rows.append({"chunk": numbers[k], "bucket": bucket, "shared": short(mine[n <= hot]), "hot": short(mine[n > hot])})
        return pa.Table.from_pylist(rows, schema=answer)

    answers = by_bucket(chunks.mapInArrow(send, sent), parts).groupBy("bucket").applyInArrow(decide, "chunk long, bucket long, shared binary, hot binary")
    return stored(answers, "shared-keys").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("lists"))


def member(keys: np.ndarray, lists: list[dict], field: str, buckets: int) -> np.ndarray:
    """Which of `keys` are named by the chunk's lists (bucket and short key).

    Beyond 2^24 buckets the upper bits of the bucket fall away: a key may then be named in error, which costs
    a comparison and changes no result, for the whole strings decide.
    """
    known = [((np.uint64(x["bucket"]) << np.uint64(40)) | long(x[field])) for x in lists if x[field]]
    if not known:
        return np.zeros(len(keys), bool)
    mine = (place(keys, buckets).astype(np.uint64) << np.uint64(40)) | (keys & np.uint64((1 << 40) - 1))
    return np.isin(mine, np.concatenate(known))


SENT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int8()), ("body", pa.binary())])
DECIDED, AROUND, WHOLE = 0, 1, 2


def squeezed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(a.tobytes() for a in arrays))


def unsqueezed(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, "<u8", len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def surroundings(c: Chunk, number: int, lists: list[dict], buckets: int) -> Iterator[dict]:
    """What the chunk sends to the buckets of its shared keys, and what it can decide by itself."""
    c.runs()
    is_hot = member(c.key, lists, "hot", buckets)
    is_shared = member(c.key, lists, "shared", buckets) & ~is_hot
    decided: list[tuple[int, int]] = []
    picked = np.flatnonzero(is_shared)
    if len(picked):
        reach = c.length - 1
        whole = identifiers(c.raw, c.length)
        first, last, doc = c.starts[picked], c.ends[picked] - 1, c.ids[c.doc[picked]]
        # a run of at most twice the length is told by its first string, its last string and their distance
        same = paired(np.stack([whole[first], whole[last]], axis=1).ravel(), 1)[::2] + (last - first).astype(np.uint64) * _MUL
        order = np.lexsort((doc, same))
        picked, doc, same = picked[order], doc[order], same[order]
        head = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        smallest = np.repeat(doc[head], np.diff(np.append(head, len(doc))))
        long_run = c.ends[picked] - c.starts[picked] > c.length
        lost = (doc > smallest) & ~long_run  # what repeats within the smallest document is sent, and is lost or stays together
        decided += merged(c.starts[picked[lost]], c.ends[picked[lost]] + reach).tolist()
        chosen = picked[~lost]
        for b, part in grouped_by(place(c.key[chosen], buckets)):
            part = chosen[part]
            part = part[np.argsort(c.key[part], kind="stable")]
            size = c.ends[part] + reach - c.starts[part]
            at = np.arange(size.sum()) + np.repeat(c.starts[part] - (np.cumsum(size) - size), size)
            yield {"chunk": number, "bucket": b, "kind": AROUND, "body": squeezed(c.ids[c.doc[part]], c.starts[part].astype("<i4"), size.astype("<i4"), c.raw[at])}
    picked = np.flatnonzero(is_hot)
    if len(picked):
        at = np.concatenate([np.arange(a, e) for a, e in zip(c.starts[picked].tolist(), c.ends[picked].tolist())])
        doc = np.repeat(c.ids[c.doc[picked]], c.ends[picked] - c.starts[picked])
        whole = identifiers(c.raw, c.length)[at]
        order = np.lexsort((doc, whole))
        at, doc, whole = at[order], doc[order], whole[order]
        head = np.append(True, whole[1:] != whole[:-1])
        smallest = np.repeat(doc[head], np.diff(np.append(np.flatnonzero(head), len(doc))))
        lost = doc > smallest
        decided += merged(at[lost], at[lost] + c.length).tolist()
        at, doc, whole = at[~lost], doc[~lost], whole[~lost]
        for b, part in grouped_by(place(whole, buckets)):
            yield {"chunk": number, "bucket": b, "kind": WHOLE, "body": squeezed(doc[part], at[part].astype("<i4"), whole[part])}
    if decided:
        runs = np.array(decided, np.int64)
        yield {"chunk": number, "bucket": number % buckets, "kind": DECIDED, "body": merged(runs[:, 0], runs[:, 1]).astype("<i4").tobytes()}


def merged(starts: np.ndarray, ends: np.ndarray, touching: bool = False) -> np.ndarray:
    """Overlapping runs united, as rows (start, end); runs that only touch may belong to two documents."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    head = np.append(True, s[1:] > e[:-1] if touching else s[1:] >= e[:-1])
    last = np.append(np.flatnonzero(head)[1:], len(s)) - 1
    return np.stack([s[head], e[last]], axis=1)


def refined(table: pa.Table, length: int) -> pa.Table:
    """Decides a bucket: (chunk, body) with the runs of each chunk that a smaller document has, too."""
    out: list[dict] = []
    chunks, docs, starts, sizes, raws = [], [], [], [], []
    whole_chunk, whole_doc, whole_at, whole_id = [], [], [], []
    for number, kind, body in zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["body"].to_pylist()):
        if kind == DECIDED:
            out.append({"chunk": number, "body": body})
        elif kind == AROUND:
            d, a, n, raw = unsqueezed(body, "<i8", "<i4", "<i4", "u1")
            chunks.append(np.full(len(d), number))
            docs.append(d)
            starts.append(a.astype(np.int64))
            sizes.append(n.astype(np.int64))
            raws.append(raw)
        else:
            d, a, ident = unsqueezed(body, "<i8", "<i4", "<u8")
            whole_chunk.append(np.full(len(d), number))
            whole_doc.append(d)
            whole_at.append(a.astype(np.int64))
            whole_id.append(ident)
    candidates = []
    if docs:
        chunk, doc, start, size, raw = map(np.concatenate, (chunks, docs, starts, sizes, raws))
        count = size - length + 1
        of = np.repeat(np.arange(len(size)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        position = np.arange(len(of)) + of * (length - 1)
        depth, ids = Q, identifiers(raw, Q)
        alive = np.arange(len(position))
        while depth < length:
            step = min(depth, length - depth)
            ids, depth = paired(ids, step), depth + step
            slots = (ids[position[alive]] & np.uint64((1 << max(1, (4 * len(alive)).bit_length())) - 1)).astype(np.int64)
            alive = alive[np.bincount(slots)[slots] > 1]  # alone in its bucket: nothing to refine
        if len(alive):
            candidates.append((ids[position[alive]], doc[of[alive]], chunk[of[alive]], start[of[alive]] + at[alive]))
    if whole_doc:
        candidates.append(tuple(map(np.concatenate, (whole_id, whole_doc, whole_chunk, whole_at))))
    for ident, d, number, a in candidates:
        order = np.argsort(ident, kind="stable")
        ident, d, number, a = ident[order], d[order], number[order], a[order]
        head = np.flatnonzero(np.append(True, ident[1:] != ident[:-1]))
        smallest = np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(ident))))
        lost = d > smallest
        a, number = a[lost], number[lost]
        for _, part in grouped_by(number):
            out.append({"chunk": int(number[part[0]]), "body": merged(a[part], a[part] + length).astype("<i4").tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("body", pa.binary())]))


def chunk_spans(c: Chunk, bodies: list[bytes]) -> list[np.ndarray]:
    """For each row of the chunk, the removed runs (start, end) in bytes of its text."""
    runs = np.concatenate([np.frombuffer(b, "<i4").reshape(-1, 2) for b in bodies]).astype(np.int64) if bodies else np.zeros((0, 2), np.int64)
    row = np.searchsorted(c.offsets, runs[:, 0], "right") - 1
    out = [np.zeros((0, 2), np.int64)] * c.batch.num_rows
    for k, part in grouped_by(row):
        out[k] = merged(runs[part, 0], runs[part, 1], touching=True) - c.offsets[k]
    return out


def kept_bytes(raw: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return raw
    cuts = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:e] for a, e in zip(cuts[::2], cuts[1::2]))


def with_spans(docs: DataFrame, finish: Callable[[Chunk, list[np.ndarray]], pa.RecordBatch], schema: str, length: int = 50, chunk_bytes: int = 2 << 20, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Run `finish` on every chunk of `docs` (doc_id, text, ...) and the removed runs of its rows."""
    if not Q < length <= 4 * Q:
        raise ValueError(f"length must be over {Q} and at most {4 * Q}")
    spark = docs.sparkSession
    docs = docs.withColumn("text", docs["text"].cast("string"))
    text_batches(spark)
    chunks, total = packed_chunks(docs, chunk_bytes)
    parts = partitions(spark, total)
    buckets = max(4 * parts, -(-total // bucket_bytes))

    def as_chunk(batch: pa.RecordBatch) -> Chunk:
        return Chunk(batch, "doc_id", "text", length)

    lists = shared_keys(chunks, as_chunk, buckets, parts, hot)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for k in range(rb.num_rows):
                rows = list(surroundings(as_chunk(opened(rb.column(1)[k].as_py())), rb.column(0)[k].as_py(), rb.column(2)[k].as_py() or [], buckets))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SENT)

    sent = chunks.join(lists, "chunk").select("chunk", "body", "lists").mapInArrow(send, "chunk long, bucket long, kind byte, body binary")
    runs = by_bucket(sent, parts).groupBy("bucket").applyInArrow(lambda t: refined(t, length), "chunk long, body binary")
    runs = stored(runs, "repeated-runs").groupBy("chunk").agg(F.collect_list("body").alias("runs"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for k in range(rb.num_rows):
                c = as_chunk(opened(rb.column(0)[k].as_py()))
                yield finish(c, chunk_spans(c, rb.column(1)[k].as_py() or []))

    return chunks.join(runs, "chunk", "left").select("body", "runs").mapInArrow(cut, schema)


def repeat_report(docs: DataFrame, length: int = 50, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(c: Chunk, spans: list[np.ndarray]) -> pa.RecordBatch:
        data = c.raw.tobytes()
        texts = [data[a:e] for a, e in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [
                c.batch.column(c.batch.schema.get_field_index("doc_id")), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(texts, spans)], pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return with_spans(docs.select("doc_id", "text"), finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, **options)


def whole_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """The runs shortened so that no character is cut: one that is covered in part stays."""
    out = []
    for a, e in spans.tolist():
        while a < e and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if a < e:
            out.append((a, e))
    return np.array(out, np.int64).reshape(-1, 2)


def without_repeats(docs: DataFrame, length: int = 50, **options) -> DataFrame:
    """`docs` with the repeated strings cut out of `text` by whole characters; n_chars, if present, follows."""

    def finish(c: Chunk, spans: list[np.ndarray]) -> pa.RecordBatch:
        data = c.raw.tobytes()
        valid = c.batch.column(c.batch.schema.get_field_index("text")).is_valid().to_pylist()
        texts = []
        for a, e, s, ok in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), spans, valid):
            raw = data[a:e]
            texts.append(kept_bytes(raw, whole_characters(raw, s)).decode() if ok else None)
        columns = dict(zip(c.batch.schema.names, c.batch.columns))
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    return with_spans(docs, finish, schema, length, **options)
