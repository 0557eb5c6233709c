"""Token-ID output: Arrow files of equal-length sequences and masks that are read without copying.

Documents are dealt out by ranges of doc_id and sorted inside each range. A task encodes its range,
ends every document with `end_id`, cuts the ids into sequences of `length` and writes them as record
batches of fixed-size lists (Arrow IPC file format): sequence k of a file is found by its number alone
and is a slice of the mapped file. The last sequence of a file is filled with `end_id` under a mask of
false. A second small Arrow file lists (doc_id, n_tokens) in order, so the documents can be cut out
again. Both are written under a temporary name and renamed when whole.

Defined results
  * null and empty texts are the end id alone; whole texts are encoded, whatever their length;
  * null doc_ids come first; rows with one doc_id stand side by side in the order of their text;
  * an empty table gives no file and no row; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.shared import filesystem, partitions, publish, stored, text_batches, text_of, work_folder

CACHE_WORDS = 800_000
# Stands for a piece with white space at an edge, whose text is encoded whole (no ids are of odd length).
ODD = b"\0"
_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


class Encoder:
    """Encodes whole texts with a `tokenizers` file.

    A byte-level BPE cuts a text before each single space between visible characters, so the ids of
    a text are those of its space-separated pieces, side by side. Pieces recur; each is encoded once
    and remembered (at most CACHE_WORDS at a time). Texts with any other white space next to a
    space, or with a special token's string, are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16
        self.dtype = np.dtype("<u4") if self.wide else np.dtype("<u2")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        kind = spec.get("pre_tokenizer") or {}
        self.by_piece = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec.get("normalizer")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.pieces: dict[str, bytes] = {}
        self.odd = False

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        if len(self.pieces) + len(new) > CACHE_WORDS:
            self.pieces.clear()
        plain = []
        for p in new:
            if not p or p[0].isspace() or p[-1].isspace():
                self.odd, self.pieces[p] = True, ODD
            else:
                plain.append(p)
        size = self.dtype.itemsize
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                raise ValueError("pieces and their first tokens do not match")
            raw = ids.astype(self.dtype).tobytes()
            cuts = [*(starts * size).tolist(), len(raw)]
            self.pieces.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian bytes of `dtype`."""
        out: list[bytes | None] = [None] * len(texts)
        slow, split, new = [], [], set()
        for k, t in enumerate(texts):
            if not self.by_piece or any(s in t for s in self.special):
                slow.append(k)
                continue
            head, *rest = t.split(" ")
            found = list(map(self.pieces.get, rest))
            gaps = [i for i, ids in enumerate(found) if ids is None] if None in found else ()
            new.update(map(rest.__getitem__, gaps))
            split.append((k, head, rest, found, gaps))
        if new:
            self.learn(list(new))
        for (k, head, rest, found, gaps), first in zip(split, self.whole([s[1] for s in split])):
            for i in gaps:
                found[i] = self.pieces[rest[i]]
            if head[-1:].isspace() or self.odd and ODD in found:
                slow.append(k)
            else:
                out[k] = b"".join([first, *found, self.end])
        for k, ids in zip(slow, self.whole([texts[k] for k in slow])):
            out[k] = ids + self.end
        return out


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def sequence_schema(value: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])


def sequence_batch(schema: pa.Schema, ids: np.ndarray, real: int) -> pa.RecordBatch:
    length = schema.field("ids").type.list_size
    mask = np.arange(len(ids)) < real
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema
    )


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = 2048, batch: int = 256, files: int | None = None) -> DataFrame:
    """Write the files and return the manifest, one row per file: (file, path, index_path, n_documents, n_tokens)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    text_batches(spark)
    rows = docs.select("doc_id", text_of(docs).alias("t"))
    if files is None:
        total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        files = partitions(spark, total)
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "t")
    id_type = pa.int64() if kind in ("bigint", "int") else pa.string()

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_, path = filesystem(folder)
        files_.create_dir(path, recursive=True)
        coder = encoder(tokenizer, end_id)
        number, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        schema = sequence_schema(pa.uint32() if coder.wide else pa.uint16(), length)
        name, index_name = f"{path}/part-{number:06d}.arrow", f"{path}/part-{number:06d}.index.arrow"
        step, held, held_bytes, total, n_docs = batch * length * coder.dtype.itemsize, [], 0, 0, 0
        index_schema = pa.schema([("doc_id", id_type), ("n_tokens", pa.int64())])
        sink = files_.open_output_stream(f"{name}.{attempt}.tmp")
        index_sink = files_.open_output_stream(f"{index_name}.{attempt}.tmp")
        with pa.ipc.new_file(sink, schema) as out, pa.ipc.new_file(index_sink, index_schema) as index:
            for rb in it:
                for i in range(0, rb.num_rows, 256):
                    part = rb.slice(i, 256)
                    coded = coder.encode(part.column(1).to_pylist())
                    counts = [len(c) // coder.dtype.itemsize for c in coded]
                    index.write_batch(pa.RecordBatch.from_arrays([part.column(0).cast(id_type), pa.array(counts, pa.int64())], schema=index_schema))
                    total, n_docs = total + sum(counts), n_docs + len(counts)
                    held += coded
                    held_bytes += sum(map(len, coded))
                    if held_bytes >= step:
                        raw = b"".join(held)
                        for at in range(0, len(raw) - step + 1, step):
                            out.write_batch(sequence_batch(schema, np.frombuffer(raw, coder.dtype, batch * length, at), batch * length))
                        held = [raw[len(raw) - len(raw) % step :]]
                        held_bytes = len(held[0])
            ids = np.frombuffer(b"".join(held), coder.dtype)
            if len(ids):
                filled = np.full(-(-len(ids) // length) * length, end_id, coder.dtype)
                filled[: len(ids)] = ids
                out.write_batch(sequence_batch(schema, filled, len(ids)))
        sink.close()
        index_sink.close()
        if not n_docs:
            files_.delete_file(f"{name}.{attempt}.tmp")
            files_.delete_file(f"{index_name}.{attempt}.tmp")
            return
        publish(files_, f"{name}.{attempt}.tmp", name)
        publish(files_, f"{index_name}.{attempt}.tmp", index_name)
        base = folder.rstrip("/")
        yield pa.RecordBatch.from_pylist([{"file": number, "path": base + name[len(path) :], "index_path": base + index_name[len(path) :], "n_documents": n_docs, "n_tokens": total}])

    return stored(rows.mapInArrow(write, "file long, path string, index_path string, n_documents long, n_tokens long"), "token-manifest")


def open_sequences(path: str):
    """The Arrow file of one manifest row: mapped into memory where the folder is local, else read by ranges."""
    from pyarrow import fs

    files, name = filesystem(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(name))


def sequence(reader, k: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number k of an open file and its mask: found by its number; the ids are a view of the file."""
    rb = reader.get_batch(k // batch)
    row = k % batch
    return rb.column(0)[row].values.to_numpy(), rb.column(1)[row].values.to_numpy(zero_copy_only=False)


def read_documents(spark: SparkSession, manifest: DataFrame, id_kind: str = "bigint") -> DataFrame:
    """(file, doc_id, start_in_file, n_tokens, ids_crc32): every document cut out of the files again."""
    id_type = pa.int64() if id_kind in ("bigint", "int") else pa.string()

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for row in rb.to_pylist():
                reader, index = open_sequences(row["path"]), open_sequences(row["index_path"])
                flat = (reader.get_batch(k).column(0).flatten().to_numpy() for k in range(reader.num_record_batches))
                ids, at, start = np.zeros(0, np.uint16), 0, 0
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    sums, starts = [], []
                    for n in part.column(1).to_pylist():
                        left, crc = n, 0
                        while left:
                            if at == len(ids):
                                ids, at = next(flat), 0
                            take = ids[at : at + left]
                            crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                            at, left = at + len(take), left - len(take)
                        sums.append(crc)
                        starts.append(start)
                        start += n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["file"]] * part.num_rows, pa.int64()), part.column(0).cast(id_type), pa.array(starts, pa.int64()), part.column(1), pa.array(sums, pa.int64())],
                        ["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"],
                    )

    work = manifest.select("file", "path", "index_path").repartitionByRange(max(1, manifest.count()), "file")
    return work.mapInArrow(read, f"file long, doc_id {id_kind}, start_in_file long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048) -> DataFrame:
    """Write all documents, read the files back and return (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    manifest = write_sequences(docs, work_folder(spark, "tokens"), tokenizer, end_id, length)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))  # one row per file
    rows = read_documents(spark, manifest, docs.schema["doc_id"].dataType.simpleString())
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
