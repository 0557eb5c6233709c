"""Deterministic sharded WARC writer and its reader.

Payload digests and sizes come from a narrow projection; the smallest page_id of each digest is found
by a grouped minimum, so a payload that a third of all pages share is combined before it is shuffled.
The bounds of the shards are exact: running sums of bytes over the sorted page_ids, not a sample, so they depend on the
rows alone. Pages and their references then go through one range shuffle on page_id, are sorted, and each shard is
written as gzip-member-per-record archives, starting a new file when the compressed size passes
`roll_bytes`. Large tables have shards of SHARD_BYTES, several files each. Headers, record ids and digests are made anew from the data alone, so a repeated task
writes the same bytes. A file is written under a temporary name and renamed; the manifest (a table)
lists the files of finished tasks only, and the reader opens what the manifest lists.

Defined results
  * a null html is the empty payload; an empty table gives no file and no row;
  * payloads under `least_bytes` bytes are always response records;
  * of equal larger payloads the one with the smallest page_id is the response; a further row with the
    same page_id and payload revisits it; rows without page_id revisit it too and are responses only if
    no equal payload has a page_id;
  * a null url leaves out the target; line breaks in a url are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.running import placed
from pagelens.llm.shared import filesystem, publish, stored, text_batches, work_folder
from pagelens.operators.skew import salted_join

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long, first_page long, last_page long, sha256 string"
# Payload of a shard of a large table, and of one of a small table, which gets at most FEW_SHARDS.
SHARD_BYTES = 512 << 20
SMALL_SHARD_BYTES = 4 << 20
FEW_SHARDS = 256
RECORD_BYTES = 512
_CLEAN = {c: f"%{c:02X}" for c in [*range(33), 127]}


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int, date: str) -> bytes:
    """One whole record: WARC headers, then the block (HTTP headers and, for a response, the payload)."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate(_CLEAN)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def references(sized: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, first): rows of sized(page_id, digest, size) that are long enough and shared, with their smallest page_id.

    A digest that many rows share is salted on its way back to them.
    """
    long = sized.where(F.col("size") >= least_bytes).select("page_id", "digest")
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    return salted_join(long, firsts, ["digest"], ["page_id"], "inner").distinct()


def shard_count(total: int) -> int:
    """From the payload alone, so that every session deals the same shards."""
    return max(1, -(-total // SHARD_BYTES), min(FEW_SHARDS, -(-total // SMALL_SHARD_BYTES)))


BY_BYTES = f"size + {RECORD_BYTES}L"
BY_ROWS = "1L"


def shard_starts(sized: DataFrame, shards: int, weight: str = BY_BYTES) -> list[int]:
    """The first page_id of every shard but the first: one number for each, whatever the rows. One id is never in two shards."""
    weights = sized.groupBy("page_id").agg(F.expr(f"sum({weight})").alias("size")).withColumn("all", F.lit(0))
    runs = placed(weights, "all", [F.col("page_id").asc_nulls_first()], F.col("size"), "warc-weights")
    total = sized.agg(F.expr(f"sum({weight})")).first()[0] or 1
    dealt = runs.groupBy(F.floor(F.col("start").cast("decimal(38,0)") * shards / total).alias("shard")).agg(F.min("page_id").alias("lowest"))
    return sorted(r.lowest for r in dealt.where("lowest is not null").select("lowest").collect())[1:]


def shard_of(starts: list[int]) -> Column:
    """The number of starts up to page_id, by bisection; rows without page_id are in the first shard."""
    if not starts:
        return F.lit(0)
    steps = ", ".join(str(1 << b) for b in reversed(range(len(starts).bit_length())))
    known = f"from_json('{starts}', 'array<bigint>')"
    found = f"aggregate(array({steps}), 0, (n, step) -> if(n + step <= {len(starts)} and get({known}, n + step - 1) <= page_id, n + step, n))"
    return F.expr(f"if(page_id is null, 0, {found})")


def write_warc(
    pages: DataFrame, folder: str, least_bytes: int = 100, roll_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 6, shards: int | None = None
) -> DataFrame:
    """Write all rows of pages(page_id, url, html) below `folder`; returns the manifest, one row per file.

    With `shards` there are that many shards of about equally many rows, else as many as the bytes ask for, of about equal bytes.
    """
    spark = pages.sparkSession
    text_batches(spark)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    sized = stored(rows.select("page_id", F.sha2(F.col("payload"), 256).alias("digest"), F.octet_length("payload").alias("size")), "warc-sizes")
    refs = stored(references(sized, least_bytes), "warc-references")
    if shards is None:
        starts = shard_starts(sized, shard_count(sized.agg(F.sum("size")).first()[0] or 0))
    else:
        starts = shard_starts(sized, shards, BY_ROWS)
    none = F.lit(None)
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", none.cast("string").alias("digest"), none.cast("long").alias("first")).unionByName(
        refs.select("page_id", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", "first")
    )
    dealt = both.withColumn("shard", shard_of(starts)).repartitionById(len(starts) + 1, "shard")
    sorted_rows = dealt.sortWithinPartitions("shard", "page_id", "kind", "url", "payload")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        attempt = uuid.uuid4().hex
        out = shard = None
        page, first_of, copies = object(), {}, {}

        def finish(o):
            o["sink"].close()
            publish(files, o["temporary"], o["name"])
            return pa.RecordBatch.from_pylist([{"path": folder.rstrip("/") + o["name"][len(path) :], "n_records": o["n"], "n_bytes": o["size"], "first_page": o["first"], "last_page": o["last"], "sha256": o["sum"].hexdigest()}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("first_page", pa.int64()), ("last_page", pa.int64()), ("sha256", pa.string())]))

        for rb in it:
            for i in range(rb.num_rows):
                page_id, kind = rb.column(0)[i].as_py(), rb.column(1)[i].as_py()
                if rb.column(6)[i].as_py() != shard:
                    if out is not None:
                        yield finish(out)
                    out, shard, number = None, rb.column(6)[i].as_py(), 0
                if page_id != page:
                    page, first_of, copies = page_id, {}, {}
                if kind == 0:
                    first_of[rb.column(4)[i].as_py()] = rb.column(5)[i].as_py()
                    continue
                payload = rb.column(3)[i].as_py()
                digest = hashlib.sha256(payload).hexdigest()
                copy = copies.get(digest, 0)
                copies[digest] = copy + 1
                refers_to = first_of.get(digest)
                if refers_to is not None and refers_to == page_id and copy == 0:
                    refers_to = None
                coder = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = coder.compress(record(page_id, rb.column(2)[i].as_py(), payload, digest, refers_to, copy, date)) + coder.flush()
                if out is not None and out["size"] + len(member) > roll_bytes:
                    yield finish(out)
                    out = None
                if out is None:
                    name = f"{path}/shard-{shard:06d}-{number:04d}.warc.gz"
                    number += 1
                    out = {"name": name, "temporary": f"{name}.{attempt}.tmp", "n": 0, "size": 0, "first": page_id, "sum": hashlib.sha256()}
                    out["sink"] = files.open_output_stream(out["temporary"], compression=None)
                out["sink"].write(member)
                out["sum"].update(member)
                out.update(n=out["n"] + 1, size=out["size"] + len(member), last=page_id)
        if out is not None:
            yield finish(out)

    return stored(sorted_rows.mapInArrow(write, MANIFEST), "warc-manifest")


def members(stream, step: int = 1 << 14) -> Iterator[bytes]:
    """The decompressed records of an archive, one at a time."""
    coder, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(step)
            if not data:
                break
        parts.append(coder.decompress(data))
        data = b""
        if coder.eof:
            yield b"".join(parts)
            data, coder, parts = coder.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record, with lower-case header names; checks length and block digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    top, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in top.decode().split("\r\n")[1:])}
    return headers, http, payload


def read_warc(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record of the listed files."""
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for uri in rb.column(0).to_pylist():
                files, path = filesystem(uri)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for raw in members(stream):
                        headers, http, payload = parse(raw)
                        response = headers["warc-type"] == "response"
                        row = {
                            "page_id": int(headers["x-page-id"]) if "x-page-id" in headers else None, "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"],
                            "payload_bytes": len(payload) if response else int(http["content-length"]),
                            "payload_digest": hashlib.sha256(payload).hexdigest() if response else headers["warc-payload-digest"].partition(":")[2],
                            "refers_to": int(headers["x-refers-to-page-id"]) if "x-refers-to-page-id" in headers else None,
                        }
                        if response and row["payload_digest"] != headers["warc-payload-digest"].partition(":")[2]:
                            raise ValueError(f"payload digest of {headers['warc-record-id']} differs")
                        rows.append(row | {"payload": payload} if with_payload else row)
                        held += len(payload) if with_payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=shape)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    files = manifest.select("path")
    return files.repartitionByRange(max(1, manifest.count()), "path").mapInArrow(read, kinds)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages, read the archives back and return what each record says."""
    manifest = write_warc(pages, work_folder(pages.sparkSession, "warc"), **options)
    return read_warc(pages.sparkSession, manifest).drop("url")
