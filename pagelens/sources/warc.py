"""Crawls stored as WARC archives: a writer, an index of given archives, and a Spark data source over the index.

An archive has one gzip member per record. Its index is a small table with one row per range of whole records (a partition of
the reader, `range_bytes` of the archive); where each record of a range starts stands in a file of 64-bit numbers beside it, which
only the task of that range reads. So the driver sees ranges, never records, and a task holds one slab of records at a time.
A reader without `html` in its schema unpacks the headers of a record and leaves its body packed; where records are large, the
bodies are not fetched either.

The index is the manifest: archives get names of their own for each attempt, and what no index row names is never opened. Bodies
are not shuffled by the writer; archives follow the partitions of the crawl.

Defined results
  * a crawl that was written comes back whole, fetches without a response too; bytes that are not UTF-8 become U+FFFD;
  * archives of other writers give their response records: site is the host, ord the archive's place in the index and the
    record's offset, html the body after transfer and content codings, in the charset of its Content-Type (else UTF-8); of
    repeated headers the first counts; what WARC does not tell is null;
  * an empty crawl, an empty archive and other record types give no row; a damaged archive is an error.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelens.schemas import CRAWL

INDEX = "archive string, offsets string, first bigint, n_records bigint, offset bigint, n_bytes bigint"
RANGE_BYTES = 128 << 20
SLAB_BYTES = 4 << 20
HEAD_BYTES = 4096
BATCH_ROWS = 1000
ROW_HEADER = "X-Crawl-Row"
END = b"\r\n\r\n"
_STORED = """
    to_json(named_struct('site', site, 'ord', ord, 'url', url, 'final_url', final_url, 'status_code', status_code, 'headers', map_entries(headers),
    'redirect_history', redirect_history, 'redirect_status_codes', redirect_status_codes, 'error_message', error_message, 'ttfb_ms', ttfb_ms,
    'total_ms', total_ms, 'html_size_bytes', html_size_bytes, 'compressed_size', compressed_size, 'crawl_depth', crawl_depth,
    'fetched_at', unix_micros(fetched_at), 'no_html', html is null), map('ignoreNullFields', 'false'))
"""


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Ranges:
    """Collects the starts of an archive's records, cuts them into ranges and writes the numbers beside it."""

    def __init__(self, archive: str, offsets: str, range_bytes: int):
        self.archive, self.offsets, self.range_bytes = archive, offsets, range_bytes
        self.sink, self.rows, self.n = None, [], 0

    def add(self, offset: int, size: int) -> None:
        if self.sink is None:
            files, path = _files(self.offsets)
            self.sink = files.open_output_stream(path, compression=None)
        if not self.rows or self.rows[-1]["n_bytes"] + size > self.range_bytes:
            self.rows.append({"archive": self.archive, "offsets": self.offsets, "first": self.n, "n_records": 0, "offset": offset, "n_bytes": 0})
        self.sink.write(offset.to_bytes(8, "little"))
        self.n += 1
        self.rows[-1]["n_records"] += 1
        self.rows[-1]["n_bytes"] += size

    def close(self) -> pa.RecordBatch:
        if self.sink is not None:
            self.sink.close()
        kinds = [("archive", pa.string()), ("offsets", pa.string())] + [(n, pa.int64()) for n in ("first", "n_records", "offset", "n_bytes")]
        return pa.RecordBatch.from_pylist(self.rows, schema=pa.schema(kinds))


def _line(text: str) -> str:
    return " ".join(text.split())


def _record(stored: str, body: bytes) -> bytes:
    row = json.loads(stored)
    fields = "".join(f"{_line(x['key'])}: {_line(x['value'] or '')}\r\n" for x in row["headers"] or [])
    block = f"HTTP/1.1 {row['status_code'] or 0} -\r\n{fields}\r\n".encode() + body
    date = datetime.fromtimestamp((row["fetched_at"] or 0) // 1_000_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{row['site']}/{row['ord']}/{row['url']}")
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {''.join((row['url'] or '').split())}\r\n"
        f"{ROW_HEADER}: {json.dumps(row)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + END


def write_crawl_warc(crawl: DataFrame, folder: str, roll_bytes: int = 1 << 30, range_bytes: int = RANGE_BYTES) -> None:
    """Write a crawl as archives of about `roll_bytes` and their index below `folder`, which all machines reach."""
    folder = folder.rstrip("/")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(f"{path}/archives", recursive=True)
        out = ranges = None
        at = 0
        for rb in it:
            for i in range(rb.num_rows):
                coder = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = coder.compress(_record(rb.column(0)[i].as_py(), rb.column(1)[i].as_py())) + coder.flush()
                if out is not None and at + len(member) > roll_bytes:
                    out.close()
                    yield ranges.close()
                    out = None
                if out is None:
                    name, at = f"/archives/{uuid.uuid4().hex}.warc.gz", 0
                    out, ranges = files.open_output_stream(path + name, compression=None), _Ranges(folder + name, f"{folder}{name}.offsets", range_bytes)
                out.write(member)
                ranges.add(at, len(member))
                at += len(member)
        if out is not None:
            out.close()
            yield ranges.close()

    rows = crawl.selectExpr(f"{_STORED} as stored", "cast(coalesce(html, '') as binary) as body")
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")


def index_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> None:
    """Index given archives, one name per row of `archives` (path), as `folder`; each is read once, by one task."""
    folder = folder.rstrip("/")
    spark = archives.sparkSession

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(f"{path}/archives", recursive=True)
        for rb in it:
            for archive in rb.column(0).to_pylist():
                ranges = _Ranges(archive, f"{folder}/archives/{uuid.uuid4().hex}.offsets", range_bytes)
                source, name = _files(archive)
                with source.open_input_stream(name, compression=None) as stream:
                    for offset, size in _member_sizes(stream, archive):
                        ranges.add(offset, size)
                yield ranges.close()

    names = archives.select(F.col("path").cast("string")).where("path is not null").distinct()
    width = max(1, spark.sparkContext.defaultParallelism)
    names.repartition(width).mapInArrow(scan, INDEX).write.parquet(f"{folder}/index")


def _member_sizes(stream, name: str, step: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """(offset, size) of each gzip member; what is unpacked is dropped at once."""
    start = done = 0
    coder = None
    while data := stream.read(step):
        while data:
            coder = coder or zlib.decompressobj(31)
            given = data
            while not coder.eof and data:
                coder.decompress(data, SLAB_BYTES)
                data = coder.unconsumed_tail
            data = coder.unused_data if coder.eof else b""
            done += len(given) - len(data)
            if coder.eof:
                yield start, done - start
                start, coder = done, None
    if coder is not None:
        raise ValueError(f"{name} ends inside a record")


def _unpacked(data: bytes, whole: bool, name: str) -> bytes:
    """A record, or as much of it as holds its WARC and HTTP headers."""
    coder = zlib.decompressobj(31)
    if whole:
        raw = coder.decompress(data)
        if not coder.eof:
            raise ValueError(f"a record of {name} is cut off")
        return raw
    raw = b""
    while raw.count(END) < 2 and not coder.eof:
        more = coder.decompress(data, HEAD_BYTES)
        data = coder.unconsumed_tail
        if not more and not data:
            break
        raw += more
    return raw


def _fields(head: bytes) -> dict[str, str]:
    """Header fields in order; the first of a name counts."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            out.setdefault(key.strip(), value.strip())
    return out


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].partition(b";")[0] or b"0", 16)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def _decoded(body: bytes, http: dict[str, str]) -> str:
    """The body as text, after its transfer and content codings."""
    low = {k.lower(): v for k, v in http.items()}
    if "chunked" in low.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    coding = low.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        body = zlib.decompressobj(47).decompress(body)
    charset = low.get("content-type", "").lower().partition("charset=")[2].partition(";")[0].strip(" \"'")
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _row(raw: bytes, whole: bool, place: int) -> dict | None:
    """A record as a row of the crawl's columns; null for records that are no response."""
    head, _, block = raw.partition(END)
    warc = {k.lower(): v for k, v in _fields(head).items()}
    if warc.get("warc-type") != "response":
        return None
    length = int(warc["content-length"])
    top, _, body = block.partition(END)
    body = body[: length - len(top) - len(END)]
    if ROW_HEADER.lower() in warc:
        row = json.loads(warc[ROW_HEADER.lower()])
        row["headers"] = None if row["headers"] is None else [(x["key"], x["value"]) for x in row["headers"]]
        row["ttfb_ms"], row["total_ms"] = (None if row[k] is None else float(row[k]) for k in ("ttfb_ms", "total_ms"))
        if row["fetched_at"] is not None:
            row["fetched_at"] = pa.scalar(row["fetched_at"], pa.timestamp("us", "UTC"))
        row["html"] = None if row.pop("no_html") or not whole else body.decode("utf-8", "replace")
        return row
    http = _fields(top)
    url = warc.get("warc-target-uri", "").strip("<>")
    status = top.split(b"\r\n", 1)[0].split(b" ")[1:2]
    date = warc.get("warc-date")
    return {
        "site": url.partition("://")[2].partition("/")[0].lower(), "ord": place, "url": url, "final_url": url, "status_code": int(status[0]) if status and status[0].isdigit() else None,
        "headers": list(http.items()), "redirect_history": [], "redirect_status_codes": [], "html_size_bytes": max(0, length - len(top) - len(END)),
        "fetched_at": pa.scalar(datetime.fromisoformat(date), pa.timestamp("us", "UTC")) if date else None, "html": _decoded(body, http) if whole else None,
    }


class _Range(InputPartition):
    def __init__(self, row: dict, place: int):
        self.row, self.place = row, place


class WarcCrawlReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder.rstrip("/"), schema

    def partitions(self) -> list[_Range]:
        import pyarrow.dataset as ds

        files, path = _files(f"{self.folder}/index")
        rows = ds.dataset(path, filesystem=files, format="parquet").to_table().to_pylist()
        places = {a: k for k, a in enumerate(sorted({r["archive"] for r in rows}))}
        return [_Range(r, places[r["archive"]]) for r in rows]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an index without rows
            return
        r, shape = partition.row, to_arrow_schema(self.schema)
        whole = "html" in self.schema.fieldNames()
        files, path = _files(r["offsets"])
        with files.open_input_file(path) as f:
            numbers = f.read_at(8 * r["n_records"], 8 * r["first"])
        starts = [int.from_bytes(numbers[k : k + 8], "little") for k in range(0, len(numbers), 8)] + [r["offset"] + r["n_bytes"]]
        far = not whole and r["n_bytes"] > 16 * HEAD_BYTES * r["n_records"]
        rows, held = [], 0
        files, path = _files(r["archive"])
        with files.open_input_file(path) as f:
            slab, base, k = b"", starts[0], 0
            for k, (a, e) in enumerate(zip(starts[:-1], starts[1:])):
                if far:
                    size = HEAD_BYTES
                    while (raw := _unpacked(f.read_at(min(size, e - a), a), False, r["archive"])).count(END) < 2 and size < e - a:
                        size *= 4
                else:
                    if e > base + len(slab):
                        last = k + 1
                        while last < len(starts) - 1 and starts[last + 1] - a <= SLAB_BYTES:
                            last += 1
                        slab, base = f.read_at(starts[last] - a, a), a
                    raw = _unpacked(slab[a - base : e - base], whole, r["archive"])
                row = _row(raw, whole, (partition.place << 40) + a)
                if row is None:
                    continue
                rows.append({n: row.get(n) for n in shape.names})
                held += len(raw)
                if held > SLAB_BYTES or len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


class WarcCrawl(DataSource):
    """`spark.read.format("pagelens_warc").load(folder)`; a schema of fewer columns of the crawl reads only those."""

    @classmethod
    def name(cls) -> str:
        return "pagelens_warc"

    def schema(self) -> str:
        return CRAWL

    def reader(self, schema: StructType) -> WarcCrawlReader:
        return WarcCrawlReader(self.options["path"], schema)


def read_crawl_warc(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    spark.dataSource.register(WarcCrawl)
    return spark.read.format(WarcCrawl.name()).schema(schema).load(folder)
