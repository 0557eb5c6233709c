"""WARC and token files: round trips, digests, and defined results at the edges."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelens.llm import tokens, warc
from pagelens.llm.shared import work_folder
from tests.llm.data import documents, mixed_rows, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pages(spark):
    long = "<html>" + prose(1, 80) + "</html>"
    rows = [
        (5, "http://a/5", long), (2, "http://a/2", long), (9, None, long), (9, "http://a/9", long), (None, "http://a/n", long), (3, "http://a/3\r\nX: y z", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""),
        (8, "u", "é" * 50), (10, "u", "é" * 50), (11, "u", "é" * 49), (12, "u", "é" * 49), (13, "u", prose(5, 20000)), (None, "n", "<p>" + prose(7, 50)), (None, "n", "<p>" + prose(7, 50)),
    ]
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, kind int, digest string")


def test_warc_round_trip(spark, pages):
    manifest = warc.write_warc(pages, work_folder(spark, "warc-test"), roll_bytes=20_000, shards=3)
    files = manifest.collect()
    assert len(files) > 3 and len({f.path for f in files}) == len(files)
    back = warc.read_warc(spark, manifest, with_payload=True).collect()
    bodies = lambda rows: sorted((str(r[0]), r[1]) for r in rows)
    wanted = [(r.page_id, hashlib.sha256((r.html or "").encode()).hexdigest()) for r in pages.collect()]
    assert bodies(wanted) == bodies([(r.page_id, r.payload_digest) for r in back])
    for r in back:
        if r.record_type == "response":
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes and r.refers_to is None
    revisits = sorted((str(r.page_id), r.refers_to) for r in back if r.record_type == "revisit")
    assert revisits == [("10", 8), ("5", 2), ("9", 2), ("9", 2), ("None", 2)]
    assert any(r.url == "http://a/3%0D%0AX:%20y%20z" for r in back)


@pytest.mark.parametrize("shards", [1, 5, None])
def test_warc_is_deterministic(spark, pages, shards, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_SHARD_BYTES", 4000)
    more = pages.unionByName(spark.range(100, 140).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 100) as html", "1 as kind", "'d' as digest"))
    sums = []
    for parts in (1, 4, 3):
        manifest = warc.write_warc(more.repartition(parts), work_folder(spark, "warc-same"), shards=shards, roll_bytes=20_000)
        sums.append(sorted((f.path.rsplit("/", 1)[1], f.n_records, f.sha256) for f in manifest.collect()))
    names = {n[:12] for n, _, _ in sums[0]}
    assert all(s == sums[0] for s in sums) and len(names) >= (shards or 3) and len(sums[0]) > len(names) - (shards is None)


def test_warc_shards_follow_the_rows_alone(spark):
    """Bounds by hand: equal shares of bytes in page_id order, one id never in two shards."""
    sizes = {k: 100 + 37 * (k % 11) for k in range(-50, 350)} | {120: 90_000}
    rows = [(k, "d", n) for k, n in sizes.items()] + [(None, "d", 10), (7, "d", 10)]
    total = sum(n + warc.RECORD_BYTES for _, _, n in rows)
    firsts, run = {}, 0
    for k in sorted({r[0] for r in rows}, key=lambda k: (k is not None, k or 0)):
        firsts.setdefault(run * 8 // total, k)
        run += sum(n + warc.RECORD_BYTES for i, _, n in rows if i == k)
    starts = [k for k in firsts.values() if k is not None]
    sized = spark.createDataFrame(rows, "page_id long, digest string, size int")
    got = [warc.shard_starts(sized.repartition(p), 8) for p in (1, 5)]
    assert got[0] == got[1] == starts
    dealt = sized.select("page_id", warc.shard_of(starts).alias("shard")).collect()
    assert all(r.shard == sum(s <= r.page_id for s in starts) if r.page_id is not None else r.shard == 0 for r in dealt)
    assert warc.shard_count(0) == 1 and warc.shard_count(100 << 20) == 25 and warc.shard_count(1 << 47) == (1 << 47) // warc.SHARD_BYTES


def test_warc_damage_is_noticed():
    raw = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, 0, "2000-01-01T00:00:00Z")
    assert warc.parse(raw)[2] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_warc_empty(spark, pages):
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_pieces_encode_like_whole_texts():
    texts = [t or "" for _, t in mixed_rows()] + ["a  b", "a \n b", "a\n b", " a", "a ", "<|endoftext|> x", "x <|endoftext|>y", "a  b", "tab\t x", "it's  \n\n ok.\nNo", "　 z", "don't 12 34ab!? ..."]
    plain = Tokenizer.from_file(BPE)
    coder = tokens.Encoder(BPE, 0)
    got = coder.encode(texts)
    assert [np.frombuffer(g, coder.dtype).tolist() for g in got] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_token_files_round_trip(spark):
    rows = mixed_rows()
    docs = documents(spark, rows)
    plain = Tokenizer.from_file(BPE)
    manifest = tokens.write_sequences(docs, work_folder(spark, "tokens-test"), BPE, length=64, batch=4, files=3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ordered]
    got = sorted(tokens.read_documents(spark, manifest).collect(), key=lambda r: (r.file, r.start_in_file))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(ordered, ids)]
    flat = []
    for f in manifest.orderBy("file").collect():
        reader = tokens.open_sequences(f.path)
        count = sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))
        for k in range(count):
            values, mask = tokens.sequence(reader, k, 4)
            assert len(values) == len(mask) == 64
            assert not values.flags.owndata
            flat += values[mask].tolist()
    assert flat == [x for d in ids for x in d]


def test_token_report(spark):
    rows = [(3, "c d"), (1, "a b"), (2, None)]
    got = {r.doc_id: r for r in tokens.token_ids(documents(spark, rows), BPE).collect()}
    assert [got[k].start for k in (1, 2, 3)] == [0, got[1].n_tokens, got[1].n_tokens + 1] and got[2].n_tokens == 1
    assert tokens.token_ids(documents(spark, []), BPE).count() == 0
    assert json.loads(Tokenizer.from_file(BPE).to_str())["pre_tokenizer"]["type"] == "ByteLevel"
