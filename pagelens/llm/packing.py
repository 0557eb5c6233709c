"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest sequence are cut into pieces of that length and a rest. The narrow
piece rows are dealt out evenly (round robin over sorted rows, so neither a long document nor a
repeated id fills one task and a repeated task sees the same rows) and every task packs blocks of at
most `block` pieces:
best fit, longest piece first, each into the open sequence that it fills best. If none has room, a new
sequence is opened with the length of least cost per token: its price (its length, a fixed overhead, and
what attention adds, which grows with the square of the length) over the tokens that the lengths still
unpacked can put into it, largest first. At the end every sequence is downsized to the smallest permitted
length that holds its contents. A block is also packed with one opening length throughout, for each
permitted length, and the packing of least total price is kept: several lengths never cost more than one.

Defined results
  * each piece is placed exactly once, at an offset where no other piece of its bin lies;
  * null and empty texts have the length of the end mark alone; lengths under 1 count as 1;
  * null doc_ids and repeated rows are packed like others; an empty table gives no row;
  * equal lengths keep the order of (doc_id, piece); other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.shared import text_of

CAPACITIES = (512, 1024, 2048, 4096)
ROWS_EACH = 200_000
# Attention costs as much as all else at about six times the width of a model, here 4096.
ATTENTION = 6 * 4096


def word_length(docs: DataFrame) -> Column:
    """Words of the whole text and an end mark."""
    return F.regexp_count(text_of(docs), F.lit(r"\S+")) + 1


def price(capacity: int, overhead: int, attention: int | None) -> float:
    """A sequence's cost in tokens; with `attention` the length at which attention costs as much as all else."""
    return capacity + overhead + (capacity * capacity / attention if attention else 0)


def reachable(length: int, capacity: int, counts: list[int], has: int) -> int:
    """Tokens that a sequence opened for a piece can get from the unpacked lengths, largest first; bit n of `has` is set if counts[n]."""
    room = bound = capacity - length
    while fits := has & ((2 << min(room, bound)) - 1):
        n = fits.bit_length() - 1
        room -= n * min(counts[n], room // n)
        bound = n - 1
    return capacity - room


def opened(length: int, unpacked: int, capacities: tuple[int, ...], overhead: int, attention: int | None = None, fill=None) -> int:
    """The permitted length of least cost per token that holds a piece of `length`; ties go to the longer one."""
    fill = fill or (lambda c: min(c, unpacked))
    return min((c for c in capacities if c >= length), key=lambda c: (price(c, overhead, attention) / fill(c), -c))


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int, attention: int | None = None, least: int | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each piece, and the final length of each bin. `lengths` descends.

    With `least` every bin opens at that length, or the next that holds its piece.
    """
    room: dict[int, list[int]] = {}
    has = 0  # bit r is set when an open bin has r tokens of room
    filled: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    unpacked = int(lengths.sum())
    counts = np.bincount(lengths, minlength=1).tolist()
    left_over = sum(1 << n for n, k in enumerate(counts) if k and n)
    for i, n in enumerate(lengths.tolist()):
        counts[n] -= 1
        if not counts[n]:
            left_over ^= 1 << n
        fits = has >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                has ^= 1 << r
        else:
            if least is None:
                r = opened(n, unpacked, capacities, overhead, attention, lambda c: reachable(n, c, counts, left_over))
            else:
                r = next(c for c in capacities if c >= max(n, least))
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        unpacked -= n
        if left := r - n:
            room.setdefault(left, []).append(b)
            has |= 1 << left
    return bins, offsets, [next(c for c in capacities if c >= f) for f in filled]


def cheapest(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int, attention: int | None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The packing of least total price: lengths chosen bin by bin, or one opening length throughout. Ties go to the first."""
    tries = (best_fit(lengths, capacities, overhead, attention, least) for least in (None, *capacities))
    return min(tries, key=lambda found: sum(price(c, overhead, attention) for c in found[2]))


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = 8, block: int = ROWS_EACH, attention: int | None = ATTENTION) -> DataFrame:
    """(doc_id, piece, length, bin, capacity, offset): one row per piece, with the sequence that holds it."""
    spark = docs.sparkSession
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", F.greatest(F.coalesce((word_length(docs) if length is None else length).cast("long"), F.lit(1)), F.lit(1)).alias("n"))
    last = F.floor((F.col("n") - 1) / largest).cast("int")
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(largest), F.col("n") - F.col("piece").cast("long") * largest).cast("int").alias("length"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks)

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            nonlocal first
            rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
            bins, offsets, lengths = cheapest(rows["length"].to_numpy(), capacities, overhead, attention)
            out = pa.RecordBatch.from_arrays(
                [*(rows[c].combine_chunks() for c in ("doc_id", "piece", "length")), pa.array(bins + first), pa.array(np.array(lengths, np.int32)[bins]), pa.array(offsets.astype(np.int32))],
                ["doc_id", "piece", "length", "bin", "capacity", "offset"],
            )
            first += len(lengths)
            return out

        for rb in it:
            for i in range(0, rb.num_rows, block):
                part = rb.slice(i, block)
                if held and sum(b.num_rows for b in held) + part.num_rows > block:
                    yield flush(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held and sum(b.num_rows for b in held):
            yield flush(pa.Table.from_batches(held))

    return dealt.mapInArrow(packed, f"doc_id {kind}, piece int, length int, bin long, capacity int, offset int")
