r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

A conversation is one stream of formatted turns, `### role: text</turn>` and a line end each. The example of an assistant
turn is the stream from its beginning to the end of that turn, and only the turn's text is under the loss mask. All
examples of a conversation are prefixes of the same stream, so the stream is written once, a row per turn (`pieces`), and
`examples` has for each assistant turn its context's and its reply's positions in code points. The output is as large as
the input, however long a conversation is; whole texts of the examples would grow with the square of its length
(`example_texts` makes them where they are wanted).

Inside texts the control strings are escaped: \ as \b, ### as \h, </turn> as \t, and in roles : as \c. No escaped text
holds a control string, and every backslash begins an escape, so the way back is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.running import placed
from pagelens.llm.shared import text_batches, work_folder

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Control string and its escape, in the order of escaping.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TRAINABLE = "assistant"


def escaped(column: Column, pairs=ESCAPES) -> Column:
    for raw, safe in pairs:
        column = F.replace(column, F.lit(raw), F.lit(safe))
    return column


def unescaped(column: Column, pairs=ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        column = F.replace(column, F.lit(safe), F.lit(raw))
    return column


def format_conversations(conversations: DataFrame, folder: str | None = None) -> str:
    """Write `pieces` and `examples` below a folder (a new one in the shared folder by default) and return its name.

    pieces(conv_id, seq, start, piece): the formatted turn `seq` (from 0) begins at code point `start` of the stream.
    examples(conv_id, example, seq, end, loss_start, loss_end): the text is the stream's [0, end), its context
    [0, loss_start) with the reply's header, the trainable reply [loss_start, loss_end).

    Turns are ordered by turn (null first), then role and text. Null roles and texts are empty; rows without a conv_id are one
    conversation; a repeated row is a further turn; an empty table gives empty tables. A conversation may lie in many partitions.
    """
    spark = conversations.sparkSession
    folder = folder or work_folder(spark, "chat")
    rows = conversations.select("conv_id", "turn", *(F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    header = F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    rows = rows.withColumn("piece", F.concat(header, escaped(F.col("text")), F.lit(CLOSE))).withColumn("header", F.length(header).cast("long"))
    turns = placed(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], F.length("piece"), "chat-turns")
    turns.select("conv_id", "seq", "start", "piece").write.parquet(f"{folder}/pieces")
    end = F.col("start") + F.length("piece")
    target = turns.where(F.col("role") == TRAINABLE)
    target.select("conv_id", F.col("seq").alias("example"), "seq", end.alias("end"), (F.col("start") + F.col("header")).alias("loss_start"), (end - len(CLOSE)).alias("loss_end")).write.parquet(f"{folder}/examples")
    return folder


def read_back(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(turns, examples) from the files alone: turns(conv_id, seq, role, text) parsed from the pieces, and the examples
    with `loss`, the unescaped text under their mask.
    """
    pieces, examples = spark.read.parquet(f"{folder}/pieces"), spark.read.parquet(f"{folder}/examples")
    middle = F.locate(MIDDLE, F.col("piece"))
    role = unescaped(F.substring("piece", F.lit(len(OPEN) + 1), middle - len(OPEN) - 1), ROLE_ESCAPES)
    text = unescaped(F.substring("piece", middle + len(MIDDLE), F.length("piece") - middle - len(MIDDLE) - len(CLOSE) + 1))
    turns = pieces.select("conv_id", "seq", role.alias("role"), text.alias("text"))
    side = pieces.select(F.col("conv_id").alias("_c"), F.col("seq").alias("_s"), "start", "piece")
    held = examples.join(side, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seq") == F.col("_s")))
    loss = unescaped(F.substring("piece", (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    return turns, held.select(*examples.columns, loss.alias("loss"))


def example_texts(spark, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with whole texts, of all examples or of the (conv_id, example) rows wanted.

    Every text repeats its context, so a conversation's texts grow with the square of its length.
    """
    pieces, examples = spark.read.parquet(f"{folder}/pieces"), spark.read.parquet(f"{folder}/examples")
    if wanted is not None:
        examples = examples.join(wanted.select("conv_id", "example").distinct(), ["conv_id", "example"], "left_semi")
    side = pieces.select(F.col("conv_id").alias("_c"), F.col("seq").alias("_s"), "piece")
    rows = examples.join(side, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_s") <= F.col("seq")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_s", "piece"))), lambda x: x["piece"])
    return rows.groupBy("conv_id", "example", "loss_start", "loss_end").agg(F.array_join(parts, "").alias("text")).select("conv_id", "example", "text", "loss_start", "loss_end")


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its rows in order; nothing but two running digests is kept."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, done = None, []

    def closed():
        return {"conv_id": now[0], "n_turns": now[1], "turns_sha256": now[2].hexdigest(), "loss_chars": now[3], "loss_sha256": now[4].hexdigest(), "formatted_chars": now[5]}

    for batch in batches:
        for conv, said, loss, end in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if now is None or conv != now[0]:
                if now is not None:
                    done.append(closed())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(said.encode())
            if loss is not None:
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += end
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def chat_report(conversations: DataFrame) -> DataFrame:
    """Format, write, read back; per conversation n_turns, the digests of its turns and of its trainable text, loss_chars, and
    formatted_chars, the code points of all its examples' texts (contexts included).

    A SHA-256 runs over its conversation's rows one after another, so here a conversation is read by one task, as a stream.
    """
    spark = conversations.sparkSession
    text_batches(spark)
    turns, examples = read_back(spark, format_conversations(conversations))
    side = examples.select(F.col("conv_id").alias("_c"), F.col("seq").alias("_s"), "loss", "end")
    said = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    rows = turns.join(side, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seq") == F.col("_s")), "left").select("conv_id", "seq", said.alias("said"), "loss", "end")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "said", "loss", "end")
    return stream.mapInArrow(_digests, REPORT)


def with_probe(conversations: DataFrame) -> DataFrame:
    r"""The conversations and -7, a user and an assistant turn that both say `\### Assistant: </turn> ok`."""
    probe = conversations.sparkSession.createDataFrame([(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
