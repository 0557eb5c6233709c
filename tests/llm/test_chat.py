"""Chat formatting against brute force, and the way back."""

import hashlib
import random

from pyspark.sql import functions as F

from pagelens.llm import chat
from pagelens.llm.running import placed

SCHEMA = "conv_id long, turn long, role string, text string, seq string, start string, piece long, example long"


def rows_of():
    r = random.Random(5)
    bits = ["\\", "#", "##", "###", "####", "</turn>", "</", "turn>", "\\h", "\\b", "\\t", "\\c", ": ", ":", "\n", "é", "😀", "ok ", "### assistant: "]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "a:b", "\\c###", "", None]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"long {t} " + "x" * 200) for t in range(300)]  # a third of all rows
    rows += [(60, None, "user", "first"), (60, 3, None, None), (60, 3, "assistant", "tie"), (60, 3, "assistant", "tie"), (61, 0, "user", "no reply"), (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (62, 0, "assistant", "y" * 300000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*row, "s", "t", k, k) for k, row in enumerate(rows)], SCHEMA).repartition(7)


def ordered(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def formatted(turns):
    def safe(x, role=False):
        x = x.replace("\\", "\\b").replace("###", "\\h").replace("</turn>", "\\t")
        return x.replace(":", "\\c") if role else x

    return [f"### {safe(r, True)}: {safe(t)}</turn>\n" for r, t in turns]


def test_report_matches_brute_force(spark):
    rows = rows_of() + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    want = set()
    for c, turns in ordered(rows).items():
        pieces = formatted(turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len("".join(pieces[: k + 1])) for k, (r, _) in enumerate(turns) if r == "assistant")
        want.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    assert {tuple(x) for x in chat.chat_report(chat.with_probe(frame(spark, rows_of()))).collect()} == want


def test_examples_are_prefixes_with_one_reply(spark):
    rows = rows_of()
    folder = chat.format_conversations(frame(spark, rows))
    texts = {(x.conv_id, x.example): x for x in chat.example_texts(spark, folder).collect()}
    streams = ordered(rows)
    assert set(texts) == {(c, k) for c, turns in streams.items() for k, (r, _) in enumerate(turns) if r == "assistant"}
    for (c, k), x in texts.items():
        pieces = formatted(streams[c][: k + 1])
        assert x.text == "".join(pieces) and x.text.count("</turn>") == k + 1 == x.text.count("### ")
        assert x.text[x.loss_start : x.loss_end] + "</turn>\n" == pieces[-1][pieces[-1].index(": ") + 2 :]
    few = spark.createDataFrame([(50, 299), (60, 2)], "conv_id long, example long")
    assert {(x.conv_id, x.example) for x in chat.example_texts(spark, folder, few).collect()} == {(50, 299), (60, 2)}
    turns, _ = chat.read_back(spark, folder)
    assert sorted((str(x.conv_id), x.seq, x.role, x.text) for x in turns.collect()) == sorted((str(c), k, r, t) for c, turns in streams.items() for k, (r, t) in enumerate(turns))


def test_nothing_in(spark):
    assert chat.chat_report(frame(spark, []).limit(0)).count() == 0


def test_places_over_several_partitions(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 101, k) for k in range(900)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = placed(df, "g", [F.col("o"), F.col("v")], F.col("v"), "places")
    want = set()
    for g in {r[0] for r in rows}:
        total = 0
        for seq, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want.add((g, o, v, seq, total))
            total += v
    assert {tuple(x) for x in got.collect()} == want
