"""The pipeline's stages against the single operators' brute force, and the queries' checking SQL."""

import duckdb

import corpus_pipeline
from pagelens.llm.queries import ORACLES, QUERIES
from tests.llm.data import documents, prose
from tests.llm.test_duplicates import repeats, shingle_set


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "suffix_array", "decontamination", "packing"]
    item = prose(31, 25, [w + "q" for w in ("alba", "borg", "cent", "dure", "ella", "fono", "gala", "hett")])
    rows = [(k, prose(k, 60)) for k in range(60)]
    labels = [(k, 1, 0) for k in range(60)]
    for k in range(60, 120):
        rows.append((k, prose(k, 40) + " idiot scum " + prose(k + 1000, 5)))
        labels.append((k, 1, 1))
    shared = prose(5000, 20)
    rows += [(200, rows[5][1]), (201, rows[6][1] + " end"), (202, prose(70001, 30) + " " + shared), (203, prose(70002, 30) + " " + shared), (204, prose(70003, 30) + " " + item + " " + prose(70004, 9)), (205, None)]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()] if k < 5 else None
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(before)
        assert name == "packing" or docs.columns == columns
    ids = [{i for i, _ in s} for s in seen]
    assert ids[1] == set(range(60)) | set(range(200, 206))
    assert ids[2] == ids[1] - {200, 201}
    assert len(shingle_set(rows[6][1], 5)) > 50
    wanted = {int(i): removed for i, _, removed, _, _ in repeats(seen[2], 50)}
    cut = {i: t for i, t in seen[3]}
    assert all(len((dict(seen[2])[i] or "").encode()) - len((cut[i] or "").encode()) == wanted[i] for i in wanted) and wanted[203] > 50
    assert ids[4] == ids[3] - {204}
    assert sum(r.length for r in docs.collect()) == sum(len((t or "").split()) + 1 for _, t in seen[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length").collect())) == sorted(map(tuple, docs.select("doc_id", "length").collect()))


def test_checking_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, folder)
        rows = con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got.collect()), name
