"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept, and returns the
columns of documents; the last one returns the packed pieces.

  toxicity         documents that the classifier rejects (score >= 0.7) go
  minhash          one document of each group with shingle similarity >= 0.8 (five words) stays
  suffix_array     bytes of 50-byte strings that an earlier document has are cut, by whole characters
  decontamination  documents that hold a benchmark item go
  packing          what is left is packed into sequences of 512 to 4096 words

Rows with a null doc_id or a null text pass all filters; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelens.llm.decontaminate import without_leaks
from pagelens.llm.minhash import one_of_each
from pagelens.llm.packing import pack
from pagelens.llm.shared import stored
from pagelens.llm.substrings import without_repeats
from pagelens.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, size=5, percent=80)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, length=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("minhash", minhash), ("suffix_array", suffix_array), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
