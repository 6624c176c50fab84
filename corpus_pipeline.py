"""Documents to training sequences: toxicity, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
``documents``. Between stages the rows are written to the shared folder as Parquet and read again.

Defined cases, for every stage: null and empty texts are kept, except that one without words is taken as often as its source's
rate says by the mix; null ids and null sources stay; repeated rows are rows of their own (the near-duplicate stage keeps one of
each group, the mix makes new ones); very long texts are processed whole; extra columns, whatever their names, go with their rows up
to packing, which returns pieces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import durable, forget
from skyloom.llm.op1_packing import pack
from skyloom.llm.op4_toxicity import train, without_toxic
from skyloom.llm.op6_substring import without_repeats
from skyloom.llm.op9_chosen_path import keep_first
from skyloom.llm.op10_mixing import mixed_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on the labelled ones among them, rejects."""
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return keep_first(docs, num=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 13 words or more that a document with a smaller id holds."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that sources come near their target weights."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("packing", packing)]

#: Tokens and trained models cannot be expressed in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            now: list[str] = []
            docs = durable(docs, now)
            forget(spark, before)
            before = now
    return docs
