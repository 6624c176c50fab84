"""Token counts by an exact length histogram.

Documents are aggregated by encoded length, with partial sums in each task, so what is shuffled is one row per distinct
length. Over that histogram suffix sums answer, for every context limit at once, how many documents are longer, how many
tokens truncation to the limit keeps and loses, and every quantile. A limit is any length that occurs; values between
two of them follow from the row below.

Lengths are counts of token ids of a tokenizer file. The histogram is read twice, so it is written once: a text is encoded
one time. Defined cases: null text has length 0; other columns are dropped; empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pieces


def token_lengths(df: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: its length in ids."""

    def count(batches):
        from .op1_packing import encoder

        encode = encoder(tokenizer)
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            ids = encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(np.array([len(x) // 4 for x in ids], np.int64))], names=["length"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(count, "length long")


def histogram(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    return lengths.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("docs"))


def limits(hist: DataFrame, block: int = 256) -> DataFrame:
    """Per length as a context limit: documents and tokens up to it, documents above, kept and lost tokens, quantile.

    Sums run in two levels, within blocks of ``block`` consecutive lengths and over the blocks' totals, so the single
    ordered window holds one row per block, at most the longest length / ``block``.
    """
    rows = durable(hist).withColumn("b", F.expr(f"length div {block}"))
    sums = rows.groupBy("b").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select("b", F.coalesce(F.sum("d").over(upto), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("t0"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    own = Window.partitionBy("b").orderBy("length")
    rows = rows.withColumns({"d": F.sum("docs").over(own), "t": F.sum(F.col("docs") * F.col("length")).over(own)}).join(sums, "b")
    docs_upto, tokens_upto = F.col("d0") + F.col("d"), F.col("t0") + F.col("t")
    above = F.col("all_docs") - docs_upto
    kept = tokens_upto + above * F.col("length")
    return rows.select("length", "docs", docs_upto.alias("docs_upto"), above.alias("docs_above"), tokens_upto.alias("tokens_upto"), kept.alias("kept_tokens"), (F.col("all_tokens") - kept).alias("lost_tokens"), (docs_upto / F.col("all_docs")).alias("quantile"))


def query(spark, sf_dir: str) -> DataFrame:
    return limits(histogram(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
