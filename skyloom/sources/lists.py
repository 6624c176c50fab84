"""URL lists of any length, numbered in parallel: lines are counted by split, and a split starts where the ones before it end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Line ends besides LF, CR and CR LF, which Spark's reader splits at.
_OTHER = r"[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw_url) of text files, numbered from 1 in each file, a byte order mark left out.

    Splits are read at the same time; what is gathered is one row (file, split, lines) for each of them.
    """
    at = F.col("_metadata")
    rows = spark.read.text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("split"), F.explode(F.split("value", _OTHER)).alias("raw_url"))
    rows = rows.withColumn("m", F.monotonically_increasing_id())  # ascends within a split, which one task reads from end to end
    splits = rows.groupBy("file", "split").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    out = rows.join(splits, ["file", "split"]).withColumn("line", F.col("m") + F.col("shift"))
    return out.select("file", "line", F.when(F.col("line") == 1, F.regexp_replace("raw_url", "^\\x{FEFF}", "")).otherwise(F.col("raw_url")).alias("raw_url"))
