"""Feed files: one URL a line, ``#`` comments; accepted and rejected rows with reasons, the first of equal URLs wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url, reject_reason

#: Line ends that Python's splitlines knows, and the largest feed that is read.
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
MOST_BYTES, LIMIT = 10_000_000, 300
SOURCE = ("source", "source_label", "fetched_at", "batch_id")


def read_lines(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(line, raw_url) of a feed file, numbered from 1. A feed is one text of at most ``most`` bytes, hence one task."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("value"))
    text = text.withColumn("value", F.when(F.octet_length("value") > most, F.raise_error(F.lit("invalid_limit_or_feed_size")).cast("string")).otherwise(F.col("value")))
    return text.select(F.posexplode(F.split("value", _LINES)).alias("at", "raw_url")).select((F.col("at") + 1).alias("line"), "raw_url")


def classify(lines: DataFrame) -> DataFrame:
    """Adds normalized_url, reason (null: accepted) and accepted; blank and comment lines are skipped.

    Only accepted rows are numbered within their address: rejected ones share the key null and stay where they are.
    """
    rows = lines.filter((F.trim("raw_url") != "") & ~F.trim("raw_url").startswith("#"))
    rows = rows.withColumns({"reason": reject_reason(F.col("raw_url")), "normalized_url": normalize_url(F.col("raw_url"), international=True)})
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & F.col("normalized_url").isNull(), "invalid_host").otherwise(F.col("reason")))
    good = rows.filter("reason IS NULL")
    nth = F.row_number().over(Window.partitionBy("normalized_url").orderBy("line"))
    good = good.withColumn("reason", F.when(nth > 1, "duplicate_normalized_url"))
    return good.unionByName(rows.filter("reason IS NOT NULL")).withColumn("accepted", F.col("reason").isNull())


def accepted(rows: DataFrame, limit: int = LIMIT, source: str = "", source_label: str = "", fetched_at: str = "", batch_id: str = "") -> DataFrame:
    """The first ``limit`` accepted rows of ``classify`` with where they come from; the label says what the source claims."""
    if limit < 1:
        raise ValueError("invalid_limit_or_feed_size")
    told = dict(zip(SOURCE, (source, source_label, fetched_at, batch_id), strict=True))
    kept = rows.filter("accepted").orderBy("line").limit(limit).select(F.col("normalized_url").alias("url"), "raw_url", "normalized_url", "line")
    return kept.withColumns({"label": F.lit("phishing"), "label_semantics": F.lit("unverified_source_intelligence"), **{k: F.lit(v) for k, v in told.items()}})


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("NOT accepted").select("line", "raw_url", "reason", "normalized_url")
