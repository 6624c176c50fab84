"""Page facts kept between runs: a table bucketed by page key, to which a run adds the pages that it does not hold yet.

A page's key is the hash of its text, its address and the rules in force, so other rules make other keys and nothing old is
taken for new. The table is bucketed and sorted by key: looking pages up shuffles the rows that ask and never the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import facts
from .rules import BUILT_IN, Rules

BUCKETS = 256


def keyed(df: DataFrame, html: str = "html", url: str = "url", rules: Rules = BUILT_IN) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.withColumn("page_key", F.sha2(F.concat_ws("\x00", F.lit(rules.digest), text(html), text(url)), 256))


def learn(df: DataFrame, table: str, html: str = "html", url: str = "url", buckets: int = BUCKETS) -> int:
    """Evaluate the pages that ``table`` does not hold and append their facts; how many there were.

    Equal pages count once. A run that fails before its append leaves the table as it was. Two runs at the same time can append the
    same page; ``recall`` takes one row of a key.
    """
    spark = df.sparkSession
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    new = keyed(df, html, url).select("page_key", text(html), text(url))
    before = 0
    if spark.catalog.tableExists(table):
        new = new.join(spark.table(table).select("page_key"), "page_key", "left_anti")
        before = spark.table(table).count()
    rows = facts(new.distinct(), html, url).select("page_key", "facts")
    rows.write.bucketBy(buckets, "page_key").sortBy("page_key").mode("append").format("parquet").saveAsTable(table)
    return spark.table(table).count() - before


def recall(df: DataFrame, table: str, html: str = "html", url: str = "url") -> DataFrame:
    """``df`` without page texts and with the facts that ``table`` has of its pages; null for pages that it has not."""
    known = df.sparkSession.table(table).groupBy("page_key").agg(F.any_value("facts").alias("facts"))
    return keyed(df, html, url).drop(html).join(known, "page_key", "left").drop("page_key")
