"""Observations as a stream: first sighting of each URL, within a watermark. An addition, not a batch operator's twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def first_seen(spark: SparkSession, path: str, schema, key: str = "url", at: str = "ts", delay: str = "1 day") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
