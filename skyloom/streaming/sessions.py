"""Session windows on event logs, as a batch in two steps and as a stream. An addition to the batch operators.

A session of a key ends where the next event is more than ``gap`` later; events exactly ``gap`` apart are of one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smallest and largest time, count, sum and kinds: what two parts of a session can be put together from.
def _parts(at: str, value: str, kind: str) -> list[Column]:
    cents = F.round(F.col(value) * 100).cast("long")
    return [F.min(at).alias("begins"), F.max(at).alias("ends"), F.count("*").alias("events"), F.coalesce(F.sum(cents), F.lit(0)).alias("cents"), F.array_sort(F.collect_set(kind)).alias("kinds")]


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", at: str = "ts", value: str = "value", kind: str = "event_type", step: str = "1 day") -> DataFrame:
    """One row per session: key, begins, ends, events, cents (values in hundredths), kinds (sorted).

    A first aggregation finds sessions within steps of time, so that the events of a busy key are spread over as many tasks as it has
    steps; the second puts together the few that meet at the edges of steps. Rows without time or key have no session.
    """
    known = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__step", F.window(F.col(at), step)["start"])
    first = known.groupBy(key, "__step", F.session_window(at, gap)).agg(*_parts(at, value, kind))
    own = Window.partitionBy(key).orderBy("begins", "ends")
    before = F.max("ends").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("begins") > before + F.expr(f"INTERVAL {gap}"), F.lit(True))
    placed = first.withColumn("__opens", opens).withColumn("__session", F.sum(F.col("__opens").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = [F.min("begins").alias("begins"), F.max("ends").alias("ends"), F.sum("events").alias("events"), F.sum("cents").alias("cents"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")]
    return placed.groupBy(key, "__session").agg(*whole).drop("__session")


def session_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", key: str = "user_id", at: str = "ts", value: str = "value", kind: str = "event_type") -> DataFrame:
    """The same rows from a stream, each when the watermark has passed its end; events later than ``delay`` are dropped."""
    known = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    return known.groupBy(key, F.session_window(at, gap)).agg(*_parts(at, value, kind)).drop("session_window")
