"""Observations put together by page as they arrive: an addition to the batch operators, with the same rows as result.

A stream of observations has them in any order, some twice, some late, some never. Each view of an observation is reduced to
page facts before anything is kept, so the state of a page is a few narrow rows and never its text. A page is closed when
event time has passed its first observation by ``wait``; until then rows only add to its state, so the result does not
depend on order or repetition. What the watermark has left behind by then is dropped, as in any event-time operator, and
an observation more than ``wait`` after its page's first opens the page anew.

The state needs Spark's RocksDB provider (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.pages import facts
from ..operators.pairs import VIEWS, name_of, view_rows, with_issues

_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Pages(StatefulProcessor):
    """State of a page: of each name and view the row with the smallest place; one timer."""

    def __init__(self, key: str, wait_ms: int):
        self.key, self.wait_ms = key, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "name string, view string", "place long, seen_us long, payload string")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        due = self.due.get()[0] if self.due.exists() else None
        soonest = due
        for r in rows:
            at, own = (r["name"], r["view"]), (r["place"], r["seen_us"], r["payload"])
            if not self.rows.containsKey(at) or own < tuple(self.rows.getValue(at)):
                self.rows.updateValue(at, own)
            ends = r["arrived_ms"] + self.wait_ms
            soonest = ends if soonest is None else min(soonest, ends)
        if soonest != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(soonest)
            self.due.update((soonest,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held: dict[str, dict] = {}
        for at, value in self.rows.iterator():
            held.setdefault(at[0], {})[at[1]] = tuple(value)
        self.rows.clear()
        self.due.clear()
        for name in sorted(held):
            first = min(v[:2] for v in held[name].values())  # views of an observation that another one replaced stay out
            views = {view: v[2] for view, v in held[name].items() if v[:2] == first}
            yield Row(**{self.key: key[0], "name": name, **{view: views.get(view) for view in VIEWS}})

    def close(self) -> None:
        pass


def assemble(stream: DataFrame, key: str = "page_id", at: str = "arrived_at", wait: timedelta = timedelta(minutes=10), delay: str = "1 minute") -> DataFrame:
    """Rows like those of ``pairs.seen``, all of a page at once when it is closed, so that ``pair_table`` may be applied to a batch.

    ``at``: when an observation arrived; null falls behind every watermark. ``wait``: how long a page stays open.
    """
    wait_ms = wait // timedelta(milliseconds=1)
    views = facts(view_rows(stream.withWatermark(at, delay)), "body", "address").withColumn("name", name_of("o.variant", "o.slot", "o.replicate"))
    order = [F.coalesce("o.access_index", F.lit(0)).cast("long").alias("place"), F.coalesce(F.unix_micros("o.observed_at"), F.lit(0)).alias("seen_us")]
    payload = F.struct("o", "facts")
    kind = views.select(payload.alias("p")).schema["p"].dataType
    rows = views.select(F.col(f"o.{key}").alias(key), F.col(f"o.{at}").alias(at), "name", "view", *order, F.unix_millis(f"o.{at}").alias("arrived_ms"), F.to_json(payload, _TIMES).alias("payload"))
    closed = f"{key} {rows.schema[key].dataType.simpleString()}, name string, " + ", ".join(f"{v} string" for v in VIEWS)
    whole = rows.groupBy(key).transformWithState(Pages(key, wait_ms), closed, "append", "eventTime")
    parsed = whole.select(*[F.from_json(v, kind, _TIMES).alias(v) for v in VIEWS])
    return with_issues(parsed.select("html.o.*", *[F.col(f"{v}.facts").alias(v) for v in VIEWS]))


def write_closed(rows: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """``work`` on the pages that each micro-batch closed, written below ``path`` by batch: one that is run again after a failure replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
