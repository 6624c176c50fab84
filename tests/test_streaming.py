"""Streams against the batch operators: assembly of pages, sessions, first sightings."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyloom.operators import pairs as P
from skyloom.plans import observations as O
from skyloom.streaming import assembly, sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def _put(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_assembly_equals_batch(rocks, tmp_path):
    spark, box, ck, out = rocks, f"{tmp_path}/in", f"{tmp_path}/ck", f"{tmp_path}/out"
    base = datetime(2024, 1, 1)
    obs = O.observations(spark, SF).filter("page_id < 6").withColumn("arrived_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60 + F.col("access_index") * 10))
    obs = obs.withColumn("variant", F.lit(None).cast("string"))
    gone = obs.filter("NOT (page_id = 4 AND slot = 'human' AND replicate = 2)")  # never arrives
    every = gone.cache()
    again = every.filter("page_id = 2 AND slot = 'bot'").withColumn("access_index", F.col("access_index") + 7).withColumn("html", F.lit("<p>second answer</p>"))  # a repeat that must not count
    parts = [every.filter("access_index >= 3 AND page_id <> 5"), every.filter("access_index = 2 AND page_id <> 5").unionByName(again), every.filter("access_index = 1 AND page_id <> 5").unionByName(every.filter("page_id = 3 AND access_index = 3"))]
    end = every.limit(1).withColumn("page_id", F.lit(-1).cast("long"))
    late = lambda minutes: end.withColumn("arrived_at", F.lit(base + timedelta(minutes=minutes)))
    parts += [every.filter("page_id = 5").unionByName(late(200)), late(400)]
    schema, wanted = parts[0].schema, P.pair_table(P.seen(every.unionByName(again)))

    def run():  # a new query each time: it goes on from the checkpoint
        rows = assembly.assemble(spark.readStream.schema(schema).parquet(box), wait=timedelta(minutes=100), delay="90 minutes")
        assembly.write_closed(rows, out, ck, P.pair_table).trigger(availableNow=True).start().awaitTermination()

    for part in parts:
        _put(part.select(*schema.names), box)
        run()
    got = spark.read.parquet(out).filter("page_id >= 0").drop("batch")
    bare = lambda df: sorted(r.asDict(recursive=True).__repr__() for r in df.select(*sorted(wanted.columns)).collect())
    assert got.count() == 6 and bare(got) == bare(wanted)
    lost = got.filter("page_id = 4").select("human2_issues", "human2_there").first()
    assert lost["human2_issues"] == ["missing_observation"] and not lost["human2_there"]
    assert "second answer" not in "".join(r["bot1_html_excerpt"] for r in got.select("bot1_html_excerpt").collect())


def _brute(rows, gap):
    out, last = [], {}
    for user, t, v, k in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1])):
        if user in last and t - last[user]["ends"] <= gap:
            s = last[user]
        else:
            s = last[user] = {"begins": t, "ends": t, "events": 0, "cents": 0, "kinds": set()}
            out.append((user, s))
        s["ends"] = t
        s["events"] += 1
        s["cents"] += round(100 * (v or 0))
        s["kinds"] |= {k} - {None}
    return sorted((u, s["begins"], s["ends"], s["events"], s["cents"], tuple(sorted(s["kinds"]))) for u, s in out)


def _rows():
    r, start = random.Random(5), datetime(2024, 3, 1, 23, 0)
    rows = [(r.randint(1, 4), start + timedelta(minutes=r.choice((1, 7, 30, 31, 60)) * r.randint(0, 90)), r.choice((None, 1.25, 2.5)), r.choice(("view", "click", None))) for _ in range(400)]
    return rows + [(None, start, 1.0, "view"), (1, None, 1.0, "view"), (9, start, 1.0, "view"), (9, start + timedelta(minutes=30), 1.0, "click"), (9, start + timedelta(minutes=61), 1.0, "view")]


SCHEMA = "user_id long, ts timestamp, value double, event_type string"


@pytest.mark.parametrize("step", ["1 hour", "1 day"])
def test_sessions(spark, step):
    rows = _rows()
    got = sessions.sessions(spark.createDataFrame(rows, SCHEMA), step=step)
    assert sorted((*tuple(r)[:5], tuple(r["kinds"])) for r in got.collect()) == _brute(rows, timedelta(minutes=30))
    assert sessions.sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_session_stream_equals_batch(spark, tmp_path):
    rows = sorted(_rows(), key=lambda r: (r[1] or datetime(2024, 3, 1)))
    box, out = f"{tmp_path}/in", f"{tmp_path}/out"
    cuts = [0, 150, 300, len(rows)]
    for a, b in zip(cuts, [*cuts[1:], None], strict=True):
        part = rows[a:b] if b else [(7, datetime(2025, 1, 1), 0.0, "end")]
        _put(spark.createDataFrame(part, SCHEMA), box)
        stream = sessions.session_stream(spark.readStream.schema(SCHEMA).parquet(box), delay="1 hour")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((*tuple(r)[:5], tuple(r["kinds"])) for r in got.collect()) == _brute(rows, timedelta(minutes=30))
