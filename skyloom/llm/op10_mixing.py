"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects target / source size copies. A prefix sum of these expectations plus one random offset
per source crosses whole numbers; a document is taken once per crossing. Documents stand in the order of (size, id, hash
of the text), so the sample is systematic in size, and no two orders give different mixes.

Texts are read once for their sizes; all else works on a narrow table of row numbers, sources and sizes. It is sorted by
range, so a source with a third of all rows lies in many partitions, each row's place in its partition comes from
``monotonically_increasing_id``, and the counts of the partitions before (one row a partition and source) make it a
rank. Expected copies are whole multiples of 2^-24, so no rounding can add a crossing. Of ``tries`` random offsets per
source the one whose taken words come nearest to the target is used. ``mixed_rows`` joins the texts of taken documents
back by row number, the only time that a text is shuffled.

Targets: sources by code point, null last, weigh ``weights`` in turn and share ``total`` times all words; a target stops
at ``most`` times its source's words and the excess goes to the others by weight. That is one level: the sources sorted by
limit over weight are full up to some place and the others share what is left. There is one row per source in that window.

Defined cases: null text has size 0; null sources form a source of their own; null ids sort first; rows that repeat are
sampled separately; very long texts count by their words like others, a source of one of them takes it whole or twice; a source without words gives no rows; empty input gives no rows; extra columns stay, and columns
named like the results, in any case, are replaced.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, aside, durable, numbered, quoted, without

NEW = ("size", "source_size", "target", "copies", "taken")
UNIT, TRIES = 1 << 24, 64


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, kept: list[str] | None) -> DataFrame:
    """The narrow table: row number, id, source (and whether it is null), size and a hash of the text."""
    text, source = F.col(quoted(text_col)), F.col(quoted(source_col))
    size = F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")
    return durable(df.select("__f", "__r", F.col(quoted(id_col)).alias("id"), F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("no"), size.alias("size"), F.xxhash64(text).alias("h")), kept)


def _targets(sizes: DataFrame, weights: tuple[int, ...], total: tuple[int, int], most: int, seed: str, tries: int) -> DataFrame:
    """Each source's size, target, expected copies in units of 2^-24 and random offsets in the same units."""
    up, down = total
    by_name = Window.orderBy("no", "s")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    each = sizes.groupBy("s", "no").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    each = each.withColumn("cap", most * F.col("source_size"))
    level = Window.orderBy(F.expr(f"cap * {prod(weights)} div w"), "no", "s")
    earlier, later, every = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    each = each.withColumns({"total": F.sum("source_size").over(every), "done": F.coalesce(F.sum("cap").over(earlier), F.lit(0)), "open": F.sum("w").over(later)})
    each = each.withColumn("full", (up * F.col("total") - down * F.col("done")) * F.col("w") >= down * F.col("cap") * F.col("open"))
    each = each.withColumns({"used": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)), "share": F.sum(F.when(~F.col("full"), F.col("w"))).over(every)})
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((up * F.col("total") - down * F.col("used")).cast("double") / F.lit(float(down)) / F.col("share") * F.col("w"))
    each = each.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0).cast("long"))
    offsets = F.array(*[F.conv(F.substring(F.md5(F.concat("s", F.lit(f"|{seed}|{t}"))), 1, 6), 16, 10).cast("long") for t in range(tries)])
    return each.select("s", "no", "source_size", "target", rate.alias("rate"), offsets.alias("offsets"))


def _crossings(offset: Column) -> Column:
    """Whole numbers that a document's step of the prefix sum crosses."""
    end = F.col("at") * F.col("rate") + offset
    return F.shiftright(end, 24) - F.shiftright(end - F.col("rate"), 24)


def _copies(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], total: tuple[int, int], most: int, seed: str, tries: int, kept: list[str] | None) -> DataFrame:
    """The narrow table with source_size, target, copies and taken."""
    sizes = _sizes(df, id_col, text_col, source_col, kept)
    order = ["no", "s", "size", "id", "h", "__f", "__r"]
    place = F.monotonically_increasing_id()
    rows = durable(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", place), kept)
    rows = rows.withColumns({"part": F.shiftright("m", 33), "i": F.col("m").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = rows.groupBy("s", "no", "part").agg(F.count("*").alias("k"), F.min("i").alias("first"))
    before = Window.partitionBy("s", "no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s", "no", "part", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    targets = _targets(sizes, weights, total, most, seed, tries)
    rows = rows.join(parts.join(targets, ["s", "no"]), ["s", "no", "part"]).withColumn("at", F.col("i") + F.col("shift"))
    mixes = rows.groupBy("s", "no").agg(F.max("target").alias("target"), *[F.sum(_crossings(F.col("offsets")[t]) * F.col("size")).alias(f"t{t}") for t in range(tries)])
    apart = F.array(*[F.struct(F.abs(F.col(f"t{t}") - F.col("target")).alias("apart"), F.lit(t).alias("t")) for t in range(tries)])
    copies = rows.join(mixes.select("s", "no", F.array_min(apart)["t"].alias("t")), ["s", "no"]).withColumn("copies", _crossings(F.col("offsets")[F.col("t")]))
    return copies.select("__f", "__r", "id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), total: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix",
    tries: int = TRIES, narrow: bool = False, kept: list[str] | None = None,
) -> DataFrame:
    """Adds size, source_size, target, copies and taken. ``total`` is a fraction (3, 2): 150 % of all words.

    ``narrow``: the id and these columns only, without a shuffle of the other columns.
    """
    rows = numbered(df, kept)
    copies = _copies(rows, id_col, text_col, source_col, weights, total, most, seed, tries, kept)
    if narrow:
        return copies.select(F.col("id").alias(id_col), *NEW)
    own = [c for c in df.columns if c.lower() not in NEW]
    return without(rows, NEW).join(copies.drop("id").hint("shuffle_hash"), ["__f", "__r"]).select(*map(quoted, own), *NEW)


def mixed_rows(df: DataFrame, kept: list[str] | None = None, **how) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken, with its own columns."""
    names = df.columns
    df, back = aside(df, [*NEW, "__copy", "__f", "__r", "id"])
    how = {k: next((new for new, old in back.items() if old == v), v) if k.endswith("_col") else v for k, v in how.items()}
    rows = numbered(df, kept)
    copies = _copies(rows, **{"id_col": "doc_id", "text_col": "text", "source_col": "source", "weights": (3, 1, 2), "total": (3, 2), "most": 2, "seed": "mix", "tries": TRIES} | how, kept=kept)
    taken = copies.filter("copies > 0").select("__f", "__r", "copies").hint("shuffle_hash")
    out = rows.join(taken, ["__f", "__r"]).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*map(quoted, df.columns)).withColumnsRenamed(back).select(*map(quoted, names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, narrow=True).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS e, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY s, e ORDER BY size, doc_id) AS i FROM d),
g AS (SELECT s, e, CAST(sum(size) AS BIGINT) AS t FROM d GROUP BY s, e),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY e, s) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS w, 2 * t AS cap FROM g),
l AS (SELECT *, CAST(sum(t) OVER () AS BIGINT) AS al, CAST(coalesce(sum(cap) OVER (ORDER BY cap * 6 // w, e, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dn,
             CAST(sum(w) OVER (ORDER BY cap * 6 // w, e, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS op FROM w),
f AS (SELECT *, (3 * al - 2 * dn) * w >= 2 * cap * op AS fu FROM l),
h AS (SELECT *, CAST(coalesce(sum(CASE WHEN fu THEN cap END) OVER (), 0) AS BIGINT) AS us, CAST(sum(CASE WHEN NOT fu THEN w END) OVER () AS BIGINT) AS sh FROM f),
k AS (SELECT s, e, t, CASE WHEN fu THEN CAST(cap AS DOUBLE) ELSE CAST(3 * al - 2 * us AS DOUBLE) / CAST(2.0 AS DOUBLE) / CAST(sh AS DOUBLE) * CAST(w AS DOUBLE) END AS target FROM h),
r AS (SELECT o.*, k.t, k.target, CASE WHEN k.t > 0 THEN CAST(floor(k.target / CAST(k.t AS DOUBLE) * CAST(16777216 AS DOUBLE)) AS BIGINT) ELSE 0 END AS ra FROM o JOIN k ON o.s = k.s AND o.e = k.e),
u AS (SELECT s, e, n, CAST(CAST('0x' || substr(md5(s || '|mix|' || n), 1, 6) AS UBIGINT) AS BIGINT) AS u FROM k CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS n)),
tr AS (SELECT r.s, r.e, u.n, u.u, abs(sum((((i * ra + u) >> 24) - (((i - 1) * ra + u) >> 24)) * size) - max(target)) AS apart FROM r JOIN u ON u.s = r.s AND u.e = r.e GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, e ORDER BY apart, n) AS q FROM tr) WHERE q = 1)
SELECT doc_id, size, t AS source_size, target, CAST(((i * ra + u) >> 24) - (((i - 1) * ra + u) >> 24) AS BIGINT) * size AS taken FROM r JOIN b ON b.s = r.s AND b.e = r.e
"""
