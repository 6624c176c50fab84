"""Exact dedup in DataFrame functions only: 128-bit content hashes, bytes compared inside groups.

The texts are read once for a narrow table of row number, id and SHA-256. Its first 128 bits are the group's hash; one
aggregation, combined on the map side, gives each hash its size and the row that stays. Then the bytes of texts whose
hash repeats are compared: they are grouped by (hash, text), again combined on the map side, so a group of copies sends
one text per task however large it is, and a hash with more than one text is a collision. Texts that cannot repeat are
filtered out before that shuffle by ``PREFIX`` bits of the repeated hashes, a broadcast of at most 2^PREFIX numbers. Rows of
colliding hashes are grouped anew by the text itself.

Rows meet their group's result by hash. Groups that hold at least a thousandth of all rows, of which there are at most a
thousand, are broadcast; no other group can fill a partition.

Defined cases: null text is empty; empty texts are equal to each other; of rows with the same largest (or smallest) id the
one last (first) in file order stays, so exactly one row of each text does; null ids lose against all others; very long texts are
aggregation keys like others, Spark spills them; other columns are dropped by ``exact_groups``; ``exact_dedup`` keeps all columns,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, durable, forget, numbered, quoted

PREFIX, HOT = 20, 1000


def _slot(h: str) -> Column:
    return F.xxhash64(h).bitwiseAND(F.lit((1 << PREFIX) - 1))


def _chosen(largest: bool) -> Column:
    """The row that stays: largest or smallest id, null ids last, then file order."""
    row = lambda known: F.struct(known.alias("known"), "id", "f", "r")
    return F.max(row(F.col("id").isNotNull())) if largest else F.min(row(F.col("id").isNull()))


def _groups(df: DataFrame, id_col: str, text_col: str, largest: bool, same: Callable[[Column], Column] | None, bits: int) -> DataFrame:
    """(f, r, id, sha, n, best) of each row; ``best`` is the row of its group that stays."""
    spark, made = df.sparkSession, []
    text = F.coalesce(same(F.col("t")) if same else F.col("t"), F.lit(""))
    texts = df.select(F.col("__f").alias("f"), F.col("__r").alias("r"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"))
    texts = texts.withColumn("t", text).withColumn("sha", F.unhex(F.sha2("t", 256))).withColumn("h", F.substring("sha", 1, bits // 8))
    rows = durable(texts.select("f", "r", "id", "sha", "h"))
    total = rows.count()
    repeated = durable(rows.groupBy("h").agg(F.count("*").alias("n"), _chosen(largest).alias("best")).filter("n > 1"), made)
    slots = F.broadcast(repeated.select(_slot("h").alias("slot")).distinct())
    apart = texts.join(slots, _slot("h") == F.col("slot"), "left_semi").groupBy("h", "t").agg(F.count("*").alias("n"))
    split = durable(apart.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"), made)
    fields = ["f", "r", "id", "sha", "n", "best"]
    own = F.struct(F.lit(True).alias("known"), "id", "f", "r").cast(repeated.schema["best"].dataType)
    collided = None
    if not split.isEmpty():
        slots = F.broadcast(split.select(_slot("h").alias("slot")).distinct())
        odd = texts.join(slots, _slot("h") == F.col("slot"), "left_semi").join(split, "h", "left_semi").drop("h")
        each = odd.groupBy("t").agg(F.count("*").alias("n"), _chosen(largest).alias("best"))
        collided = durable(odd.join(each, "t").select(*fields))
        rows, repeated = rows.join(split, "h", "left_anti"), repeated.join(split, "h", "left_anti")
    large = F.col("n") * HOT >= total
    hot = F.broadcast(repeated.filter(large))
    cold = repeated.filter(~large)
    few = rows.join(hot, "h").select(*fields)
    rest = rows.join(hot, "h", "left_anti").join(cold, "h", "left").withColumns({"n": F.coalesce("n", F.lit(1)), "best": F.coalesce("best", own)}).select(*fields)
    out = durable(few.unionByName(rest) if collided is None else few.unionByName(rest).unionByName(collided))
    forget(spark, made)
    return out


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", same: Callable[[Column], Column] | None = None, bits: int = 128) -> DataFrame:
    """One row per row of ``df``: its id, keep_id, group_size, kept and text_sha256.

    ``keep``: "smallest" or "largest" id stays. ``same``: a column function; texts are equal if it makes them identical.
    ``bits``: of the content hash, a multiple of 8; fewer only make more work for the comparison of bytes.
    """
    if keep not in ("smallest", "largest") or bits % 8 or not 8 <= bits <= 256:
        raise ValueError("keep is smallest or largest; bits is a multiple of 8 from 8 to 256")
    rows = _groups(numbered(df.select(quoted(id_col), quoted(text_col))), id_col, text_col, keep == "largest", same, bits)
    kept = (F.col("best.f") == F.col("f")) & (F.col("best.r") == F.col("r"))
    return rows.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", same: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``df`` that stay, one for each text, with their own columns."""
    names = df.columns
    df, back = aside(df, ["__f", "__r"])
    ids = {old: new for new, old in back.items()}
    rows = numbered(df)
    found = _groups(rows, ids.get(id_col, id_col), ids.get(text_col, text_col), keep == "largest", same, 128)
    gone = found.filter((F.col("best.f") != F.col("f")) | (F.col("best.r") != F.col("r"))).select(F.col("f").alias("__f"), F.col("r").alias("__r"))
    return rows.join(gone, ["__f", "__r"], "left_anti").drop("__f", "__r").withColumnsRenamed(back).select(*map(quoted, names))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep="largest")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
