"""Statistics as columns and small tables: prevalence bounds, Wilson intervals, two-proportion tests, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of k of n; (0, 0) for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p, d = k / F.nullif(n, F.lit(0.0)), 1 + z * z / F.nullif(n, F.lit(0.0))
    mid, half = (p + z * z / (2 * F.nullif(n, F.lit(0.0)))) / d, z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + z * z / (4 * F.nullif(n, F.lit(0.0)) * F.nullif(n, F.lit(0.0)))) / d
    return F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(0.0))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled z; null where a group is empty, 0 where nothing varies."""
    p = (k1 + k2) / F.nullif((n1 + n2).cast("double"), F.lit(0.0))
    se = F.sqrt(p * (1 - p) * (1 / F.nullif(n1.cast("double"), F.lit(0.0)) + 1 / F.nullif(n2.cast("double"), F.lit(0.0))))
    return F.when(se == 0, 0.0).otherwise((k1 / F.nullif(n1.cast("double"), F.lit(0.0)) - k2 / F.nullif(n2.cast("double"), F.lit(0.0))) / F.nullif(se, F.lit(0.0)))


def prevalence(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Counts of true, false and unknown per cohort, bounds of the true share, and the Wilson interval of the lower one."""
    t = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(label) == "true").alias("t"), F.count_if(F.col(label) == "false").alias("f"), F.count_if(F.col(label) == "unknown").alias("na"))
    lo, hi = wilson(F.col("t"), F.col("n"))
    return t.select("*", (F.col("t") / F.col("n")).alias("lower"), ((F.col("t") + F.col("na")) / F.col("n")).alias("upper"), (F.col("t") / F.nullif(F.col("t") + F.col("f"), F.lit(0))).alias("conditional"), lo.alias("ci_lo"), hi.alias("ci_hi"))


def cohens_kappa_by(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, po, pe, kappa) of two label columns; pairs with a null are left out, full expected agreement is 1."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cell = both.groupBy(*by, F.col(a).alias("a_"), F.col(b).alias("b_")).count()
    total = cell.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a_") == F.col("b_"), F.col("count")).otherwise(0)).alias("same"))
    left, right = cell.groupBy(*by, F.col("a_").alias("v")).agg(F.sum("count").alias("ka")), cell.groupBy(*by, F.col("b_").alias("v")).agg(F.sum("count").alias("kb"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("ka") * F.col("kb")).alias("x"))
    out = total.join(chance, by, "left") if by else total.crossJoin(chance)  # without groups one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("x", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*by, "n", po.alias("po"), pe.alias("pe"), F.when(pe == 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    return cohens_kappa_by(df, [], a, b)
