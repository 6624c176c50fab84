"""Cohort reports over result rows: counts, rates with Wilson intervals, tests of two groups, annotation scores, samples.

Result rows hold text: booleans are True, False and N/A, lists are joined by ``|``. Unknown stays in every denominator.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import cohens_kappa_by, two_proportion_z, wilson

VERDICTS = ("phishing_verdict", "rule_phishing_verdict", "llm_phishing_assessment", "cloaking_label", "rule_cloaking_label", "llm_cloaking_assessment")


def yes(column: str) -> Column:
    return F.coalesce(F.col(column) == "True", F.lit(False))


def filled(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) != ""


@F.arrow_udf(T.DoubleType())
def _tail(z: pa.Array) -> pa.Array:
    """Two-sided tail of the normal distribution; Spark has no error function, and there is a row for each comparison only."""
    return pa.array([None if v is None else math.erfc(abs(v) / math.sqrt(2)) for v in z.to_pylist()], pa.float64())


def rates(df: DataFrame, k: str = "k", n: str = "n") -> DataFrame:
    """Adds rate, lo and hi of k of n; null rate for n = 0."""
    lo, hi = wilson(F.col(k), F.col(n))
    return df.withColumns({"rate": F.col(k) / F.nullif(F.col(n).cast("double"), F.lit(0.0)), "lo": lo, "hi": hi})


def check_versions(rows: DataFrame) -> DataFrame:
    """The rows, if there are any and all are of one known version; rows measured in different ways are not pooled."""
    seen = rows.agg(F.count_distinct("measurement_version").alias("m"), F.count_distinct("schema_version").alias("s"), F.count_if((F.coalesce("measurement_version", F.lit("")) == "") | F.col("schema_version").isNull()).alias("blank"), F.count("*").alias("n")).first()
    if seen["m"] > 1 or seen["s"] > 1 or seen["blank"] or not seen["n"]:
        raise ValueError("result rows of different or unknown versions")
    return rows


def distributions(rows: DataFrame, by: str = "source_label") -> DataFrame:
    """(cohort, field, value, n) of the six verdict columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in VERDICTS]))
    return rows.select(F.coalesce(F.col(by), F.lit("unlabeled")).alias("cohort"), pairs.alias("p")).groupBy("cohort", "p.field", "p.value").agg(F.count("*").alias("n"))


def rollup(rows: DataFrame, by: str = "source_label", then: str = "label") -> DataFrame:
    """Counts of each cohort and label, of each cohort, and of all rows, in one pass: level, both values, n, rule_true, cloaking and phishing.

    ``level`` tells a sum over all values (``cohort``, ``total``) from the group whose value is null (``label``, ``cohort``).
    """
    sets = rows.select(F.col(by).alias("cohort"), F.col(then).alias("label"), "rule_cloaking_label", "cloaking_label", "phishing_verdict").rollup("cohort", "label")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(a) for a, c, v in (("rule_true", "rule_cloaking_label", "true"), ("cloaking", "cloaking_label", "true"), ("phishing", "phishing_verdict", "phishing"))])
    return out.withColumn("level", F.when(F.col("g") == 0, "label").when(F.col("g") == 1, "cohort").otherwise("total")).select("level", "cohort", "label", "n", "rule_true", "cloaking", "phishing")


def crosstab(rows: DataFrame, a: str, b: str, by: str = "source_label") -> DataFrame:
    return rows.groupBy(F.col(by).alias("cohort"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def reason_codes(reasons: Column) -> Column:
    """Codes of the open reasons in a result row's JSON: without the observation's name, without what follows a colon."""
    codes = F.from_json(reasons, "phishing array<string>, cloaking array<string>")["cloaking"]
    code = lambda r: F.when(F.regexp_extract(r, "^([^:]*)", 1).rlike("#[12]$") & r.contains(":"), F.regexp_extract(r, "^[^:]*:(.*)$", 1)).otherwise(F.regexp_extract(r, "^([^:]*)", 1))
    return F.coalesce(F.transform(F.filter(codes, lambda r: r != ""), code), F.array().cast("array<string>"))


def top(df: DataFrame, value: str, k: int, by: str | None = None) -> DataFrame:
    """The ``k`` most frequent values (of each ``by``); ties by value."""
    n = df.groupBy(*([by] if by else []), value).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(F.desc("n"), value))
    return n.withColumn("place", place).filter(F.col("place") <= k)


def top_reasons(rows: DataFrame, k: int = 10, by: str = "source_label") -> DataFrame:
    return top(rows.select(F.col(by).alias("cohort"), F.explode(reason_codes(F.col("uncertainty_reasons"))).alias("reason")), "reason", k, "cohort")


def listed(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per entry of a ``|`` list."""
    return rows.select(*keep, F.explode(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"\|"), lambda x: x != "")).alias("entry"))


def signal_counts(rows: DataFrame, by: str = "source_label") -> DataFrame:
    return listed(rows, "cloaking_signals", by).groupBy(F.col(by).alias("cohort"), F.col("entry").alias("signal")).agg(F.count("*").alias("n"))


def group_report(rows: DataFrame, by: str) -> DataFrame:
    """Per group: rows, alive, label counts, bounds of the true share, raw fire rate, phishing, both."""
    live = yes("alive")
    count = lambda c: F.count_if(live & c)
    g = rows.groupBy(F.col(by).alias("grp")).agg(
        F.count("*").alias("n"), F.count_if(live).alias("alive"), count(F.col("cloaking") == "True").alias("t"), count(F.col("cloaking") == "False").alias("f"), count(F.col("cloaking") == "N/A").alias("na"),
        count(F.col("rule_fired_raw") == "True").alias("raw_k"), count(filled("rule_fired_raw")).alias("raw_n"), count(F.col("is_phishing") == "True").alias("phishing"), count((F.col("is_phishing") == "True") & (F.col("cloaking") == "True")).alias("both"),
    )
    known = F.nullif((F.col("t") + F.col("f") + F.col("na")).cast("double"), F.lit(0.0))
    return g.withColumns({"alive_rate": F.col("alive") / F.col("n"), "lower": F.col("t") / known, "upper": (F.col("t") + F.col("na")) / known, "conditional": F.col("t") / F.nullif((F.col("t") + F.col("f")).cast("double"), F.lit(0.0)), "raw_rate": F.col("raw_k") / F.nullif(F.col("raw_n").cast("double"), F.lit(0.0))})


def blind_spot(rows: DataFrame) -> DataFrame:
    """Of live pages that the source calls phishing: how many show no mechanism, and how many are judged phishing."""
    alive = rows.filter(yes("alive") & (F.col("label") == "phishing"))
    return alive.agg(F.count("*").alias("n"), F.count_if(~filled("human_mechanisms")).alias("blind"), F.count_if(yes("is_phishing")).alias("judged"))


def compare(groups: DataFrame, measure: str = "measure", group: str = "grp", first: str = "benign", second: str = "phishing") -> DataFrame:
    """Two groups' k of n of each measure side by side: rates, intervals, z, p and whether the second is higher; both must have rows."""
    side = lambda g, tag: rates(groups.filter(F.col(group) == g).select(measure, "k", "n")).select(measure, *[F.col(c).alias(f"{c}_{tag}") for c in ("k", "n", "rate", "lo", "hi")])
    both = side(first, "a").join(side(second, "b"), measure).filter("n_a > 0 AND n_b > 0")
    z = two_proportion_z(F.col("k_b"), F.col("n_b"), F.col("k_a"), F.col("n_a"))
    return both.withColumns({"z": z, "p": _tail(z), "higher": F.col("rate_b") > F.col("rate_a")})


def _measures(rows: DataFrame, group: Column, measures: dict[str, Column], within: Column | None = None) -> DataFrame:
    """(measure, grp, k, n) of conditions over live rows."""
    told = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(c, F.lit(False)).alias("hit")) for m, c in measures.items()]))
    live = rows.filter(yes("alive") if within is None else yes("alive") & within)
    return live.select(group.alias("grp"), told.alias("m")).groupBy("m.measure", "grp").agg(F.count_if("m.hit").alias("k"), F.count("*").alias("n"))


def channel_differential(rows: DataFrame) -> DataFrame:
    """How often the plain client's channel was blocked, got a blank page without an error, or the browser failed; by source label."""
    size = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    blank = (size("human_html_length") > 0) & (size("bot_html_length") == 0) & ~filled("bot_error")
    return compare(_measures(rows, F.col("label"), {"bot_channel_blocked": yes("bot_channel_blocked"), "bot_blank_without_error": blank, "human_failed": filled("human_error")}))


def single_end_ablation(rows: DataFrame) -> DataFrame:
    """What each client alone would have said, by source label."""
    conditions = {"bot_mechanisms": filled("bot_mechanisms"), "human_mechanisms": filled("human_mechanisms"), "bot_is_phishing": yes("bot_is_phishing"), "human_is_phishing": yes("human_is_phishing")}
    return compare(_measures(rows, F.col("label"), conditions))


def direction_skew(rows: DataFrame) -> DataFrame:
    """Per source label: mechanisms only the browser saw, only the plain client saw, and the first's share of both."""
    g = rows.filter(yes("alive")).groupBy("label").agg(F.count_if(filled("hidden_from_bot")).alias("forward"), F.count_if(filled("reverse_diff")).alias("backward"))
    return g.withColumn("skew", F.col("forward") / F.nullif((F.col("forward") + F.col("backward")).cast("double"), F.lit(0.0)))


def raw_fired(rows: DataFrame, by: str) -> DataFrame:
    """k of n rows whose rules fired before any gate; blank ones do not count."""
    return rows.filter(yes("alive") & filled("rule_fired_raw")).groupBy(F.col(by).alias("grp")).agg(F.count_if(yes("rule_fired_raw")).alias("k"), F.count("*").alias("n")).withColumn("measure", F.lit("rule_fired_raw"))


def crawl_order_report(rows: DataFrame) -> DataFrame:
    """Raw fire rates by who went first, tested against each other."""
    return compare(raw_fired(rows, "crawl_order"), first="bot_first", second="human_first")


def baseline_compare(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Raw fire rates of a batch and of one in which both sides were the same client."""
    columns = ["alive", "rule_fired_raw"]
    both = rows.select(*columns, F.lit("batch").alias("part")).unionByName(baseline.select(*columns, F.lit("baseline").alias("part")))
    return compare(raw_fired(both, "part"), first="baseline", second="batch")


def reverse_diff_report(rows: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent mechanisms that only the plain client saw."""
    return top(listed(rows.filter(yes("alive")), "reverse_diff").withColumnRenamed("entry", "mechanism"), "mechanism", k)


def fired_rules(rows: DataFrame) -> DataFrame:
    return listed(rows, "cloaking_fired").groupBy(F.col("entry").alias("rule")).agg(F.count("*").alias("n"))


def console_summary(rows: DataFrame) -> DataFrame:
    """One row of counts: responses, verdicts and labels, unknown for itself."""
    n = lambda c, v: F.count_if(F.col(c) == v).alias(f"{c}_{v}")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(yes("alive")).alias("responses"), F.count_if(F.col("alive") == "").alias("not_observed"), *[n("phishing_verdict", v) for v in ("phishing", "not_detected", "unknown")], *[n("cloaking_label", v) for v in ("true", "false", "unknown")], n("rule_cloaking_label", "true"),
    )


def scored_annotations(annotations: DataFrame, rows: DataFrame, url_hash: Column) -> DataFrame:
    """Result rows with the first annotation of their address (by ``place``)."""
    first = annotations.withColumn("__n", F.row_number().over(Window.partitionBy("url_hash").orderBy("place"))).filter("__n = 1").select("url_hash", F.col("label").alias("said"))
    own = rows.withColumn("url_hash", url_hash).dropDuplicates(["url_hash"]).select("url_hash", "cloaking", "cloaking_fired")
    return own.join(first, "url_hash")


def annotation_scores(joined: DataFrame) -> DataFrame:
    """(measure, k, n, rate, lo, hi): precision with unsure as wrong and without unsure, and negatives that were said to be positive."""
    of = lambda c, said: F.count_if((F.col("cloaking") == c) & F.col("said").isin(*said))
    every = ("yes", "no", "unsure")
    counts = joined.agg(F.array(*[F.struct(F.lit(m).alias("measure"), k.alias("k"), n.alias("n")) for m, k, n in (
        ("precision_conservative", of("True", ("yes",)), of("True", every)), ("precision_decided", of("True", ("yes",)), of("True", ("yes", "no"))), ("negatives_said_yes", of("False", ("yes",)), of("False", every)),
    )]).alias("m"))
    return rates(counts.select(F.explode("m").alias("m")).select("m.*"))


def precision_by_rule(joined: DataFrame) -> DataFrame:
    """Per fired rule of positives: how many were said to be right; a page counts once for each of its rules."""
    return rates(listed(joined.filter("cloaking = 'True'"), "cloaking_fired", "said").groupBy(F.col("entry").alias("rule")).agg(F.count_if(F.col("said") == "yes").alias("k"), F.count("*").alias("n")))


def annotator_pairs(annotations: DataFrame) -> DataFrame:
    """Kappa of every two annotators over the addresses both labelled; an annotator's last label of an address counts."""
    last = annotations.groupBy("annotator", "url_hash").agg(F.max_by("label", "place").alias("said"))
    a, b = last.toDF("a", "url_hash", "said_a"), last.toDF("b", "url_hash", "said_b")
    both = a.join(b, "url_hash").filter("a < b")
    return cohens_kappa_by(both, ["a", "b"], "said_a", "said_b")


def stratified_sample(rows: DataFrame, positives: int, negatives: int, seed: str, pairs: DataFrame | None = None) -> DataFrame:
    """``positives`` and ``negatives`` rows in an order that does not tell which is which; the same for the same seed and rows."""
    if pairs is not None:
        rows = rows.join(pairs.select("url").distinct(), "url", "left_semi")
    draw = lambda salt: F.sha1(F.concat(F.lit(f"{seed}|{salt}|"), "url"))
    picked = rows.filter(F.col("cloaking").isin("True", "False")).select("url", "cloaking").distinct()
    # each class's smallest draws, gathered from the tasks' own; no class is sorted whole
    some = [picked.filter(F.col("cloaking") == c).orderBy(draw("pick"), "url").limit(n) for c, n in (("True", positives), ("False", negatives))]
    picked = some[0].unionByName(some[1])
    return picked.withColumn("place", F.row_number().over(Window.orderBy(draw("order"), "url"))).select("place", "url", "cloaking")
