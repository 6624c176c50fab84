"""Result rows and annotations of the fixture tables: one row per page whose values follow from its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import cloaking_projection, phishing_projection
from ..functions.urls import human_first, url_hash

REASONS = (
    '{"phishing":[],"cloaking":[]}', '{"phishing":["blank_visible_text"],"cloaking":["human#1:challenge_or_block_page","difference_not_replicated"]}', '{"phishing":[],"cloaking":["frontend_cloaking_code_present:S1,S2","bot#2:http_error_status"]}', "",
)


def _pick(n: int, values, by: Column | None = None) -> Column:
    """Values by ``page_id % n``; the last one for the rest."""
    at = F.col("page_id") % n if by is None else by % n
    out = F.when(at == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(at == i, v)
    return out.otherwise(values[-1])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    label, verdict = _pick(3, ("true", "false", "unknown"), F.floor(F.col("page_id") / 3)), _pick(5, ("phishing", "phishing", "not_detected", "not_detected", "unknown"))
    return p.withColumns({
        "label": _pick(2, ("benign", "phishing")), "source_label": F.concat(F.lit("feed"), (F.col("page_id") % 3).cast("string")), "alive": F.when(F.col("page_id") % 10 == 9, "").when(F.col("page_id") % 10 == 8, "False").otherwise("True"), "cloaking_label": label,
        "cloaking": cloaking_projection(label), "rule_cloaking_label": _pick(4, ("true", "true", "false", "unknown")), "phishing_verdict": verdict, "is_phishing": phishing_projection(verdict), "rule_phishing_verdict": _pick(5, ("phishing", "phishing", "not_detected", "not_detected", "not_run")),
        "llm_phishing_assessment": _pick(7, ("not_run", "unavailable", "unavailable", "phishing")), "llm_cloaking_assessment": _pick(7, ("not_run", "unavailable", "unavailable", "supports_cloaking")), "rule_fired_raw": _pick(4, ("True", "True", "False", "")),
        "human_mechanisms": _pick(6, ("", "cred_form", "cred_form|webhook_exfiltration")), "bot_mechanisms": _pick(3, ("cred_form", "")), "hidden_from_bot": _pick(4, ("webhook_exfiltration", "")), "reverse_diff": _pick(9, ("cred_form|anti_analysis", "anti_analysis", "")),
        "bot_channel_blocked": _pick(8, ("True", "False")), "bot_html_length": _pick(11, ("0", "100")), "human_html_length": F.lit("200"), "bot_error": _pick(22, ("reset", "")), "human_error": _pick(13, ("timeout", "")), "bot_is_phishing": _pick(6, ("True", "True", "False")),
        "human_is_phishing": _pick(6, ("True", "True", "True", "False")), "cloaking_fired": _pick(4, ("C1|C5", "C2", "")), "cloaking_signals": _pick(3, ("blank_page|error_page", "error_page", "")), "crawl_order": F.when(human_first(F.col("url")), "human_first").otherwise("bot_first"),
        "uncertainty_reasons": _pick(4, REASONS), "schema_version": F.lit("s1"), "measurement_version": F.lit("m1"),
    })


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators; each labels some pages, one of them some pages twice."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url_hash(F.concat("url", F.lit("#"), F.col("page_id").cast("string"))).alias("url_hash"))
    who = F.explode(F.array(*[F.struct(F.lit(a).alias("annotator"), F.lit(i).alias("turn")) for i, a in enumerate(("ann", "bob", "bob"))]))
    rows = p.withColumn("w", who).select("page_id", "url_hash", "w.annotator", "w.turn")
    rows = rows.filter(F.when(F.col("turn") == 0, F.col("page_id") % 3 != 0).when(F.col("turn") == 1, F.col("page_id") % 4 != 0).otherwise(F.col("page_id") % 8 == 1))
    return rows.select("url_hash", "annotator", _pick(3, ("yes", "no", "unsure"), F.floor(F.col("page_id") / 5) + F.col("turn") * (F.col("page_id") % 2)).alias("label"), (F.col("page_id") * 3 + F.col("turn")).alias("place"))
