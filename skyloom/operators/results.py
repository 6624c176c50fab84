"""Flat result rows of judged pages, and the narrower views that sinks write: summary, audit, blind pair, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..plans.observations import describe_plan
from . import verdicts as V
from .pairs import fact

#: Names and order of the columns that readers of earlier results know; new ones are only ever appended.
LEGACY = ("url", "alive", "is_phishing", "cloaking")
DIAGNOSTIC = (
    "phishing_confidence", "phishing_indicators", "cloaking_fired", "cloaking_tier", "dynamic_reliability", "human_mechanisms", "human_high_spec", "content_similarity", "bot_channel_blocked", "bot_status_code", "human_status_code", "bot_html_length",
    "human_html_length", "bot_error", "human_error", "bot_mechanisms", "hidden_from_bot", "bot_is_phishing", "human_is_phishing", "reverse_diff", "rule_fired_raw", "crawl_order", "pair_mode",
)
AUDIT = (
    "schema_version", "measurement_version", "run_id", "batch_id", "source_label", "phishing_verdict", "cloaking_label", "evidence", "reason", "source", "observed_at", "profile_id", "source_fetched_at", "raw_url", "normalized_url", "rule_phishing_verdict",
    "llm_phishing_assessment", "rule_cloaking_label", "llm_cloaking_assessment", "phishing_basis", "cloaking_basis", "uncertainty_reasons", "evidence_sources", "cloaking_signals", "cloaking_signals_not_tested", "observation_plan", "run_config_sha256", "llm_model",
    "prompt_version",
)
SUMMARY = LEGACY + AUDIT
BATCH = ("url", "label", "alive", "is_phishing", "cloaking", *DIAGNOSTIC, "error_count", "analyzed_at", *AUDIT, "status")
VERSIONS = ("skyloom-1", "two-client-1")
#: What an annotator may see of a pair: where it was fetched, no verdict and no label.
BLIND = ("url", "bot_status", "human_status", "fetch_time", "crawl_order", "pair_mode")


def _truth(value: Column) -> Column:
    """Booleans as the text that result files hold; null as an empty text."""
    return F.when(value, "True").when(~value, "False").otherwise("")


def _bar(names: Column) -> Column:
    return F.array_join(names, "|")


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"})


def result_rows(judged: DataFrame, url: str = "asked", run: dict[str, str] | None = None) -> DataFrame:
    """One flat row of text columns per judged page; success and failure rows have the same columns.

    ``judged`` may carry source columns (label, source_label, source, batch_id, fetched_at), model assessments and
    ``content_similarity``; what it does not carry has its default.
    """
    run = {"run_id": "", "run_config_sha256": "", "llm_model": "disabled", "prompt_version": "", "pair_mode": "bot_human", "analyzed_at": ""} | (run or {})
    have = set(judged.columns)
    own = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in have else F.lit(default)
    rows = V.legacy_columns(judged)
    s4 = V.model_only_rule(own("llm_cloaking_assessment", "not_run") == "supports_cloaking", F.col("techniques"), F.col("static_rules"))
    address, unknown = F.col(url), F.col("label") == "unknown"
    phishing_open = F.array_sort(F.array_distinct(F.array_union(F.when(F.col("verdict") == "unknown", F.filter(F.split("verdict_reason", ";"), lambda r: r != "")).otherwise(F.array().cast("array<string>")), F.col("verdict_caveats"))))
    names = F.array_compact(F.array(*[F.when(fact(n, "there"), F.lit(n)) for n in ("bot#1", "bot#2", "human#1", "human#2")]))
    columns = {
        "url": address, "label": own("source_class", ""), "alive": _truth(V.alive(rows)), "is_phishing": R.phishing_projection(F.col("verdict")), "cloaking": R.cloaking_projection(F.col("label")), "phishing_confidence": F.format_string("%.3f", F.col("confidence")),
        "phishing_indicators": _bar(V.indicators(F.col("page.facts.hits"))), "cloaking_fired": _bar(F.col("fired")), "cloaking_tier": V.tier(F.col("label"), F.col("rule_label"), F.col("static_rules"), s4), "dynamic_reliability": F.col("dynamic_reliability"),
        "human_mechanisms": _bar(F.col("human_mechanisms")), "human_high_spec": _bar(F.col("human_high_spec")), "content_similarity": own("content_similarity", ""), "bot_channel_blocked": _truth(F.col("channel_blocked")),
        **{c: F.col(c).cast("string") for c in ("bot_status_code", "human_status_code", "bot_html_length", "human_html_length", "bot_error", "human_error")}, "bot_mechanisms": _bar(F.col("bot_mechanisms")), "hidden_from_bot": _bar(F.col("hidden")),
        "bot_is_phishing": _truth(F.col("bot_is_phishing")), "human_is_phishing": _truth(F.col("human_is_phishing")), "reverse_diff": _bar(F.col("reverse")), "rule_fired_raw": _truth(F.col("rule_fired_raw")),
        "crawl_order": F.regexp_extract(describe_plan(address), "^([^:]*)", 1), "pair_mode": F.lit(run["pair_mode"]), "error_count": sum((F.when(fact(n, "error") != "", 1).otherwise(0) for n in ("bot#1", "bot#2", "human#1")), F.when(fact("human#2", "error") != "", 1).otherwise(0)).cast("string"),
        "analyzed_at": F.lit(run["analyzed_at"]), "schema_version": F.lit(VERSIONS[0]), "measurement_version": F.lit(VERSIONS[1]), "run_id": F.lit(run["run_id"]), "batch_id": own("batch_id", ""), "source_label": own("source_label", "unlabeled"), "phishing_verdict": F.col("verdict"),
        "cloaking_label": F.col("label"), "evidence": _json(rules=F.col("evidence")), "reason": _json(phishing=F.col("verdict_reason"), cloaking=F.col("reason")), "source": own("source", "manual_input"), "observed_at": F.lit(""), "profile_id": _json(bot=fact("bot#1", "kind"), human=fact("human#1", "kind")),
        "source_fetched_at": own("fetched_at", ""), "raw_url": own("raw_url", None) if "raw_url" in have else address, "normalized_url": own("normalized_url", None) if "normalized_url" in have else address, "rule_phishing_verdict": F.col("rule_verdict"),
        "llm_phishing_assessment": own("llm_phishing_assessment", "not_run"), "rule_cloaking_label": F.col("rule_label"), "llm_cloaking_assessment": own("llm_cloaking_assessment", "not_run"), "phishing_basis": F.col("verdict_basis"), "cloaking_basis": F.col("basis"),
        "uncertainty_reasons": _json(phishing=phishing_open, cloaking=F.when(unknown, F.col("reasons")).otherwise(F.array().cast("array<string>"))), "evidence_sources": _json(phishing=F.concat("page.name", F.when(F.col("page.name") != "", ":").otherwise(""), "page.view"), cloaking=names),
        "cloaking_signals": _bar(F.col("observed")), "cloaking_signals_not_tested": _bar(F.col("not_tested")), "observation_plan": describe_plan(address), "run_config_sha256": F.lit(run["run_config_sha256"]), "llm_model": F.lit(run["llm_model"]), "prompt_version": F.lit(run["prompt_version"]),
        "status": F.when(V.alive(rows), "response").otherwise("no_response"),
    }
    return rows.select(*[columns[c].alias(c) for c in BATCH])


def failure_rows(urls: DataFrame, error: str, url: str = "url") -> DataFrame:
    """Result rows of addresses that could not be observed: the columns of success rows, all verdicts unknown."""
    known = {
        "alive": "", "is_phishing": "N/A", "cloaking": "N/A", "phishing_verdict": "unknown", "cloaking_label": "unknown", "rule_phishing_verdict": "not_run", "rule_cloaking_label": "unknown", "llm_phishing_assessment": "not_run", "llm_cloaking_assessment": "not_run",
        "schema_version": VERSIONS[0], "measurement_version": VERSIONS[1], "source_label": "unlabeled", "source": "manual_input", "error_count": "1", "status": error,
    }
    same = ("url", "raw_url", "normalized_url")
    return urls.select(*[(F.col(url) if c in same else F.lit(known.get(c, ""))).alias(c) for c in BATCH])


def summary(results: DataFrame) -> DataFrame:
    return results.select(*SUMMARY)


def split_by_liveness(urls: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Addresses to observe, and failure rows of those that ``reason`` rejects, which pass all analysis by."""
    marked = urls.withColumn("__reason", reason)
    bad = marked.filter("__reason IS NOT NULL")
    return marked.filter("__reason IS NULL").drop("__reason"), failure_rows(bad, "invalid_url").withColumn("alive", F.lit("False"))


def report_text() -> Column:
    """A page's result in ten lines."""
    c = lambda name: F.when(F.col(name) == "", "-").otherwise(F.col(name))
    lines = [
        ("url", c("url")), ("response", c("alive")), ("source label", c("source_label")), ("phishing", F.concat(c("phishing_verdict"), F.lit(" (rule "), c("rule_phishing_verdict"), F.lit("; "), c("phishing_basis"), F.lit(")"))),
        ("cloaking", F.concat(c("cloaking_label"), F.lit(" (rule "), c("rule_cloaking_label"), F.lit("; "), c("cloaking_basis"), F.lit(")"))), ("model", F.concat(c("llm_phishing_assessment"), F.lit(" / "), c("llm_cloaking_assessment"))), ("open", c("uncertainty_reasons")),
        ("signals", F.concat(c("cloaking_signals"), F.lit(" (not tested: "), c("cloaking_signals_not_tested"), F.lit(")"))), ("plan", c("observation_plan")), ("sources", c("evidence_sources")),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in lines])


def audit_view(obs: DataFrame, text: Column | None = None, dom_text: Column | None = None) -> DataFrame:
    """Observations without their bodies: excerpts of 500 characters and hashes instead."""
    text = R.visible_text(F.col("html")) if text is None else text
    dom_text = R.visible_text(F.col("dom_html")) if dom_text is None else dom_text
    excerpts = {"text_excerpt": F.substring(text, 1, 500), "dom_text_excerpt": F.when(F.col("dom_html").isNotNull(), F.substring(dom_text, 1, 500)), "html_sha256": F.sha2(F.coalesce("html", F.lit("")), 256), "html_length": F.length(F.coalesce("html", F.lit("")))}
    return obs.withColumns(excerpts).drop("html", "dom_html", "early_html")


def script_view(scripts: DataFrame, code: str = "script", plain: str = "deobfuscated", most: int = 20_000) -> DataFrame:
    """Scripts as hashes and lengths, with an excerpt of the plain text."""
    out = {f"{c}_{kind}": value for c in (code, plain) for kind, value in (("sha256", F.sha2(F.coalesce(c, F.lit("")), 256)), ("length", F.length(F.coalesce(c, F.lit("")))))}
    return scripts.withColumns(out | {f"{plain}_excerpt": F.substring(F.coalesce(plain, F.lit("")), 1, most)}).drop(code, plain)


def blind_pairs(judged: DataFrame, url: str = "asked", pair_mode: str = "bot_human") -> DataFrame:
    """What annotators get of each pair, and nothing that tells a verdict or a label."""
    return judged.select(
        F.col(url).alias("url"), fact("bot#1", "status").alias("bot_status"), fact("human#1", "status").alias("human_status"), F.struct(F.lit(0.0).alias("bot"), F.lit(0.0).alias("human")).alias("fetch_time"),
        F.regexp_extract(describe_plan(F.col(url)), "^([^:]*)", 1).alias("crawl_order"), F.lit(pair_mode).alias("pair_mode"),
    )
