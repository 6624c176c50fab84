"""Verdict layers: the page that is judged, its rule result with obfuscated scripts, and the verdict that observation gates leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions import records as R
from .pairs import fact, nothing

#: Order in which observations are tried for the judged page.
ORDER = ("human#1", "human#2", "bot#1", "bot#2")


def choose_page(pairs: DataFrame) -> DataFrame:
    """Adds ``page``: name, view, url, facts and issues of the first observation that nothing blocks.

    The view is the page after its scripts ran where there is one; without it the issues say so. If all are blocked, name
    and view are empty, the facts null and the issues those of the first observation there is.
    """
    options, issues = [], []
    for n in ORDER:
        dom = fact(n, "length", "dom") > 0
        found = F.when(dom, fact(n, "dom_issues")).otherwise(fact(n, "issues"))
        clear = fact(n, "there") & (F.size(R.among(found, C.BLOCKING)) == 0)
        listed = F.when(dom, found).otherwise(F.array_sort(F.array_union(found, F.array(F.lit("analysis_without_js_execution")))))
        url = F.when(dom & (fact(n, "page_url") != ""), fact(n, "page_url")).otherwise(fact(n, "url"))
        facts = F.when(dom, F.col(f"`{n}`.dom")).otherwise(F.col(f"`{n}`.html"))
        options.append(F.when(clear, F.struct(F.lit(n).alias("name"), F.when(dom, "dom").otherwise("html").alias("view"), url.alias("url"), facts.alias("facts"), listed.alias("issues"))))
        issues.append(F.when(fact(n, "there"), found))
    none = F.struct(F.lit("").alias("name"), F.lit("").alias("view"), F.lit("").alias("url"), F.when(F.lit(False), F.col("`human#1`.html")).alias("facts"), F.coalesce(*issues, F.array(F.lit("missing_observation"))).alias("issues"))
    return pairs.withColumn("page", F.coalesce(*options, none))


def rule_result(score: Column, decisive: Column, obfuscated: Column) -> dict[str, Column]:
    """The page rules' score raised by highly obfuscated scripts, whether it is positive, and why."""
    raised = F.when(obfuscated > 0, F.least(F.lit(C.CAP), score + F.least(F.lit(0.15), obfuscated * F.lit(0.05)))).otherwise(score)
    positive = (F.size(decisive) > 0) | (raised >= C.THRESHOLD)
    told = F.concat(F.lit("layer2_score="), F.format_string("%.3f", raised), F.when(positive, ">=").otherwise("<"), F.lit(str(C.THRESHOLD)))
    return {"score": raised, "positive": positive, "basis": F.when(F.size(decisive) > 0, F.concat(F.lit("layer1:"), F.array_join(decisive, ","))).otherwise(told)}


def classify(df: DataFrame, obfuscated: Column | None = None) -> DataFrame:
    """Adds rule_verdict, verdict, verdict_reason, verdict_basis, verdict_caveats and confidence of ``page``.

    A positive stands whatever the caveats; a negative with a caveat is unknown; without a readable page nothing was run.
    """
    facts, issues = F.col("page.facts"), F.col("page.issues")
    decisive = F.coalesce(facts["decisive"], nothing())
    rule = rule_result(F.coalesce(facts["score"], F.lit(0.0)), decisive, F.lit(0) if obfuscated is None else F.coalesce(obfuscated, F.lit(0)))
    blocked, caveats = R.among(issues, C.BLOCKING), R.among(issues, C.CAVEATS)
    unread = (F.coalesce(facts["length"], F.lit(0)) == 0) | (F.size(blocked) > 0)
    verdict = F.when(unread, "unknown").when(rule["positive"], "phishing").when(F.size(caveats) > 0, "unknown").otherwise("not_detected")
    reason = F.when(unread, F.when(F.size(blocked) > 0, F.array_join(blocked, ";")).otherwise("unreadable_content")).when(rule["positive"], "rules_positive").when(F.size(caveats) > 0, F.array_join(caveats, ";")).otherwise("no_rule_threshold_met")
    return df.withColumns({
        "rule_verdict": F.when(unread, "not_run").when(rule["positive"], "phishing").otherwise("not_detected"), "verdict": verdict, "verdict_reason": reason, "verdict_basis": F.when(unread, "no_readable_document").otherwise(rule["basis"]),
        "verdict_caveats": caveats, "confidence": F.round(F.when(unread, 0.0).when(F.size(decisive) > 0, C.DECISIVE_CONFIDENCE).otherwise(rule["score"]), 3),
    })


def alive(pairs: DataFrame) -> Column:
    """True if any observation got a response, else null: no answer is a failed observation, not a dead site."""
    return F.when(F.greatest(*[fact(n, "status") for n in ORDER]) > 0, True)


def indicators(hits: Column) -> Column:
    """``category: hits`` of the categories that a page hits."""
    return F.array_compact(F.array(*[F.when(hits[k] > 0, F.concat(F.lit(f"{k}: "), hits[k].cast("string"))) for k in C.CATEGORIES]))


def model_only_rule(model_supports: Column, techniques: Column, static_rules: Column) -> Column:
    """S4: a model's support counts for the tier if no front-end rule fired and the page looks for crawlers or fingerprints."""
    looks = F.arrays_overlap(techniques, F.array(*map(F.lit, C.ARTIFACTS + C.FINGERPRINT)))
    return F.coalesce(model_supports, F.lit(False)) & (F.size(static_rules) == 0) & looks


def tier(label: Column, rule_label: Column, static_rules: Column, s4: Column) -> Column:
    return F.when(label == "true", "CONFIRMED").when((rule_label == "true") | (F.size(static_rules) > 0) | s4, "SUSPECTED").otherwise("AMBIGUOUS")


def page_evidence(page: Column) -> Column:
    """What a model may be told of a page: no rule result, no verdict."""
    return F.struct(page["url"].alias("url"), page["facts"]["title"].alias("title"), page["facts"]["excerpt"].alias("visible_text_excerpt"), page["facts"]["forms"].alias("forms"), page["facts"]["input_types"].alias("input_types"))


def observation_summary(name: str) -> Column:
    return F.struct(
        F.lit(name).alias("name"), fact(name, "kind").alias("kind"), fact(name, "access_index").alias("access_index"), fact(name, "status").alias("status"), fact(name, "url").alias("final_url"), F.slice(fact(name, "redirect_chain"), 1, 6).alias("redirect_chain"),
        F.coalesce(F.col(f"`{name}`.html.title"), F.lit("")).alias("title"), F.substring(fact(name, "excerpt"), 1, 300).alias("text_excerpt"), fact(name, "issues").alias("issues"),
    )


def cloaking_evidence(signals: Column, techniques: Column) -> Column:
    """What a model may be told of the observations: summaries and signals, no label."""
    there = F.array(*[F.when(fact(n, "there"), observation_summary(n)) for n in ("bot#1", "bot#2", "human#1", "human#2")])
    return F.struct(F.array_compact(there).alias("observations"), signals.alias("signals"), techniques.alias("frontend_js_categories"))


def render_evidence(value: Column, most: int = 12_000) -> Column:
    """Evidence as JSON text, cut to ``most`` characters."""
    return F.substring(F.to_json(value, {"ignoreNullFields": "false"}), 1, most)


def legacy_columns(df: DataFrame) -> DataFrame:
    """The flat diagnostic columns of the primary pair, from ``label``'s output."""
    bot, human = "bot#1", "human#1"
    return df.withColumns({
        "bot_mechanisms": fact(bot, "mechanisms"), "human_mechanisms": fact(human, "mechanisms"), "human_high_spec": F.array_sort(F.array_intersect(fact(human, "mechanisms"), F.array(*map(F.lit, C.HIGH_SPECIFICITY)))),
        "bot_is_phishing": fact(bot, "is_phishing"), "human_is_phishing": fact(human, "is_phishing"), "rule_fired_raw": F.size("fired") > 0, "dynamic_reliability": F.when(F.col("label").isin("true", "false"), "HIGH").otherwise("LOW"),
        "bot_status_code": fact(bot, "status"), "human_status_code": fact(human, "status"), "bot_html_length": fact(bot, "length"), "human_html_length": fact(human, "length"), "bot_error": fact(bot, "error"), "human_error": fact(human, "error"),
    })

