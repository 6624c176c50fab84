"""Client comparison: observations of a page side by side, rules C1 to C5 per replicate, then the gates that leave a label open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions import records as R
from ..functions.pages import FACTS, facts_once
from ..functions.urls import host_of

BLOCKED = (403, 404, 503)
#: Issues that leave a rule, a true label or a false label undecided (fixed values).
UNUSABLE = ("missing_observation", "crawl_error", "empty_document", "non_html_document", "document_body_unavailable")
RULE_BOT = ("missing_observation", "crawl_error", "non_html_document")
TRUE_HUMAN = (*UNUSABLE, "http_error_status", "challenge_or_block_page", "content_truncated")
TRUE_BOT = ("missing_observation", "crawl_error", "non_html_document", "content_truncated")
FALSE_ALL = (*UNUSABLE, "http_error_status", "challenge_or_block_page", "interaction_gate", "content_truncated")
NAMES = ("bot#1", "bot#2", "human#1", "human#2")
VARIANTS = ("referer", "mobile")
PAIRS = (("bot#1", "human#1"), ("bot#2", "human#2"))
#: What has to agree between a client's replicates, and between the clients, before a label is false.
STABLE = ("status", "final_host", "mechanisms")
SYSTEMATIC = (*STABLE, "title", "form_hosts", "script_hosts", "html_sha256")
#: What a pair of observations carries besides the facts of its pages, and what a missing one has instead.
CARRIED = ("status", "error", "url", "redirect_chain", "page_url", "kind", "access_index", "observed_at", "client_navigations", "blocked", "failed", "dialogs", "downloads", "popups", "body_error")
_DEFAULTS = {"status": 0, "error": "", "url": "", "page_url": "", "kind": "", "client_navigations": 0, "blocked": 0, "failed": 0, "dialogs": 0, "downloads": 0, "popups": 0, "body_error": ""}
_VIEW_KEYS = {
    "html": ("length", "text_length", "visible", "title", "mechanisms", "form_hosts", "script_hosts", "html_sha256", "text_sha256", "is_phishing", "excerpt", "external"), "dom": ("length", "text_length", "title", "mechanisms", "form_hosts", "script_hosts"), "early": ("text_length", "mechanisms"),
}
_PAGE_DEFAULTS = {"length": 0, "text_length": 0, "visible": False, "title": "", "score": 0.0, "is_phishing": False, "excerpt": "", "forms": 0}


def _lits(names) -> Column:
    return F.array(*map(F.lit, names))


def nothing() -> Column:
    return F.array().cast("array<string>")


def one(condition: Column, name: str | Column) -> Column:
    """An array of the name where the condition holds, else an empty one."""
    return F.when(condition, F.array(F.lit(name) if isinstance(name, str) else name)).otherwise(nothing())


#: Views of an observation: the server document, the page after its scripts ran, the early page; each with its address.
VIEWS = {"html": ("html", "url"), "dom": ("dom_html", "page_url"), "early": ("early_html", "page_url")}


def view_rows(obs: DataFrame) -> DataFrame:
    """One row per observation and view: o (all but the texts), view, body, address. Every observation has the view html.

    Observations of changed clients have the name of their ``variant``; the others have none.
    """
    if "variant" not in obs.columns:
        obs = obs.withColumn("variant", F.lit(None).cast("string"))
    own = [c for c in obs.columns if c not in [body for body, _ in VIEWS.values()]]
    view = lambda name, body, address: F.when(F.lit(name == "html") | F.col(body).isNotNull(), F.struct(F.lit(name).alias("view"), F.coalesce(body, F.lit("")).alias("body"), F.coalesce(F.col(address), F.col("url"), F.lit("")).alias("address")))
    views = obs.select(F.struct(*own).alias("o"), F.explode(F.array_compact(F.array(*[view(name, *at) for name, at in VIEWS.items()]))).alias("v"))
    return views.select("o", "v.view", "v.body", "v.address")


def page_rows(obs: DataFrame) -> DataFrame:
    """One row per observation and distinct page of its views: o (all but the texts), views (their names), body, address.

    A page that was the same before and after its scripts is sent on and keyed once. Variants as in ``view_rows``.
    """
    if "variant" not in obs.columns:
        obs = obs.withColumn("variant", F.lit(None).cast("string"))
    own, names = [c for c in obs.columns if c not in [body for body, _ in VIEWS.values()]], list(VIEWS)
    at = {v: (F.coalesce(body, F.lit("")), F.coalesce(F.col(address), F.col("url"), F.lit(""))) for v, (body, address) in VIEWS.items()}
    there = {v: F.lit(v == "html") | F.col(body).isNotNull() for v, (body, _) in VIEWS.items()}
    twins = [(u, v) for i, u in enumerate(names) for v in names[i + 1 :]]
    obs = obs.withColumns({f"__{u}_{v}": there[u] & there[v] & (at[u][1] == at[v][1]) & (at[u][0] == at[v][0]) for u, v in twins})
    new = {v: reduce(Column.__and__, [~F.col(f"__{u}_{w}") for u, w in twins if w == v], there[v]) for v in names}
    told = {v: F.array_compact(F.array(F.lit(v), *[F.when(F.col(f"__{u}_{w}"), F.lit(w)) for u, w in twins if u == v])) for v in names}
    pages = [F.when(new[v], F.struct(told[v].alias("views"), at[v][0].alias("body"), at[v][1].alias("address"))) for v in names]
    return obs.select(F.struct(*own).alias("o"), F.explode(F.array_compact(F.array(*pages))).alias("v")).select("o", "v.views", "v.body", "v.address")


def with_issues(rows: DataFrame) -> DataFrame:
    """Adds the issues of both views and the hosts that they came from."""
    length = "text_length" if "text_length" in rows.schema["html"].dataType.names else "visible"
    return rows.withColumns({"issues": R.issues("html", length), "dom_issues": R.issues("dom", length), "final_host": host_of(F.col("url")), "dom_host": host_of(F.coalesce("page_url", "url"))})


#: Facts that issues are told by; those that labels compare besides; those that signals compare besides; those that verdicts read.
ISSUE_FACTS = ("length", "text_length", "gates")
LABEL_FACTS = (*ISSUE_FACTS, "title", "mechanisms", "form_hosts", "script_hosts", "html_sha256", "static_rules")
SIGNAL_FACTS = (*LABEL_FACTS, "text_sha256", "inline_set", "external")
VERDICT_FACTS = (*ISSUE_FACTS, "score", "decisive", "obfuscated")
#: Those that signals in full read.
DETAIL_FACTS = (*LABEL_FACTS, "text_sha256", "excerpt", "techniques", "inline", "external")
#: All facts, but of a page's own scripts the first only: what result rows are made from.
RESULT_FACTS = tuple("first_inline" if f == "inline" else f for f in FACTS)


def brief(facts) -> tuple[str, ...]:
    """Facts with whether there is visible text in place of its length: for queries that read no more of it."""
    return tuple("visible" if f == "text_length" else f for f in facts)


def seen(obs: DataFrame, key: str = "page_id", wanted=FACTS) -> DataFrame:
    """Each observation with the facts of its views (structs html, dom, early), its issues by view, and no page text.

    ``wanted``: the facts that are asked for, those of issues at least. A struct that crosses a shuffle is worked out whole, so a
    query that reads few facts says which.
    """
    found = facts_once(page_rows(obs), "body", "address", {*(brief(ISSUE_FACTS) if "visible" in wanted else ISSUE_FACTS), *wanted})
    by_view = [F.any_value(F.when(F.array_contains("views", v), F.col("facts")), ignoreNulls=True).alias(v) for v in VIEWS]
    rows = found.groupBy(F.col(f"o.{key}"), F.col("o.slot"), F.col("o.replicate"), F.col("o.access_index"), F.col("o.variant")).agg(F.any_value("o").alias("o"), *by_view).select("o.*", *VIEWS)
    return with_issues(rows)


def listed(obs: DataFrame) -> DataFrame:
    """Observations without their texts and what only a look at those tells: for queries of where and how pages were fetched."""
    if "variant" not in obs.columns:
        obs = obs.withColumn("variant", F.lit(None).cast("string"))
    return obs.drop(*[body for body, _ in VIEWS.values()]).withColumn("final_host", host_of(F.col("url")))


def name_of(variant: str = "variant", slot: str = "slot", replicate: str = "replicate") -> Column:
    """The name of an observation: its variant, or slot and replicate such as ``bot#1``."""
    return F.coalesce(F.col(variant), F.concat(F.col(slot), F.lit("#"), F.col(replicate).cast("string")))


def pair_table(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page: its four named observations side by side, and the structs variant_referer and variant_mobile.

    A missing observation has the issue for it, a missing variant is null. Of several observations of one name the one with
    the smallest access index counts, of these the one seen first. Rows of ``listed``, or with some facts only, give the columns
    that follow from what they have.
    """
    name, have = name_of(), set(rows.columns)
    known = {v: rows.schema[v].dataType.names for v in VIEWS if v in have}
    found = [c for c in ("issues", "dom_issues", "final_host", "dom_host") if c in have]
    shared = [F.any_value(c, ignoreNulls=True).alias(c) for c in ("asked", "scenario") if c in rows.columns]
    row = F.struct(*CARRIED, *known, *found)
    changed = F.struct(*[c for c in ("status", "html", "issues", "final_host") if c in have])
    place = F.struct(F.coalesce("access_index", F.lit(0)), F.coalesce(F.unix_micros("observed_at"), F.lit(0)))
    pick = lambda what, n: F.min_by(F.when(F.col("__n") == n, what), F.when(F.col("__n") == n, place))
    out = rows.withColumn("__n", name).groupBy(key).agg(*shared, *[pick(row, n).alias(n) for n in NAMES], *[pick(changed, v).alias(f"variant_{v}") for v in VARIANTS])
    # plain columns, which later steps read often, and not one struct whose parts the optimizer would write out again each time
    flat = {}
    for n in NAMES:
        own, slug = f"`{n}`", _slug(n)
        flat |= {f"{slug}_{c}": F.coalesce(F.col(f"{own}.{c}"), F.lit(_DEFAULTS[c])) if c in _DEFAULTS else F.col(f"{own}.{c}") for c in CARRIED}
        flat |= {f"{slug}_redirect_chain": F.coalesce(F.col(f"{own}.redirect_chain"), nothing()), f"{slug}_there": F.col(own).isNotNull()}
        flat |= {f"{slug}_{c}": F.coalesce(F.col(f"{own}.{c}"), F.array(F.lit("missing_observation")) if c.endswith("issues") else F.lit("")) for c in found}
        if "issues" in found:
            flat[f"{slug}_usable"] = F.col(own).isNotNull() & (F.size(R.among(F.col(f"{own}.issues"), C.BLOCKING)) == 0)
        for view, names in known.items():
            for k in (k for k in _VIEW_KEYS[view] if k in names):
                value = F.col(f"{own}.{view}.{k}")
                value = F.lower(value) if k == "title" else value
                none = F.lit(_PAGE_DEFAULTS[k]) if k in _PAGE_DEFAULTS else F.sha2(F.lit(""), 256) if k.endswith("sha256") else nothing()
                flat[f"{slug}_{view}_{k}"] = F.coalesce(value, none)
            if some := [k for k in ("visible", "text_length") if k in names]:
                flat[f"{slug}_{view}_text"] = F.coalesce(F.col(f"{own}.{view}.{some[0]}").cast("int"), F.lit(0)) > 0
    return out.withColumns(flat)


def _slug(name: str) -> str:
    return name.replace("#", "")


def fact(name: str, key: str, view: str = "html") -> Column:
    """A fact of an observation, or of its page; empty for a missing one."""
    if key == "final_host":
        return F.col(f"{_slug(name)}_{'dom_host' if view == 'dom' else 'final_host'}")
    if key in CARRIED or key in ("issues", "dom_issues", "there", "usable"):
        return F.col(f"{_slug(name)}_{key}")
    return F.col(f"{_slug(name)}_{view}_{key}")


def same(a: str, b: str, key: str, view: str = "html") -> Column:
    return fact(a, key, view).eqNullSafe(fact(b, key, view))


def systematic(key: str) -> Column:
    """Equal within each client and different between them."""
    return same("bot#1", "bot#2", key) & same("human#1", "human#2", key) & ~same("bot#1", "human#1", key)


def specific(mechanisms: Column) -> Column:
    return F.arrays_overlap(mechanisms, _lits(C.HIGH_SPECIFICITY))


def rules(b: str, h: str) -> dict[str, Column]:
    """The rules a pair fires, the mechanisms only one side saw, and how the plain client's channel was treated."""
    bot, human = fact(b, "mechanisms"), fact(h, "mechanisms")
    b_err, h_err, b_text, h_text = fact(b, "error"), fact(h, "error"), *(F.col(f"{_slug(n)}_html_text") for n in (b, h))
    shut, evil = fact(b, "status").isin(*BLOCKED), specific(human)
    last = lambda n: F.coalesce(F.try_element_at(fact(n, "redirect_chain"), F.lit(-1)), F.lit(""))
    host = lambda n: F.when(F.regexp_extract(last(n), "https?://([^/]+)", 1) != "", F.regexp_extract(last(n), "https?://([^/]+)", 1)).otherwise(last(n))
    fork = (last(b) != "") & (last(h) != "") & (host(b) != host(h))
    hidden, reset = F.array_sort(F.array_except(human, bot)), b_err.contains("ERR_HTTP2_PROTOCOL_ERROR")
    fired = [
        ("C1", (F.size(hidden) > 0) & b_text & (b_err == "") & ~shut), ("C2", shut & (fact(h, "status") == 200) & evil), ("C3", reset & (h_err == "") & evil), ("C4", h_text & ~b_text & (b_err == "") & evil),
        ("C5", fork & (F.size(human) > 0) & (F.size(bot) == 0)),
    ]
    blocked = (shut & (fact(h, "status") == 200)) | (reset & (h_err == "")) | (h_text & ~b_text & (b_err == ""))
    return {
        "fired": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fired])), "hidden": hidden, "shared": F.array_sort(F.array_intersect(human, bot)), "reverse": F.array_sort(F.array_except(bot, human)),
        "channel_blocked": blocked, "fork": fork,
    }


def evidence(r: dict[str, Column], b: str, h: str) -> Column:
    """Codes of what a pair shows: its fired rules with their mechanisms, or why nothing fired."""
    human = fact(h, "mechanisms")
    told = F.transform(r["fired"], lambda x: F.concat(x, F.lit(":"), F.when(x == "C1", F.array_join(r["hidden"], ",")).when(x == "C5", fact(h, "url")).otherwise(F.array_join(F.array_sort(F.array_intersect(human, _lits(C.HIGH_SPECIFICITY))), ","))))
    quiet = F.size(r["fired"]) == 0
    return F.concat(
        told, one(quiet & (F.size(r["shared"]) > 0), F.concat(F.lit("same_mechanisms:"), F.array_join(r["shared"], ","))), one(quiet & (F.size(r["shared"]) == 0) & (F.size(human) == 0), "no_mechanisms"),
        one(quiet & r["channel_blocked"] & ~specific(human), "anti_bot_only"), one(quiet & r["fork"], "benign_fork"),
    )


def tagged(name: str, allowed, skip: Column | None = None) -> Column:
    found = F.array_intersect(fact(name, "issues"), _lits(allowed))
    if skip is not None:
        found = F.array_except(found, skip)
    return F.transform(found, lambda i: F.concat(F.lit(f"{name}:"), i))


def label(pairs: DataFrame, frontend: Column | None = None, variant_differences: Column | None = None) -> DataFrame:
    """Adds fired, hidden, reverse, channel_blocked, evidence, rule_label, label, basis and reasons (in order, without repeats).

    ``frontend``: front-end rules that the judged page fires; ``variant_differences``: variants that differ from all their
    controls. Either one only keeps a label from being false.
    """
    frontend, variant_differences = (nothing() if x is None else F.coalesce(x, nothing()) for x in (frontend, variant_differences))
    r1, r2 = rules(*PAIRS[0]), rules(*PAIRS[1])
    p = pairs.withColumns({"fired": r1["fired"], "hidden": r1["hidden"], "reverse": r1["reverse"], "channel_blocked": r1["channel_blocked"], "__f2": r2["fired"], "__h2": r2["hidden"], "__r2": r2["reverse"], "__front": frontend, "__variants": variant_differences})
    p = p.withColumn("evidence", evidence(r1 | {"fired": F.col("fired"), "hidden": F.col("hidden")}, *PAIRS[0]))
    both = fact("bot#2", "there") & fact("human#2", "there")
    reset = one(F.array_contains("fired", "C3"), "crawl_error")
    blockers = F.concat(tagged("bot#1", RULE_BOT, reset), tagged("human#1", UNUSABLE))
    p = p.withColumn("__block", blockers).withColumn("rule_label", F.when(F.size("__block") > 0, "unknown").when(F.size("fired") > 0, "true").otherwise("false"))
    moved = both & ~(F.col("fired").eqNullSafe(F.col("__f2")) & F.col("hidden").eqNullSafe(F.col("__h2")))
    when_true = F.concat(tagged("human#1", TRUE_HUMAN), tagged("human#2", TRUE_HUMAN), tagged("bot#1", TRUE_BOT, reset), tagged("bot#2", TRUE_BOT, reset), one(~both, "missing_replicate_pair"), one(moved, "difference_not_replicated"), one(~specific(F.col("hidden")), "difference_without_high_specificity_evidence"))
    when_false = F.concat(*[tagged(n, FALSE_ALL) for n in NAMES], one(~both, "missing_replicate_pair"), one(both & (F.size("__f2") > 0), "difference_not_replicated"))
    drift = [one(~same(f"{s}#1", f"{s}#2", k), f"{s}_unstable_{k}") for s in ("bot", "human") for k in STABLE]
    drift += [one(systematic(k), f"systematic_{k}_difference_without_mechanism_evidence") for k in SYSTEMATIC]
    drift += [one((fact(n, "length", "dom") > 0) & (F.size(F.array_except(fact(n, "mechanisms", "dom"), fact(n, "mechanisms"))) > 0), f"{n}:js_rendered_mechanisms_not_compared") for n in NAMES]
    later = F.concat(one(F.size("__front") > 0, F.concat(F.lit("frontend_cloaking_code_present:"), F.array_join("__front", ","))), F.transform("__variants", lambda v: F.concat(F.lit("variant_difference_unconfirmed:"), v)))
    p = p.withColumn("__why", F.when(F.col("rule_label") == "unknown", F.col("__block")).when(F.col("rule_label") == "true", when_true).otherwise(when_false))
    unsure = F.col("rule_label") == "false"
    p = p.withColumn("__why", F.when(unsure & (F.size("__why") == 0), F.concat(*drift)).otherwise(F.col("__why"))).withColumn("__why", F.when(unsure, F.concat("__why", later)).otherwise(F.col("__why")))
    back = (F.col("rule_label") != "unknown") & ((F.size("reverse") > 0) | (both & (F.size("__r2") > 0)))
    p = p.withColumn("reasons", F.array_distinct(F.concat("__why", one(back, "reverse_difference_or_order_effect"))))
    p = p.withColumn("label", F.when((F.col("rule_label") != "unknown") & (F.size("reasons") == 0), F.col("rule_label")).otherwise("unknown"))
    basis = (
        F.when(F.col("label") == "true", F.concat(F.lit("rules="), F.array_join("fired", "+"), F.lit(" in both pairs; hidden_from_bot="), F.array_join("hidden", ",")))
        .when(F.col("label") == "false", "no rule in either pair; equal across clients and stable within each")
        .otherwise(F.concat(F.lit("rule="), F.col("rule_label"), F.lit("; gated by "), F.size("reasons").cast("string"), F.lit(" reason(s)")))
    )
    reason = F.when(F.col("label") == "true", "replicated_client_type_mechanism_difference").when(F.col("label") == "false", "not_observed_in_tested_client_types").otherwise(F.array_join("reasons", ";"))
    return p.withColumns({"basis": basis, "reason": reason}).drop("__why", "__block", "__f2", "__h2", "__r2", "__front", "__variants")
