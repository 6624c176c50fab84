"""The signal table: seventeen descriptions of what the observations of a page show, none of which decides a label.

Each signal has an id, a category, a status and evidence. ``observed`` and ``not_observed`` compare what was there;
``not_tested`` means that the plan held no such observation, ``unmeasurable`` that one was planned and cannot be used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions import records as R
from ..functions.urls import host_of
from .pairs import NAMES, PAIRS, fact, nothing, one, same, systematic

MEANINGFUL = ("status", "final_host", "title", "mechanisms", "form_hosts", "script_hosts")
COMPARED = (*MEANINGFUL, "html_sha256", "text_sha256")
VARIANT_KEYS = ("status", "final_host", "mechanisms", "title")


def usable(name: str) -> Column:
    return fact(name, "usable")


def browser(name: str) -> Column:
    """Whether an observation is one of a browser, whatever its slot."""
    return fact(name, "kind") == "browser"


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _status(seen: Column, measurable: Column, tested: Column | None = None) -> Column:
    out = F.when(~tested, "not_tested") if tested is not None else F.when(F.lit(False), "")
    return out.when(~measurable, "unmeasurable").when(seen, "observed").otherwise("not_observed")


def _pairs(condition) -> tuple[Column, Column]:
    """Whether a condition of two names holds in a usable pair, and whether there is one."""
    ready = [(usable(a) & usable(b), a, b) for a, b in PAIRS]
    return _any(ok & condition(a, b) for ok, a, b in ready), _any(ok for ok, _, _ in ready)


def _differences(a: str, b: str, keys=COMPARED) -> Column:
    return F.array_compact(F.array(*[F.when(~same(a, b, k), F.lit(k)) for k in keys]))


def _base(url: Column) -> Column:
    return F.regexp_extract(url, "^([^?]*)", 1)


def _scripts(name: str, known: list[str]) -> tuple[Column, Column]:
    """What tells own scripts apart, by the fact that is known of them, and the addresses of the others."""
    own = next(F.col(f"`{name}`.html.{k}") for k in ("inline_set", "inline", "first_inline") if k in known)
    inline = F.array(own) if "inline_set" in known else F.coalesce(F.transform(own, lambda s: s["sha256"]), nothing())
    return F.array_distinct(inline), F.array_distinct(F.transform(fact(name, "external"), _base))


def _apart(x: Column, y: Column) -> Column:
    return (F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0)


def variant_signal(name: str, controls: tuple[str, str], view: str) -> tuple[Column, Column]:
    """Status of a variant's signal, and the keys in which it differs from all its usable controls, which agree."""
    v = F.col(f"variant_{name}")
    own = {"status": v["status"], "final_host": v["final_host"], "mechanisms": v["html"]["mechanisms"], "title": F.lower(v["html"]["title"])}
    a, b = controls
    ok_a, ok_b = usable(a), usable(b)
    keys = []
    for k in VARIANT_KEYS:
        other = F.when(ok_a, fact(a, k, view)).otherwise(fact(b, k, view))
        agree = ~(ok_a & ok_b) | same(a, b, k, view)
        keys.append(F.when(agree & ~other.eqNullSafe(own[k]), F.lit(k)))
    differs = F.array_compact(F.array(*keys))
    measurable = (F.size(R.among(v["issues"], C.BLOCKING)) == 0) & (ok_a | ok_b)
    return _status(F.size(differs) > 0, F.coalesce(measurable, F.lit(False)), v.isNotNull()), F.when(v.isNotNull(), differs).otherwise(nothing())


def gaps(names=NAMES) -> Column:
    """Seconds between accesses that follow each other, where both times are known; to three digits."""
    row = lambda n: F.when(fact(n, "there"), F.struct(fact(n, "access_index").alias("i"), F.unix_micros(fact(n, "observed_at")).alias("t")))
    ordered = F.array_sort(F.array_compact(F.array(*map(row, names))))
    steps = F.zip_with(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda y, x: (y["t"] - x["t"]) / F.lit(1e6))
    return F.transform(F.filter(steps, lambda s: s.isNotNull()), lambda s: F.round(s, 3))


def _ordered() -> Column:
    """Usable observations in the order of access."""
    row = lambda n: F.when(usable(n), F.struct(fact(n, "access_index").alias("i"), F.lit(n).alias("name"), fact(n, "mechanisms").alias("m"), fact(n, "status").alias("s")))
    return F.array_sort(F.array_compact(F.array(*map(row, NAMES))))


def _first_access(ordered: Column) -> tuple[Column, Column]:
    """Mechanisms that only the first usable access shows, and whether its status differs from all later ones."""
    first, later = ordered[0], F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    only = F.when(F.size(ordered) > 0, F.array_except(first["m"], F.flatten(F.transform(later, lambda x: x["m"])))).otherwise(nothing())
    codes = F.array_distinct(F.transform(later, lambda x: x["s"]))
    apart = (F.size(codes) == 1) & ~F.array_contains(codes, F.when(F.size(ordered) > 0, first["s"]))
    return F.array_sort(only), F.coalesce(apart, F.lit(False))


def _variant_steps() -> dict[str, Column]:
    return dict(zip(("__referer", "__referer_keys"), variant_signal("referer", ("bot#1", "bot#2"), "html"), strict=True)) | dict(zip(("__mobile", "__mobile_keys"), variant_signal("mobile", ("human#1", "human#2"), "dom"), strict=True))


def _variant_names(referer: Column, mobile: Column) -> Column:
    return F.concat(one(referer == "observed", "referer"), one(mobile == "observed", "mobile"))


def variant_differences(pairs: DataFrame) -> DataFrame:
    """Adds ``variant_differences`` alone: of all signals, what labels look at."""
    steps = {k: c for k, c in _variant_steps().items() if not k.endswith("_keys")}
    return pairs.withColumns(steps).withColumn("variant_differences", _variant_names(F.col("__referer"), F.col("__mobile"))).drop(*steps)


def signals(pairs: DataFrame, static_rules: Column) -> DataFrame:
    """Adds ``signals``, an array of (id, category, status, evidence) in fixed order, and the lists observed and not_tested.

    ``pairs``: rows of ``pair_table``, with one of the facts inline_set, inline and first_inline.
    """
    all_usable = usable("bot#1") & usable("bot#2") & usable("human#1") & usable("human#2")
    answered = [F.when(fact(n, "status") != 0, fact(n, "status")) for n in NAMES]
    codes = F.array_compact(F.array(*answered))
    has_browser = _any(fact(n, "there") & browser(n) for n in NAMES)
    client, pair_there = _pairs(lambda a, b: _any(~same(a, b, k) for k in MEANINGFUL))
    text, _ = _pairs(lambda a, b: ~same(a, b, "text_sha256"))
    dom_there = {n: usable(n) & browser(n) & (fact(n, "length", "dom") > 0) for n in NAMES}
    added = {n: F.array_sort(F.array_except(fact(n, "mechanisms", "dom"), fact(n, "mechanisms"))) for n in NAMES}
    removed = {n: F.array_sort(F.array_except(fact(n, "mechanisms"), fact(n, "mechanisms", "dom"))) for n in NAMES}
    changed = _any(dom_there[n] & ((F.size(added[n]) > 0) | (F.size(removed[n]) > 0) | ~F.col(f"`{n}`.html.text_sha256").eqNullSafe(F.col(f"`{n}`.dom.text_sha256"))) for n in NAMES)
    known = pairs.schema[NAMES[0]].dataType["html"].dataType.names
    scripts, _ = _pairs(lambda a, b: _apart(_scripts(a, known)[0], _scripts(b, known)[0]) | _apart(_scripts(a, known)[1], _scripts(b, known)[1]))
    errors = _any((fact(n, "error") != "") | (browser(n) & ((fact(n, "body_error") != "") | _any(fact(n, c) > 0 for c in ("blocked", "failed", "dialogs", "downloads", "popups")))) for n in NAMES)
    hosts = {n: F.array_distinct(F.filter(F.transform(fact(n, "redirect_chain"), host_of), lambda h: h != "")) for n in NAMES}
    hops = {n: F.greatest(F.size(fact(n, "redirect_chain")) - 1, F.lit(0)) for n in NAMES}
    redirected = _any((hops[n] >= 2) | (F.size(hosts[n]) > 1) for n in NAMES)
    moved = _any(((fact(n, "client_navigations") > 0) | ((fact(n, "page_url") != "") & (fact(n, "page_url") != fact(n, "url")))) & browser(n) for n in NAMES)
    snapshots = {n: browser(n) & F.col(f"`{n}`.early").isNotNull() for n in NAMES}
    late = {n: F.array_sort(F.array_except(fact(n, "mechanisms", "dom"), fact(n, "mechanisms", "early"))) for n in NAMES}
    delayed = _any(snapshots[n] & ((F.size(late[n]) > 0) | ((fact(n, "text_length", "early") == 0) & (fact(n, "text_length", "dom") > 0))) for n in NAMES)
    blank = _any((fact(n, "status") != 0) & ((fact(n, "text_length") == 0) | (browser(n) & (fact(n, "text_length", "dom") == 0))) for n in NAMES)
    odd = lambda n: fact(n, "title").rlike(f"(?i){C.ERROR_TITLE}") | F.lower(F.coalesce(F.col(f"`{n}`.dom.title"), F.lit(""))).rlike(f"(?i){C.ERROR_TITLE}")
    error_page = _any((fact(n, "status") != 0) & (~fact(n, "status").between(200, 299) | odd(n)) for n in NAMES)
    plain = lambda a, b: fact(a, "status").between(200, 299) & (fact(a, "text_length") > 0) & (F.size(fact(a, "mechanisms")) == 0) & (F.size(fact(b, "mechanisms")) > 0)
    decoy, _ = _pairs(lambda a, b: plain(a, b) | plain(b, a))
    decoys = F.array_compact(F.array(*[F.when(usable(a) & usable(b) & plain(x, y), F.lit(x)) for a, b in PAIRS for x, y in ((a, b), (b, a))]))
    within = [(usable(f"{s}#1") & usable(f"{s}#2"), f"{s}#1", f"{s}#2") for s in ("bot", "human")]
    repeats, sides = _any(ok & _any(~same(a, b, k) for k in MEANINGFUL) for ok, a, b in within), _any(ok for ok, _, _ in within)
    steps = _variant_steps()
    steps |= {"__ordered": _ordered(), "__gaps": gaps(), "__by_key": F.array_compact(F.array(*[F.when(all_usable & systematic(k), F.lit(k)) for k in COMPARED]))}
    only, status = _first_access(F.col("__ordered"))
    pairs = pairs.withColumns(steps).withColumns({"__only": only, "__status_first": status})
    referer, referer_keys, mobile, mobile_keys, by_key, only_first, status_first, accesses = (F.col(c) for c in ("__referer", "__referer_keys", "__mobile", "__mobile_keys", "__by_key", "__only", "__status_first", "__ordered"))
    accesses = F.size(accesses)
    join = lambda x: F.array_join(x, ",")
    every = lambda by_name: join(F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(browser(n), c).otherwise(nothing()) for n, c in by_name.items()])))))
    rows = [
        ("client_type_response_difference", "ua_browser_type", _status(client | (F.size(by_key) > 0), pair_there), join(by_key)), ("referer_presence_effect", "referer", referer, join(referer_keys)), ("desktop_mobile_difference", "device", mobile, join(mobile_keys)),
        ("http_status_difference", "status_text_dom_js_errors", _status(F.size(F.array_distinct(codes)) > 1, F.size(codes) >= 2), F.concat_ws(",", *[F.concat(F.lit(f"{n}="), fact(n, "status").cast("string")) for n in NAMES])),
        ("visible_text_difference", "status_text_dom_js_errors", _status(text, pair_there), F.concat_ws(",", *[F.concat(F.lit(f"{n}="), fact(n, "text_length").cast("string")) for n in NAMES])),
        ("js_modified_dom", "status_text_dom_js_errors", _status(changed, _any(dom_there.values()), has_browser), every(added)), ("script_inventory_difference", "status_text_dom_js_errors", _status(scripts, pair_there), F.lit("")),
        ("frontend_cloaking_code", "status_text_dom_js_errors", F.when(F.size(static_rules) > 0, "observed").otherwise("not_observed"), join(static_rules)), ("browser_errors", "status_text_dom_js_errors", _status(errors, F.lit(True)), F.concat_ws(",", *[fact(n, "error") for n in NAMES])),
        ("multi_hop_redirect", "redirect_delay_blank_decoy", _status(redirected, F.lit(True)), F.concat_ws(",", *[F.concat(F.lit(f"{n}="), hops[n].cast("string")) for n in NAMES])), ("client_side_redirect", "redirect_delay_blank_decoy", _status(moved, F.lit(True), has_browser), F.lit("")),
        ("delayed_content", "redirect_delay_blank_decoy", _status(delayed, F.lit(True), _any(snapshots.values())), every(late)), ("blank_page", "redirect_delay_blank_decoy", _status(blank, F.size(codes) > 0), F.lit("")),
        ("error_page", "redirect_delay_blank_decoy", _status(error_page, F.size(codes) > 0), F.lit("")), ("decoy_candidate", "redirect_delay_blank_decoy", _status(decoy, pair_there), join(decoys)),
        ("repeat_instability", "repeat_observation", _status(repeats, sides), join(F.transform(F.col("__gaps"), lambda g: F.format_string("%.3f", g)))), ("first_access_only", "repeat_observation", _status((F.size(only_first) > 0) | status_first, accesses >= 2), join(only_first)),
    ]
    table = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("category"), s.alias("status"), F.coalesce(e, F.lit("")).alias("evidence")) for i, c, s, e in rows])
    out = pairs.withColumn("signals", table)
    names = lambda status: F.transform(F.filter("signals", lambda s: s["status"] == status), lambda s: s["id"])
    told = {"observed": names("observed"), "not_tested": names("not_tested"), "variant_differences": _variant_names(referer, mobile)}
    return out.withColumns(told).drop(*steps, "__only", "__status_first")


def signal_rows(pairs: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page and signal."""
    return pairs.select(key, F.posexplode("signals").alias("place", "s")).select(key, "place", "s.*")
