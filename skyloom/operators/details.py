"""The seventeen signals in full, from the long table of observations: any number of replicates, any pair of clients.

Each signal is a struct of category, status, what was compared, and evidence whose type is the signal's own. Nothing here assumes four
names: which clients are browsers is a column of the observation, replicates meet their predecessor and their partner of the
other slot by windows and grouping on the page, and changed clients meet all usable controls of their slot by a join with
a table of variants. All of it is clustered by page, so the rows are shuffled once by their key and no page text with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions import records as R
from ..functions.urls import host_of
from .pairs import name_of, nothing
from .signals import COMPARED, MEANINGFUL, VARIANT_KEYS

#: Changed clients: the signal each gives, the slot that its controls are in, and the view that is compared.
VARIANT_ROWS = (("referer", "referer_presence_effect", "referer", "bot", "html"), ("mobile", "desktop_mobile_difference", "device", "human", "dom"))
SIGNALS = (
    ("client_type_response_difference", "ua_browser_type"), ("referer_presence_effect", "referer"), ("desktop_mobile_difference", "device"), ("http_status_difference", "status_text_dom_js_errors"), ("visible_text_difference", "status_text_dom_js_errors"),
    ("js_modified_dom", "status_text_dom_js_errors"), ("script_inventory_difference", "status_text_dom_js_errors"), ("frontend_cloaking_code", "status_text_dom_js_errors"), ("browser_errors", "status_text_dom_js_errors"),
    ("multi_hop_redirect", "redirect_delay_blank_decoy"), ("client_side_redirect", "redirect_delay_blank_decoy"), ("delayed_content", "redirect_delay_blank_decoy"), ("blank_page", "redirect_delay_blank_decoy"), ("error_page", "redirect_delay_blank_decoy"),
    ("decoy_candidate", "redirect_delay_blank_decoy"), ("repeat_instability", "repeat_observation"), ("first_access_only", "repeat_observation"),
)


def variant_table(spark, rows=VARIANT_ROWS) -> DataFrame:
    return spark.createDataFrame(rows, "variant string, id string, category string, control string, view string")


def _features(view: str) -> Column:
    """What a view is compared by, every key as text; a view that is not there is that of an empty page."""
    at = lambda k, none: F.coalesce(F.col(f"{view}.{k}"), F.lit(none) if isinstance(none, str) else none)
    empty = F.sha2(F.lit(""), 256)
    text = {
        "status": F.col("status").cast("string"), "final_host": F.col("dom_host" if view == "dom" else "final_host"), "title": F.lower(at("title", "")),
        **{k: F.array_join(at(k, nothing()), "|") for k in ("mechanisms", "form_hosts", "script_hosts")}, "html_sha256": at("html_sha256", empty), "text_sha256": at("text_sha256", empty),
    }
    return F.struct(*[text[k].alias(k) for k in COMPARED])


def narrow(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """The columns of ``pairs.seen`` rows that signals read, with defaults in place of nulls."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c.split(".")[0] in rows.columns else F.lit(0).cast("long")
    word = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    words = lambda c: F.coalesce(F.col(c), nothing()) if c.split(".")[0] in rows.columns else nothing()
    inline = F.coalesce(F.array_distinct(F.transform("html.inline", lambda s: s["sha256"])), nothing())
    external = F.array_distinct(F.transform(words("html.external"), lambda u: F.regexp_extract(u, "^([^?]*)", 1)))
    names = {
        "name": name_of(), "place": number("access_index"), "us": F.unix_micros("observed_at"), "usable": F.size(R.among(F.col("issues"), C.BLOCKING)) == 0, "browser": word("kind") == "browser", "f": _features("html"), "d": _features("dom"), "status": number("status"),
        "length": number("html.length"), "text_length": number("html.text_length"), "excerpt": F.substring(F.coalesce("html.excerpt", F.lit("")), 1, 160), "title": F.coalesce("html.title", F.lit("")), "mechanisms": words("html.mechanisms"), "has_dom": number("dom.length") > 0,
        "dom_text_length": number("dom.text_length"), "dom_title": F.coalesce("dom.title", F.lit("")), "dom_mechanisms": words("dom.mechanisms"), "has_early": F.col("early").isNotNull(), "early_text_length": number("early.text_length"), "early_mechanisms": words("early.mechanisms"),
        "inline": inline, "external": external, "static_rules": words("html.static_rules"), "techniques": words("html.techniques"), "dom_rules": words("dom.static_rules"), "dom_techniques": words("dom.techniques"), "clear_dom": F.size(R.among(F.col("dom_issues"), C.BLOCKING)) == 0,
        "chain": words("redirect_chain"), "page_errors": words("page_errors"), **{c: number(c) for c in ("client_navigations", "console_errors", "failed_all", "failed", "blocked_all", "blocked", "dialogs", "downloads", "popups")},
        **{c: word(c) for c in ("kind", "error", "error_kind", "url", "page_url", "load_event", "body_error", "user_agent", "referer", "profile")},
    }
    return rows.select(key, "slot", "replicate", "variant", "issues", *[c.alias(n) for n, c in names.items()])


def _differing(x: Column, y: Column, keys=COMPARED) -> Column:
    return F.array_compact(F.array(*[F.when(~x[k].eqNullSafe(y[k]), F.lit(k)) for k in keys]))


def _some(keys: Column) -> Column:
    return F.arrays_overlap(keys, F.array(*map(F.lit, MEANINGFUL)))


def _list(value: Column, when: Column | None = None) -> Column:
    """Values of a page's rows, sorted; their number is bounded by the plan."""
    return F.array_sort(F.collect_list(value if when is None else F.when(when, value)))


def _without(rows: Column, field: str) -> Column:
    """Structs without the field that only sorted them."""
    return F.transform(rows, lambda r: r.dropFields(field))


def _observations(n: DataFrame, key: str) -> DataFrame:
    """One row per page: what its planned observations show, each one alone and in the order of access."""
    order = Window.partitionBy(key).orderBy("place", "name")
    kept = Window.partitionBy(key, "usable").orderBy("place", "name")
    later = kept.rowsBetween(1, Window.unboundedFollowing)
    side = Window.partitionBy(key, "slot", "usable").orderBy("replicate")
    gap = F.round((F.col("us") - F.lag("us").over(order)) / 1e6, 3)
    hosts = F.filter(F.transform("chain", host_of), lambda h: h != "")
    n = n.withColumns({
        "gap": gap, "access": F.row_number().over(order), "nth": F.row_number().over(kept), "later_mechanisms": F.array_distinct(F.flatten(F.collect_list("mechanisms").over(later))), "later_status": F.collect_set("status").over(later),
        "before": F.lag(F.struct("name", "f")).over(side), "hops": F.greatest(F.size("chain") - 1, F.lit(0)), "hosts": F.transform("chain", host_of), "cross_host": F.size(F.array_distinct(hosts)) > 1,
        "added": F.array_sort(F.array_except("dom_mechanisms", "mechanisms")), "removed": F.array_sort(F.array_except("mechanisms", "dom_mechanisms")), "after": F.array_sort(F.array_except("dom_mechanisms", "early_mechanisms")),
    })
    first, usable, browser, answered = (F.col("nth") == 1) & F.col("usable"), F.col("usable"), F.col("browser"), F.col("status") != 0
    only = F.array_sort(F.array_except("mechanisms", F.coalesce("later_mechanisms", nothing())))
    status_first = (F.size("later_status") == 1) & ~F.array_contains("later_status", F.col("status"))
    rendered = browser & usable & F.col("has_dom")
    early = browser & F.col("has_early")
    odd = lambda c: F.col(c).rlike(f"(?i){C.ERROR_TITLE}")
    counts = ("console_errors", "failed_all", "failed", "blocked_all", "blocked", "dialogs", "downloads", "popups")
    faulty = F.when(browser, (F.greatest(*counts) > 0) | (F.size("page_errors") > 0) | (F.col("load_event") == "timeout") | (F.col("body_error") != "") | (F.col("error") != "")).otherwise((F.col("error") != "") | (F.col("error_kind") != ""))
    differs = F.when(usable & F.col("before").isNotNull(), F.struct(F.concat("before.name", F.lit("~"), "name").alias("pair"), _differing(F.col("before.f"), F.col("f")).alias("differences")))
    # the judged page: the human slot first, in the order of replicates, after its scripts ran where there is such a view
    dom_judged = browser & F.col("has_dom")
    clear = F.when(dom_judged, F.col("clear_dom")).otherwise(usable)
    rank = F.when(clear, F.struct((F.col("slot") != "human").alias("s"), F.col("replicate")))
    judged = F.struct(F.when(dom_judged, F.col("dom_rules")).otherwise(F.col("static_rules")).alias("static_rules"), F.when(dom_judged, F.col("dom_techniques")).otherwise(F.col("techniques")).alias("techniques"))
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    per_key = [F.min(F.when(usable & (F.col("slot") == s), F.col(f"f.{k}"))).alias(f"lo_{s}_{k}") for s in ("bot", "human") for k in COMPARED] + [F.max(F.when(usable & (F.col("slot") == s), F.col(f"f.{k}"))).alias(f"hi_{s}_{k}") for s in ("bot", "human") for k in COMPARED]
    out = n.groupBy(key).agg(
        _list(F.struct("name", "kind", "user_agent")).alias("clients"), _list(F.struct("name", "status")).alias("statuses"), F.count_distinct(F.when(answered, F.col("status"))).alias("codes"), F.sum(answered.cast("int")).alias("answers"), any_(browser).alias("has_browser"),
        _list(F.struct("name", "added", "removed", F.array("text_length", "dom_text_length").alias("text_lengths"), (~F.col("f.text_sha256").eqNullSafe(F.col("d.text_sha256"))).alias("text_changed"), F.array("f.title", "d.title").alias("titles")), rendered).alias("rendered"),
        _list(F.struct("name", F.lit(True).alias("browser"), *counts, F.slice("page_errors", 1, 3).alias("page_errors"), "load_event", "body_error", "error", "error_kind"), browser).alias("browser_errors"), _list(F.struct("name", "error", "error_kind"), ~browser).alias("plain_errors"), any_(faulty).alias("faulty"),
        _list(F.struct("name", "hops", "hosts", "cross_host")).alias("redirects"), any_((F.col("hops") >= 2) | F.col("cross_host")).alias("redirected"),
        _list(F.struct("name", F.col("url").alias("final_url"), "page_url", "client_navigations"), browser).alias("moves"), any_(browser & ((F.col("client_navigations") > 0) | ((F.col("page_url") != "") & (F.col("page_url") != F.col("url"))))).alias("moved"),
        _list(F.struct("name", F.array("early_text_length", "dom_text_length").alias("text_lengths"), F.col("after").alias("mechanisms_after")), early).alias("delays"), any_(early & ((F.size("after") > 0) | ((F.col("early_text_length") == 0) & (F.col("dom_text_length") > 0)))).alias("delayed"),
        _list(F.struct("name", (F.col("text_length") == 0).alias("document_text_empty"), F.col("length").alias("html_length"), F.when(browser, F.col("dom_text_length") == 0).alias("dom_text_empty")), answered).alias("blanks"), any_(answered & ((F.col("text_length") == 0) | (browser & (F.col("dom_text_length") == 0)))).alias("blank"),
        _list(F.struct("name", "status", "title", "dom_title"), answered).alias("titles"), any_(answered & (~F.col("status").between(200, 299) | odd("title") | odd("dom_title"))).alias("error_page"),
        _list(F.struct("access", "name", F.col("place").alias("access_index"), F.col("us").alias("observed_us"))).alias("accesses"), F.transform(_list(F.struct("access", "gap"), F.col("gap").isNotNull()), lambda g: g["gap"]).alias("gaps"), _list(differs).alias("sides"),
        _list(F.struct("nth", "name", "status", "mechanisms"), usable).alias("per_access"), F.max(F.when(first, only)).alias("only_first"), any_(first & status_first).alias("status_first"), F.max(F.when(first, F.col("name"))).alias("first_name"),
        F.min_by(judged, rank).alias("judged"), F.sum((usable & (F.col("slot") == "bot")).cast("int")).alias("bots"), F.sum((usable & (F.col("slot") == "human")).cast("int")).alias("humans"), F.max("replicate").alias("wanted"), *per_key,
    )
    every = (F.col("bots") == F.col("wanted")) & (F.col("humans") == F.col("wanted")) & (F.col("wanted") >= 2)
    steady = lambda k: (F.col(f"lo_bot_{k}") == F.col(f"hi_bot_{k}")) & (F.col(f"lo_human_{k}") == F.col(f"hi_human_{k}")) & (F.col(f"lo_bot_{k}") != F.col(f"lo_human_{k}"))
    return out.withColumn("systematic", F.array_compact(F.array(*[F.when(every & steady(k), F.lit(k)) for k in COMPARED]))).select(key, *[c for c in out.columns if c != key and not c.startswith(("lo_", "hi_"))], "systematic")


def _pairs(n: DataFrame, key: str) -> DataFrame:
    """One row per page: the usable observations of both slots side by side, one pair for each replicate."""
    own = F.struct("name", "f", "status", "text_length", "excerpt", "mechanisms", "inline", "external")
    pick = lambda s: F.any_value(F.when(F.col("usable") & (F.col("slot") == s), own), ignoreNulls=True).alias(s)
    both = n.groupBy(key, "replicate").agg(pick("bot"), pick("human")).filter("bot IS NOT NULL AND human IS NOT NULL")
    b, h = F.col("bot"), F.col("human")
    pair = F.concat(b["name"], F.lit("~"), h["name"])
    less = lambda x, y: F.array_sort(F.array_except(x, y))
    plain = lambda x, y: x["status"].between(200, 299) & (x["text_length"] > 0) & (F.size(x["mechanisms"]) == 0) & (F.size(y["mechanisms"]) > 0)
    case = lambda x, y: F.when(plain(x, y), F.struct(x["name"].alias("benign_looking"), y["name"].alias("with_mechanisms"), F.array_sort(y["mechanisms"]).alias("mechanisms"), F.array(x["f"]["title"], y["f"]["title"]).alias("titles")))
    scripts = F.struct(
        pair.alias("pair"), F.size(F.array_except(b["inline"], h["inline"])).alias("inline_only_bot"), F.size(F.array_except(h["inline"], b["inline"])).alias("inline_only_human"),
        F.slice(less(b["external"], h["external"]), 1, 10).alias("external_only_bot"), F.slice(less(h["external"], b["external"]), 1, 10).alias("external_only_human"),
    )
    text = F.struct(pair.alias("pair"), b["f"]["text_sha256"].eqNullSafe(h["f"]["text_sha256"]).alias("same_text"), F.array(b["text_length"], h["text_length"]).alias("text_lengths"), F.array(b["excerpt"], h["excerpt"]).alias("excerpts"))
    rows = both.select(key, "replicate", F.struct(pair.alias("pair"), _differing(b["f"], h["f"]).alias("differences")).alias("differ"), text.alias("text"), scripts.alias("scripts"), F.array_compact(F.array(case(b, h), case(h, b))).alias("cases"))
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("replicate", c))), lambda r: r[c])
    return rows.groupBy(key).agg(at("differ").alias("pairs"), at("text").alias("texts"), at("scripts").alias("scripts"), F.flatten(at("cases")).alias("decoys"))


def _variants(n: DataFrame, key: str, variants: DataFrame) -> DataFrame:
    """One row per page and changed client: against which usable controls it differs, and in what from all of them alike."""
    v = n.filter("variant IS NOT NULL").join(F.broadcast(variants), "variant")  # rows of a rule table, a handful
    view = lambda c: F.when(F.col(f"{c}view") == "dom", F.col(f"{c}d")).otherwise(F.col(f"{c}f"))
    v = v.select(key, "variant", "id", F.col("control").alias("slot"), F.col("usable").alias("v_usable"), "issues", "profile", "referer", "view", "f", "d", F.col("chain").alias("v_chain")).withColumn("v", view("")).drop("f", "d")
    c = n.filter("variant IS NULL").select(key, "slot", "name", "usable", F.col("f").alias("c_f"), F.col("d").alias("c_d"), "chain")
    met = v.join(c, [key, "slot"], "left").withColumn("c", F.when(F.col("view") == "dom", F.col("c_d")).otherwise(F.col("c_f"))).withColumn("usable", F.coalesce("usable", F.lit(False)))
    met = met.withColumn("differ", F.when(F.col("usable"), F.struct("name", _differing(F.col("c"), F.col("v"), VARIANT_KEYS).alias("keys"))))
    alike = [F.when((F.min(F.when(F.col("usable"), F.col(f"c.{k}"))) == F.max(F.when(F.col("usable"), F.col(f"c.{k}")))) & F.bool_and(F.when(F.col("usable"), F.col(f"c.{k}") != F.col(f"v.{k}"))), F.lit(k)) for k in VARIANT_KEYS]
    whole = F.struct("v_usable", "issues", "profile", "referer", "v_chain")
    out = met.groupBy(key, "id", "variant").agg(F.any_value(whole).alias("v"), F.array_sort(F.collect_list("differ")).alias("differences"), F.array_sort(F.collect_list(F.when(F.col("usable"), F.struct("name", "chain")))).alias("chains"), F.array_compact(F.array(*alike)).alias("keys"))
    measurable = F.col("v.v_usable") & (F.size("differences") > 0)
    evidence = F.struct(F.when(~measurable, F.col("v.issues")).alias("variant_issues"), F.col("v.profile").alias("variant_profile"), F.col("v.referer").alias("referer_sent"), F.col("v.v_chain").alias("variant_chain"), "chains", "differences", F.col("keys").alias("differs_from_all_controls"), F.lit(False).alias("replicated"))
    status = F.when(~measurable, "unmeasurable").when(F.size("keys") > 0, "observed").otherwise("not_observed")
    compared = F.when(measurable, F.concat(F.array(F.concat(F.lit("variant:"), "variant")), F.transform("differences", lambda d: d["name"]))).otherwise(nothing())
    return out.select(key, "id", F.struct(status.alias("status"), compared.alias("compared"), evidence.alias("evidence")).alias("signal"))


def signal_details(rows: DataFrame, variants: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page with a struct (category, status, compared, evidence) for each signal, named by its id.

    ``rows``: as of ``pairs.seen``, main observations and those of changed clients. ``variants``: rows as of ``variant_table``, one for
    each signal of a changed client. Defined cases: missing times give no gap; equal access indexes are ordered by name; a page
    without observations of the plan has no row; signals of changed clients that the page has not are not_tested.
    """
    n = narrow(rows, key)
    main = n.filter("variant IS NULL")
    p = _observations(main, key).join(_pairs(main, key), key, "left")
    told = _variants(n, key, variants)
    ids = [r["id"] for r in variants.select("id").distinct().orderBy("id").collect()]  # a rule table's
    p = p.join(told.groupBy(key).agg(*[F.any_value(F.when(F.col("id") == i, F.col("signal")), ignoreNulls=True).alias(f"v_{i}") for i in ids]), key, "left")
    has_pair = F.col("pairs").isNotNull()
    names = lambda rows, field="name": F.coalesce(F.transform(rows, lambda r: r[field]), nothing())
    status = lambda seen, measurable=F.lit(True), tested=F.lit(True): F.when(~tested, "not_tested").when(~measurable, "unmeasurable").when(seen, "observed").otherwise("not_observed")
    rules = F.coalesce("judged.static_rules", nothing())
    done = {
        "client_type_response_difference": (status(F.exists("pairs", lambda x: _some(x["differences"])) | (F.size("systematic") > 0), has_pair), F.coalesce(F.flatten(F.transform("pairs", lambda x: F.split(x["pair"], "~"))), nothing()), F.struct("clients", "pairs", "systematic")),
        "http_status_difference": (status(F.col("codes") > 1, F.col("answers") >= 2), F.when(F.col("answers") >= 2, names(F.col("statuses"))).otherwise(nothing()), F.col("statuses")),
        "visible_text_difference": (status(F.exists("texts", lambda x: ~x["same_text"]), has_pair), names(F.col("texts"), "pair"), F.struct(F.col("texts").alias("pairs"), F.array_contains("systematic", "text_sha256").alias("systematic"))),
        "js_modified_dom": (status(F.exists("rendered", lambda r: (F.size(r["added"]) > 0) | (F.size(r["removed"]) > 0) | r["text_changed"]), F.size("rendered") > 0, F.col("has_browser")), names(F.col("rendered")), F.col("rendered")),
        "script_inventory_difference": (status(F.exists("scripts", lambda x: (x["inline_only_bot"] > 0) | (x["inline_only_human"] > 0) | (F.size(x["external_only_bot"]) > 0) | (F.size(x["external_only_human"]) > 0)), has_pair), names(F.col("scripts"), "pair"), F.col("scripts")),
        "frontend_cloaking_code": (status(F.size(rules) > 0), F.array(F.lit("analysis_js")), F.struct(rules.alias("static_rules"), F.coalesce("judged.techniques", nothing()).alias("categories"))),
        "browser_errors": (status(F.col("faulty")), names(F.col("clients")), F.struct(_without(F.col("browser_errors"), "browser").alias("browsers"), F.col("plain_errors").alias("others"))),
        "multi_hop_redirect": (status(F.col("redirected")), names(F.col("redirects")), F.col("redirects")),
        "client_side_redirect": (status(F.col("moved"), tested=F.col("has_browser")), names(F.col("moves")), F.col("moves")),
        "delayed_content": (status(F.col("delayed"), tested=F.size("delays") > 0), names(F.col("delays")), F.col("delays")),
        "blank_page": (status(F.col("blank"), F.col("answers") > 0), names(F.col("blanks")), F.col("blanks")),
        "error_page": (status(F.col("error_page"), F.col("answers") > 0), names(F.col("titles")), F.col("titles")),
        "decoy_candidate": (status(F.size("decoys") > 0, has_pair), names(F.col("decoys"), "benign_looking"), F.coalesce("decoys", F.slice("decoys", 1, 0))),
        "repeat_instability": (status(F.exists("sides", lambda x: _some(x["differences"])), F.size("sides") > 0), names(F.col("sides"), "pair"), F.struct(_without(F.col("accesses"), "access").alias("accesses"), F.col("gaps").alias("gaps_sec"), F.col("sides").alias("within_side_differences"))),
        "first_access_only": (status((F.size("only_first") > 0) | F.col("status_first"), F.size("per_access") >= 2), F.when(F.size("per_access") >= 2, names(F.col("per_access"))).otherwise(nothing()), F.struct(F.col("first_name").alias("first"), F.coalesce("only_first", nothing()).alias("mechanisms_only_in_first_access"), F.col("status_first").alias("status_differs_only_in_first_access"), _without(F.col("per_access"), "nth").alias("per_access"))),
    }
    out = []
    for i, category in SIGNALS:
        if i in done:
            s, compared, evidence = done[i]
        elif i in ids:
            v = F.col(f"v_{i}")
            s, compared, evidence = F.coalesce(v["status"], F.lit("not_tested")), F.coalesce(v["compared"], nothing()), v["evidence"]
        else:
            s, compared, evidence = F.lit("not_tested"), nothing(), F.lit(None).cast("string")
        out.append(F.struct(F.lit(category).alias("category"), s.alias("status"), compared.alias("compared"), evidence.alias("evidence")).alias(i))
    return p.select(key, *out)


def detail_rows(details: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page and signal: place, id, category, status, compared and the evidence as JSON (null if nothing was tested)."""
    row = lambda place, i: F.struct(F.lit(place).alias("place"), F.lit(i).alias("id"), F.col(f"{i}.category").alias("category"), F.col(f"{i}.status").alias("status"), F.col(f"{i}.compared").alias("compared"), F.to_json(F.struct(F.col(f"{i}.evidence").alias("e")), {"ignoreNullFields": "false"}).alias("evidence"))
    return details.select(key, F.explode(F.array(*[row(place, i) for place, (i, _) in enumerate(SIGNALS)])).alias("s")).select(key, "s.*")
