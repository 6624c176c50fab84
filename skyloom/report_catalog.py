"""Queries of signals, verdicts, result rows, reports, texts and batches, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as B
from .functions import catalogue as C
from .functions import scripts as D
from .functions import records as T
from .functions import text as X
from .functions.urls import origin, url_hash
from .operators import pairs as P
from .operators import reports as R
from .operators import results as W
from .operators import signals as S
from .operators import verdicts as V
from .plans import observations as O
from .plans import results as fixture
from .sources import batches as Q
from .sources import feeds

_bar = lambda c, name=None: F.array_join(c, "|").alias(name or c)


def _judged(spark, d):
    """Judged pages with the columns of their source."""
    return B.judged(spark, d).withColumns({"source_class": F.when(F.col("page_id") % 2 == 0, "benign").otherwise("phishing"), "source_label": F.concat(F.lit("feed"), (F.col("page_id") % 3).cast("string"))})


def phishing_verdict(spark, d):
    pairs = V.classify(V.choose_page(P.pair_table(B.seen(spark, d, P.brief(P.VERDICT_FACTS)))), F.col("page.facts.obfuscated"))
    return pairs.select("page_id", F.col("page.name").alias("page"), F.col("page.view").alias("view"), _bar("page.issues", "issues"), "rule_verdict", "verdict", "verdict_reason", "verdict_basis", _bar("verdict_caveats", "caveats"), "confidence", V.alive(pairs).alias("alive"))


def signal_table(spark, d):
    return S.signal_rows(B.signalled(spark, d)).select("page_id", "place", "id", "category", "status", "evidence")


def signals_summary(spark, d):
    return B.signalled(spark, d).select("page_id", _bar("observed"), _bar("not_tested"), _bar("variant_differences"))


#: Result columns that are compared; the others are constants, JSON text or follow from these.
_RESULT = ("url", "label", "alive", "is_phishing", "cloaking", "phishing_confidence", "cloaking_fired", "cloaking_tier", "dynamic_reliability", "human_mechanisms", "human_high_spec", "bot_channel_blocked", "bot_status_code", "human_status_code", "bot_html_length", "human_html_length", "bot_error", "human_error", "bot_mechanisms", "hidden_from_bot", "bot_is_phishing", "human_is_phishing", "reverse_diff", "rule_fired_raw", "crawl_order", "error_count", "source_label", "phishing_verdict", "cloaking_label", "rule_phishing_verdict", "rule_cloaking_label", "phishing_basis", "cloaking_signals", "cloaking_signals_not_tested", "observation_plan", "status")


def result_row(spark, d):
    return W.result_rows(_judged(spark, d)).select(*_RESULT)


def structural_divergence(spark, d):
    p = P.pair_table(B.seen(spark, d))
    return p.select("page_id", _bar(X.structural_divergence(*[P.fact(n, k) for k in ("form_hosts", "script_hosts") for n in ("bot#1", "human#1")]), "reasons"))


def blind_pair(spark, d):
    return W.blind_pairs(P.pair_table(P.listed(O.observations(spark, d)))).select("url", "bot_status", "human_status", "crawl_order", "pair_mode")


def html_summary(spark, d):
    """Title, text, scripts and gates of every observation's server document."""
    o = O.observations(spark, d).select("page_id", "slot", "replicate", "url", "html")
    inline = T.script_inventory(T.first_scripts(T.inline_scripts(F.col("html"))))
    return o.select("page_id", "slot", "replicate", T.title(F.col("html")).alias("title"), F.sha2(T.visible_text(F.col("html")), 256).alias("text_sha256"), _bar(F.transform(inline, lambda s: F.concat(F.substring(s["sha256"], 1, 12), F.lit(":"), s["length"].cast("string"))), "inline"), _bar(T.external_scripts(F.col("html"), F.col("url")), "external"))


#: Snippets with gates, one after each page in turn.
_GATE_SNIPPETS = ("", '<script src="https://www.google.com/recaptcha/api.js"></script>', "<title>Just a moment...</title>", "<p>Checking your browser</p>", "<script>Notification.requestPermission()</script>", "<a onclick=\"confirm('x')\">x</a>", "<a onclick='el.style.display=\"block\"'>x</a>", "<p>Click here to continue</p><noscript>please enable cookies</noscript>")


def gate_detection(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat("html", F.element_at(F.array(*map(F.lit, _GATE_SNIPPETS)), (F.col("page_id") % len(_GATE_SNIPPETS) + 1).cast("int"))).alias("html"))
    return pages.select("page_id", _bar(T.gates(F.col("html")), "gates"))


def audit_view(spark, d):
    o = W.audit_view(O.observations(spark, d).select("page_id", "slot", "replicate", "html", "dom_html", "early_html"))
    return o.select("page_id", "slot", "replicate", F.sha2("text_excerpt", 256).alias("excerpt"), F.sha2("dom_text_excerpt", 256).alias("dom_excerpt"), "html_sha256", "html_length")


def text_simhash(spark, d):
    """The simhash of each page's visible text."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.visible_text(F.col("html")).alias("text"))
    return X.simhash(pages, "page_id", "text")


def text_similarity(spark, d):
    """Each page's visible text against the next page's."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.visible_text(F.col("html")).alias("text"))
    # a pair takes milliseconds and few bytes: as many tasks as there are shuffle partitions, not as many as the bytes fill
    dealt = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    pairs = dealt(pages.toDF("page_id", "a")).join(dealt(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("text").alias("b"))), "page_id")
    return X.similarity(pairs, "page_id", "a", "b").select("page_id", F.round("similarity", 9).alias("similarity"))


#: Scripts in some disguise, one for each page in turn.
_SCRIPTS = ("var a = 'x' + 'y';", "eval(atob('YWxlcnQoMSk='));", "var s = '\\x68\\x69 \\u0041';", "var _0xab = ['log', 'hi'];\nfunction _0xcd(i){ return _0xab[i]; }\nconsole[_0xcd(0x0)](_0xcd(0x1));", "[]+[]![]+(![]+[])[+[]]", "$=~[];x", "function readable(argument) { return argument; }", "")


def _scripts(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("page_id") % len(_SCRIPTS) + 1).cast("int")).alias("script"))


def obfuscation_score(spark, d):
    return _scripts(spark, d).select("page_id", F.round(X.obfuscation_score(F.col("script")), 9).alias("score"), X.is_symbol_encoded(F.col("script")).alias("symbol_encoded"))


def deobfuscated_scripts(spark, d):
    return D.deobfuscate(_scripts(spark, d)).select("page_id", "deobfuscated", F.round("score_after", 9).alias("score_after"), "changed")


_TYPES = ("text/html; charset=utf-8", "", "application/pdf", " Application/JSON", "image/png", "application/xhtml+xml;x")
_ERRORS = ("", "Timeout 90000ms exceeded", "net::ERR_NAME_NOT_RESOLVED", "net::ERR_CERT_DATE_INVALID", "net::ERR_HTTP2_PROTOCOL_ERROR", "request_outside_scope", "Download is starting", "net::ERR_EMPTY_RESPONSE", "boom")
_REQUESTS = (("GET", "script", False, 3), ("POST", "xhr", False, 1), ("GET", "ping", False, 1), ("GET", "document", True, 1), ("GET", "image", False, 300), ("HEAD", "font", False, 2))


def _nth(values, by: str = "page_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def response_kinds(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", _nth(_TYPES).alias("t"), _nth(_ERRORS).alias("e"), F.create_map(F.lit("Content-Type"), _nth(_TYPES), F.lit("X-Id"), F.col("page_id").cast("string")).alias("h"))
    return p.select("page_id", T.is_document_type(F.col("t")).alias("is_document"), T.error_kind(F.col("e")).alias("error_kind"), T.header(F.col("h"), "content-type").alias("content_type"), T.header(F.col("h"), "referer").alias("referer"))


def request_policy(spark, d):
    requests = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(m).alias("method"), F.lit(k).alias("kind"), F.lit(s).alias("sub"), F.lit(c).alias("count")) for i, (m, k, s, c) in enumerate(_REQUESTS)]))
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", (F.col("page_id") % 4 != 0).alias("permitted"), requests.alias("q")).select("page_id", "permitted", "q.*")
    p = p.withColumn("reason", T.block_reason(F.col("method"), F.col("kind"), F.col("sub"), F.col("count"), F.lit(200), F.col("permitted")))
    return p.select("page_id", "n", "reason", T.content_affecting(F.col("kind"), F.col("reason"), F.col("sub")).alias("affects"))


def url_origin(spark, d):
    return B._variants(spark, d).select("page_id", "variant", origin(F.col("url")).alias("origin"))


def observation_plan(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", O.describe_plan(F.col("url"), ("mobile", "referer")).alias("plan"))


def feed_accepted(spark, d):
    """The first 300 accepted addresses of a feed."""
    return feeds.accepted(feeds.classify(B.feed_lines(spark, d)), source="test", source_label="threat").select("url", "raw_url", "line", "label", "source", "source_label")


def feed_rejected(spark, d):
    return feeds.rejected(feeds.classify(B.feed_lines(spark, d))).groupBy("reason").agg(F.count("*").alias("n"))


def _dataset(spark, d):
    """A labelled list of addresses: some hosts repeat, some rows are of no use."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select(F.col("page_id").alias("place"), F.when(F.col("page_id") % 7 == 0, "benign").otherwise("phishing").alias("class_label"), _nth((*Q.BUCKETS, "gone")).alias("reachability_class"), F.concat(F.lit(" "), "url").alias("url_normalized"), F.when(F.col("page_id") % 11 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("page_id") % 40).cast("string"))).alias("host"))


def candidate_urls(spark, d):
    return Q.candidates(_dataset(spark, d), 30)


def candidate_buckets(spark, d):
    return Q.bucket_sizes(_dataset(spark, d))


def reputation(spark, d):
    vendors = F.explode(F.array(*[F.struct(F.lit(v).alias("vendor"), _nth(words).alias("verdict")) for v, words in (("gsb", ("clean", "clean", "malicious", "error")), ("virustotal", ("unknown", "clean", "clean")), ("urlscan", ("unknown", "suspicious", "unknown", "unknown", "clean")))]))
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", vendors.alias("v")).select("page_id", "v.vendor", "v.verdict", F.lit("").alias("detail"))
    return Q.reputation(p, "page_id").select("page_id", "overall", _bar("hits"))


def cohort_distribution(spark, d):
    return R.distributions(R.check_versions(fixture.results(spark, d)))


def verdict_crosstab(spark, d):
    r = fixture.results(spark, d)
    return R.crosstab(r, "rule_cloaking_label", "cloaking_label").withColumn("kind", F.lit("final")).unionByName(R.crosstab(r, "rule_cloaking_label", "llm_cloaking_assessment").withColumn("kind", F.lit("model")))


def top_reasons(spark, d):
    return R.top_reasons(fixture.results(spark, d))


def signal_counts(spark, d):
    return R.signal_counts(fixture.results(spark, d))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def group_report(spark, d):
    return _rounded(R.group_report(fixture.results(spark, d), "source_label"), "alive_rate", "lower", "upper", "conditional", "raw_rate")


def blind_spot(spark, d):
    return R.blind_spot(fixture.results(spark, d))


_COMPARED = ("measure", "k_a", "n_a", "rate_a", "lo_a", "hi_a", "k_b", "n_b", "rate_b", "lo_b", "hi_b", "z", "higher")


def _compared(df):
    return _rounded(df, "rate_a", "lo_a", "hi_a", "rate_b", "lo_b", "hi_b", "z").select(*_COMPARED)


def channel_differential(spark, d):
    return _compared(R.channel_differential(fixture.results(spark, d)))


def single_end_ablation(spark, d):
    return _compared(R.single_end_ablation(fixture.results(spark, d)))


def direction_skew(spark, d):
    return _rounded(R.direction_skew(fixture.results(spark, d)), "skew")


def crawl_order_report(spark, d):
    return _compared(R.crawl_order_report(fixture.results(spark, d)))


def baseline_compare(spark, d):
    """A batch against one whose rules fire on every fifth page only."""
    r = fixture.results(spark, d)
    return _compared(R.baseline_compare(r, r.withColumn("rule_fired_raw", F.when(F.col("page_id") % 5 == 0, "True").otherwise("False"))))


def reverse_diff_top(spark, d):
    return R.reverse_diff_report(fixture.results(spark, d))


def fired_rules(spark, d):
    return R.fired_rules(fixture.results(spark, d))


def console_summary(spark, d):
    return R.console_summary(fixture.results(spark, d))


def _scored(spark, d):
    return R.scored_annotations(fixture.annotations(spark, d), fixture.results(spark, d), url_hash(F.col("url")))


def annotation_scores(spark, d):
    return _rounded(R.annotation_scores(_scored(spark, d)), "rate", "lo", "hi")


def precision_by_rule(spark, d):
    return _rounded(R.precision_by_rule(_scored(spark, d)), "rate", "lo", "hi")


def annotator_pairs(spark, d):
    return _rounded(R.annotator_pairs(fixture.annotations(spark, d)), "po", "pe", "kappa")


def stratified_sample(spark, d):
    r = fixture.results(spark, d)
    return R.stratified_sample(r, 20, 10, "seed", r.filter("page_id % 6 <> 0"))


QUERIES = {
    f.__name__: f
    for f in (
        phishing_verdict, signal_table, signals_summary, result_row, structural_divergence, blind_pair, html_summary, gate_detection, audit_view, text_simhash, text_similarity, obfuscation_score, deobfuscated_scripts, response_kinds, request_policy, url_origin, observation_plan, feed_accepted, feed_rejected, candidate_urls,
        candidate_buckets, reputation, cohort_distribution, verdict_crosstab, top_reasons, signal_counts, group_report, blind_spot, channel_differential, single_end_ablation, direction_skew, crawl_order_report, baseline_compare, reverse_diff_top, fired_rules, console_summary, annotation_scores, precision_by_rule, annotator_pairs, stratified_sample,
    )
}

_q, _list, _in, _some, _within, _except = B._q, B._list, B._in, B._some, B._within, B._except
_VERDICT = f"""
ver AS (SELECT *, {_within("page_issues", _in(C.BLOCKING))} AS shut, {_within("page_issues", _in(C.CAVEATS))} AS caveats, CASE WHEN page_obfuscated > 0 THEN least(0.9::DOUBLE, page_score + least(0.15::DOUBLE, page_obfuscated * 0.05::DOUBLE)) ELSE page_score END AS raised FROM res),
un AS (SELECT *, page_length = 0 OR len(shut) > 0 AS unread, len(page_decisive) > 0 OR raised >= 0.45::DOUBLE AS positive FROM ver)"""
_BASIS = lambda score, positive: f"CASE WHEN unread THEN 'no_readable_document' WHEN len(page_decisive) > 0 THEN 'layer1:' || array_to_string(page_decisive, ',') ELSE 'layer2_score=' || printf('%.3f', {score}) || CASE WHEN {positive} THEN '>=' ELSE '<' END || '0.45' END"
_SAID = lambda positive: f"CASE WHEN unread THEN 'unknown' WHEN {positive} THEN 'phishing' WHEN len(caveats) > 0 THEN 'unknown' ELSE 'not_detected' END"
_ALIVE = "greatest(b1.status, b2.status, h1.status, h2.status) > 0"
_NAMES = (("b1", "bot#1"), ("b2", "bot#2"), ("h1", "human#1"), ("h2", "human#2"))
_ok = lambda n: f"NOT list_has_any({n}.issues, {_in(C.BLOCKING)})"
_or = lambda conditions: "(" + " OR ".join(f"coalesce({c}, false)" for c in conditions) + ")"
_PAIRED = lambda what: _or(f"({_ok(a)} AND {_ok(b)} AND ({what(a, b)}))" for a, b in B._HALF)
_THERE = _or(f"({_ok(a)} AND {_ok(b)})" for a, b in B._HALF)
_differ = lambda a, b, keys: _or(f"NOT ({B._same(a, b, k)})" for k in keys)
_state = lambda seen, there="true", tested="true": f"CASE WHEN NOT ({tested}) THEN 'not_tested' WHEN NOT ({there}) THEN 'unmeasurable' WHEN {seen} THEN 'observed' ELSE 'not_observed' END"
_dm = lambda n: f"coalesce({n}d.mechanisms, [])"
_apart = lambda x, y: f"(len({_except(x, y)}) > 0 OR len({_except(y, x)}) > 0)"
_ext = lambda n: f"list_transform({n}.external, lambda u: regexp_extract(u, '^([^?]*)', 1))"
_hostsof = lambda n: f"list_distinct(list_filter(list_transform({n}.chain, lambda u: lower(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))), lambda h: h <> ''))"
_plain = lambda a, b: f"({a}.status BETWEEN 200 AND 299 AND {a}.text <> '' AND len({a}.mechanisms) = 0 AND len({b}.mechanisms) > 0)"
_CODES = "list_filter([b1.status, b2.status, h1.status, h2.status], lambda x: x <> 0)"
_ALL_OK = " AND ".join(_ok(n) for n, _ in _NAMES)
_ORDERED = f"list_sort(list_filter({_list(f'CASE WHEN {_ok(n)} THEN {{i: {n}.access_index, n: {_q(name)}, m: {n}.mechanisms, s: {n}.status}} END' for n, name in _NAMES)}, lambda x: x IS NOT NULL))"
_TIMES = "list_sort([" + ", ".join(f"{{i: {n}.access_index, t: {n}.at_ms}}" for n, _ in _NAMES) + "])"
_error_title = lambda n: f"(regexp_matches({n}.low_title, {_q('(?i)' + C.ERROR_TITLE)}) OR regexp_matches(lower(coalesce({n}d.title, '')), {_q('(?i)' + C.ERROR_TITLE)}))"
_BROWSERS = ("h1", "h2")
_SIGNALS = [
    ("client_type_response_difference", "ua_browser_type", _state(f"({_PAIRED(lambda a, b: _differ(a, b, S.MEANINGFUL))} OR len(by_key) > 0)", _THERE), "array_to_string(by_key, ',')"),
    ("referer_presence_effect", "referer", "referer", "array_to_string(referer_keys, ',')"), ("desktop_mobile_difference", "device", "mobile", "array_to_string(mobile_keys, ',')"),
    ("http_status_difference", "status_text_dom_js_errors", _state(f"len(list_distinct({_CODES})) > 1", f"len({_CODES}) >= 2"), " || ',' || ".join(f"'{name}=' || {n}.status" for n, name in _NAMES)),
    ("visible_text_difference", "status_text_dom_js_errors", _state(_PAIRED(lambda a, b: _differ(a, b, ("text_sha256",))), _THERE), " || ',' || ".join(f"'{name}=' || length({n}.text)" for n, name in _NAMES)),
    ("js_modified_dom", "status_text_dom_js_errors", _state(_or(f"({_ok(n)} AND coalesce({n}d.html, '') <> '' AND (len(added_{n}) > 0 OR len({_except(f'{n}.mechanisms', _dm(n))}) > 0 OR {n}.lower_text IS DISTINCT FROM {n}d.lower_text))" for n in _BROWSERS), _or(f"({_ok(n)} AND coalesce({n}d.html, '') <> '')" for n in _BROWSERS)), "array_to_string(list_sort(list_distinct(list_concat(added_h1, added_h2))), ',')"),
    ("script_inventory_difference", "status_text_dom_js_errors", _state(_PAIRED(lambda a, b: f"{_apart(f'{a}.inline', f'{b}.inline')} OR {_apart(_ext(a), _ext(b))}"), _THERE), "''"),
    ("frontend_cloaking_code", "status_text_dom_js_errors", "CASE WHEN len(static_rules) > 0 THEN 'observed' ELSE 'not_observed' END", "array_to_string(static_rules, ',')"),
    ("browser_errors", "status_text_dom_js_errors", _state(_or(f"({n}.error <> '' OR ({n}.kind = 'browser' AND ({n}.stopped OR {n}.failed OR {n}.body_error <> '')))" for n, _ in _NAMES)), " || ',' || ".join(f"{n}.error" for n, _ in _NAMES)),
    ("multi_hop_redirect", "redirect_delay_blank_decoy", _state(_or(f"(greatest(len({n}.chain) - 1, 0) >= 2 OR len({_hostsof(n)}) > 1)" for n, _ in _NAMES)), " || ',' || ".join(f"'{name}=' || greatest(len({n}.chain) - 1, 0)" for n, name in _NAMES)),
    ("client_side_redirect", "redirect_delay_blank_decoy", _state(_or(f"({n}.client_navigations > 0 OR (coalesce({n}.page_url, '') <> '' AND {n}.page_url <> {n}.final))" for n in _BROWSERS)), "''"),
    ("delayed_content", "redirect_delay_blank_decoy", _state(_or(f"({n}e.page_id IS NOT NULL AND (len(late_{n}) > 0 OR (length(coalesce({n}e.text, '')) = 0 AND length(coalesce({n}d.text, '')) > 0)))" for n in _BROWSERS), "true", _or(f"{n}e.page_id IS NOT NULL" for n in _BROWSERS)), "array_to_string(list_sort(list_distinct(list_concat(late_h1, late_h2))), ',')"),
    ("blank_page", "redirect_delay_blank_decoy", _state(_or(f"({n}.status <> 0 AND ({n}.text = ''{f' OR coalesce({n}d.text, {_q('')}) = {_q('')}' if n in _BROWSERS else ''}))" for n, _ in _NAMES), f"len({_CODES}) > 0"), "''"),
    ("error_page", "redirect_delay_blank_decoy", _state(_or(f"({n}.status <> 0 AND (NOT {n}.status BETWEEN 200 AND 299 OR {_error_title(n) if n in _BROWSERS else f'regexp_matches({n}.low_title, {_q('(?i)' + C.ERROR_TITLE)})'}))" for n, _ in _NAMES), f"len({_CODES}) > 0"), "''"),
    ("decoy_candidate", "redirect_delay_blank_decoy", _state(_PAIRED(lambda a, b: f"{_plain(a, b)} OR {_plain(b, a)}"), _THERE), f"array_to_string({_some((dict(_NAMES)[x], f'{_ok(a)} AND {_ok(b)} AND {_plain(x, y)}') for a, b in B._HALF for x, y in ((a, b), (b, a)))}, ',')"),
    ("repeat_instability", "repeat_observation", _state(_or(f"({_ok(f'{x}1')} AND {_ok(f'{x}2')} AND {_differ(f'{x}1', f'{x}2', S.MEANINGFUL)})" for x in "bh"), _or(f"({_ok(f'{x}1')} AND {_ok(f'{x}2')})" for x in "bh")), "array_to_string(list_transform(list_filter([times[2].t - times[1].t, times[3].t - times[2].t, times[4].t - times[3].t], lambda g: g IS NOT NULL), lambda g: printf('%.3f', round(g / 1000.0, 3))), ',')"),
    ("first_access_only", "repeat_observation", _state("(len(only_first) > 0 OR status_first)", "len(ordered) >= 2"), "array_to_string(only_first, ',')"),
]
_SIG = f"""
sg0 AS (SELECT *, {_except(_dm("h1"), "h1.mechanisms")} AS added_h1, {_except(_dm("h2"), "h2.mechanisms")} AS added_h2, {_except(_dm("h1"), "coalesce(h1e.mechanisms, [])")} AS late_h1, {_except(_dm("h2"), "coalesce(h2e.mechanisms, [])")} AS late_h2, {_TIMES} AS times, {_ORDERED} AS ordered,
    CASE WHEN {_ALL_OK} THEN {_some((k, B._systematic(k)) for k in S.COMPARED)} ELSE [] END AS by_key FROM res),
sg1 AS (SELECT *, CASE WHEN len(ordered) > 0 THEN list_sort({_except("ordered[1].m", "flatten(list_transform(ordered[2:], lambda x: x.m))")}) ELSE [] END AS only_first, coalesce(len(list_distinct(list_transform(ordered[2:], lambda x: x.s))) = 1 AND NOT list_contains(list_transform(ordered[2:], lambda x: x.s), ordered[1].s), false) AS status_first FROM sg0),
sg AS (SELECT *, {_list(f"{{id: '{i}', category: '{c}', status: {s}, evidence: {e}}}" for i, c, s, e in _SIGNALS)} AS signals FROM sg1),
sig AS MATERIALIZED (SELECT *, array_to_string(list_transform(list_filter(signals, lambda x: x.status = 'observed'), lambda x: x.id), '|') AS observed, array_to_string(list_transform(list_filter(signals, lambda x: x.status = 'not_tested'), lambda x: x.id), '|') AS not_tested FROM sg)"""
_bars = lambda *columns: ", ".join(f"array_to_string({c}, '|') AS {n}" for c, n in columns)
_text = lambda c: f"CASE WHEN {c} THEN 'True' WHEN NOT ({c}) THEN 'False' ELSE '' END"
_PLAN = "CASE WHEN substr(sha1({u}), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 'human_first:H1,B1,H2,B2' ELSE 'bot_first:B1,H1,B2,H2' END || ';variants={v}'"
_tri = lambda c: f"CASE {c} WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE 'N/A' END"
_phi = lambda c: f"CASE {c} WHEN 'phishing' THEN 'True' WHEN 'not_detected' THEN 'False' ELSE 'N/A' END"
_ROW = f"""SELECT asked AS url, CASE WHEN page_id % 2 = 0 THEN 'benign' ELSE 'phishing' END AS label, CASE WHEN {_ALIVE} THEN 'True' ELSE '' END AS alive, {_phi(_SAID("positive"))} AS is_phishing, {_tri("label")} AS cloaking,
    printf('%.3f', round(CASE WHEN unread THEN 0.0::DOUBLE WHEN len(page_decisive) > 0 THEN 0.95::DOUBLE ELSE raised END, 3)) AS phishing_confidence, {_bars(("fired1", "cloaking_fired"))}, CASE WHEN label = 'true' THEN 'CONFIRMED' WHEN rule_label = 'true' OR len(static_rules) > 0 THEN 'SUSPECTED' ELSE 'AMBIGUOUS' END AS cloaking_tier,
    CASE WHEN label IN ('true', 'false') THEN 'HIGH' ELSE 'LOW' END AS dynamic_reliability, {_bars(("h1.mechanisms", "human_mechanisms"), ("list_sort(specific)", "human_high_spec"), ("b1.mechanisms", "bot_mechanisms"), ("hidden1", "hidden_from_bot"), ("rev1", "reverse_diff"))}, {_text("blocked1")} AS bot_channel_blocked,
    CAST(b1.status AS VARCHAR) AS bot_status_code, CAST(h1.status AS VARCHAR) AS human_status_code, CAST(length(b1.html) AS VARCHAR) AS bot_html_length, CAST(length(h1.html) AS VARCHAR) AS human_html_length, b1.error AS bot_error, h1.error AS human_error, {_text("b1.is_phishing")} AS bot_is_phishing, {_text("h1.is_phishing")} AS human_is_phishing,
    {_text("len(fired1) > 0")} AS rule_fired_raw, regexp_extract({_PLAN.format(u="asked", v="")}, '^([^:]*)', 1) AS crawl_order, CAST({" + ".join(f"CASE WHEN {n}.error <> '' THEN 1 ELSE 0 END" for n, _ in _NAMES)} AS VARCHAR) AS error_count, 'feed' || page_id % 3 AS source_label, {_SAID("positive")} AS phishing_verdict, label AS cloaking_label,
    CASE WHEN unread THEN 'not_run' WHEN positive THEN 'phishing' ELSE 'not_detected' END AS rule_phishing_verdict, rule_label AS rule_cloaking_label, {_BASIS("raised", "positive")} AS phishing_basis, observed AS cloaking_signals, not_tested AS cloaking_signals_not_tested, {_PLAN.format(u="asked", v="")} AS observation_plan, CASE WHEN {_ALIVE} THEN 'response' ELSE 'no_response' END AS status FROM un"""
_case = lambda n, values, by="page_id": f"CASE ({by}) % {n} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values[:-1])) + f" ELSE {_q(values[-1])} END"
_FIX = f"""
f0 AS (SELECT page_id, url || '#' || page_id AS url FROM pages),
f1 AS (SELECT *, {_case(3, ("true", "false", "unknown"), "page_id // 3")} AS cloaking_label, {_case(5, ("phishing", "phishing", "not_detected", "not_detected", "unknown"))} AS phishing_verdict FROM f0),
r AS (SELECT *, {_case(2, ("benign", "phishing"))} AS label, 'feed' || page_id % 3 AS source_label, CASE page_id % 10 WHEN 9 THEN '' WHEN 8 THEN 'False' ELSE 'True' END AS alive, {_tri("cloaking_label")} AS cloaking, {_case(4, ("true", "true", "false", "unknown"))} AS rule_cloaking_label, {_phi("phishing_verdict")} AS is_phishing,
    {_case(5, ("phishing", "phishing", "not_detected", "not_detected", "not_run"))} AS rule_phishing_verdict, {_case(7, ("not_run", "unavailable", "unavailable", "phishing"))} AS llm_phishing_assessment, {_case(7, ("not_run", "unavailable", "unavailable", "supports_cloaking"))} AS llm_cloaking_assessment, {_case(4, ("True", "True", "False", ""))} AS rule_fired_raw,
    {_case(6, ("", "cred_form", "cred_form|webhook_exfiltration"))} AS human_mechanisms, {_case(3, ("cred_form", ""))} AS bot_mechanisms, {_case(4, ("webhook_exfiltration", ""))} AS hidden_from_bot, {_case(9, ("cred_form|anti_analysis", "anti_analysis", ""))} AS reverse_diff, {_case(8, ("True", "False"))} AS bot_channel_blocked,
    {_case(11, ("0", "100"))} AS bot_html_length, '200' AS human_html_length, {_case(22, ("reset", ""))} AS bot_error, {_case(13, ("timeout", ""))} AS human_error, {_case(6, ("True", "True", "False"))} AS bot_is_phishing, {_case(6, ("True", "True", "True", "False"))} AS human_is_phishing, {_case(4, ("C1|C5", "C2", ""))} AS cloaking_fired,
    {_case(3, ("blank_page|error_page", "error_page", ""))} AS cloaking_signals, CASE WHEN substr(sha1(url), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 'human_first' ELSE 'bot_first' END AS crawl_order, {_case(4, fixture.REASONS)} AS uncertainty_reasons FROM f1),
an AS (SELECT *, {_case(3, ("yes", "no", "unsure"), "page_id // 5 + turn * (page_id % 2)")} AS said, page_id * 3 + turn AS place FROM (SELECT page_id, substr(sha1(url || '#' || page_id), 1, 12) AS h, annotator, turn FROM pages CROSS JOIN (VALUES ('ann', 0), ('bob', 1), ('bob', 2)) t(annotator, turn)) WHERE CASE turn WHEN 0 THEN page_id % 3 <> 0 WHEN 1 THEN page_id % 4 <> 0 ELSE page_id % 8 = 1 END),
sc AS (SELECT r.cloaking, r.cloaking_fired, a.said FROM r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY place) AS k FROM an) WHERE k = 1) a ON a.h = substr(sha1(r.url), 1, 12))"""
_lohi = lambda k, n: f"round(CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, {B._W.format(sign='-')}) END, 9) AS lo, round(CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0, {B._W.format(sign='+')}) END, 9) AS hi"
_RATES = "rt AS (SELECT *, k AS t FROM ks), rs AS (SELECT * EXCLUDE (t), round(k / nullif(n, 0)::DOUBLE, 9) AS rate, " + _lohi("k", "n") + " FROM rt)"
_two = lambda a, b: f""", {_RATES}, cp AS (SELECT a.measure, a.k AS k_a, a.n AS n_a, a.rate AS rate_a, a.lo AS lo_a, a.hi AS hi_a, b.k AS k_b, b.n AS n_b, b.rate AS rate_b, b.lo AS lo_b, b.hi AS hi_b, (a.k + b.k) / (a.n + b.n)::DOUBLE AS p FROM rs a JOIN rs b ON a.measure = b.measure AND a.grp = '{a}' AND b.grp = '{b}'),
    ce AS (SELECT *, sqrt(p * (1 - p) * (1 / n_a::DOUBLE + 1 / n_b::DOUBLE)) AS se FROM cp) SELECT measure, k_a, n_a, rate_a, lo_a, hi_a, k_b, n_b, rate_b, lo_b, hi_b, round(CASE WHEN se = 0 THEN 0.0 ELSE (k_b / n_b::DOUBLE - k_a / n_a::DOUBLE) / se END, 9) AS z, k_b / n_b::DOUBLE > k_a / n_a::DOUBLE AS higher FROM ce"""  # noqa: E731
_hits = lambda measures: "ks AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, label AS grp, count(*) FILTER ({c}) AS k, count(*) AS n FROM r WHERE alive = 'True' GROUP BY label" for m, c in measures.items()) + ")"
_fires = lambda by, rows="r": f"ks AS (SELECT 'rule_fired_raw' AS measure, {by} AS grp, count(*) FILTER (rule_fired_raw = 'True') AS k, count(*) AS n FROM {rows} WHERE alive = 'True' AND rule_fired_raw <> '' GROUP BY {by})"
_entries = lambda column: f"unnest(list_filter(string_split({column}, '|'), lambda x: x <> ''))"
_FEED_OK = "SELECT normalized AS url, url AS raw_url, line, 'phishing' AS label, 'test' AS source, 'threat' AS source_label FROM d WHERE reason IS NULL ORDER BY line LIMIT 300"
_elt = lambda values, by="page_id": f"{_list(map(_q, values))}[{by} % {len(values)} + 1]"
_DATASET = f"ds AS (SELECT page_id AS place, CASE WHEN page_id % 7 = 0 THEN 'benign' ELSE 'phishing' END AS class_label, {_elt((*Q.BUCKETS, 'gone'))} AS rc, ' ' || url AS u, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'h' || page_id % 40 END AS host FROM pages), cd AS (SELECT trim(u) AS url, host, rc AS reachability_class, place, list_position({_in(Q.BUCKETS)}, rc) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS k FROM ds WHERE class_label = 'phishing' AND list_position({_in(Q.BUCKETS)}, rc) > 0 AND starts_with(trim(u), 'http') AND host <> '') WHERE k = 1)"
_bare = "regexp_replace(s, '\\s', '', 'g')"
_packed = f"coalesce(length(regexp_replace({_bare}, '[^\\[\\]!+()]', '', 'g')) / nullif(length({_bare}), 0)::DOUBLE, 0.0)"
SQL = {
    "phishing_verdict": B.CHAIN + f", {_VERDICT} SELECT page_id, page_name AS page, page_view AS view, {_bars(('page_issues', 'issues'))}, CASE WHEN unread THEN 'not_run' WHEN positive THEN 'phishing' ELSE 'not_detected' END AS rule_verdict, {_SAID('positive')} AS verdict, CASE WHEN unread THEN CASE WHEN len(shut) > 0 THEN array_to_string(shut, ';') ELSE 'unreadable_content' END WHEN positive THEN 'rules_positive' WHEN len(caveats) > 0 THEN array_to_string(caveats, ';') ELSE 'no_rule_threshold_met' END AS verdict_reason, {_BASIS('raised', 'positive')} AS verdict_basis, {_bars(('caveats', 'caveats'))}, round(CASE WHEN unread THEN 0.0::DOUBLE WHEN len(page_decisive) > 0 THEN 0.95::DOUBLE ELSE raised END, 3) AS confidence, CASE WHEN {_ALIVE} THEN true END AS alive FROM un",
    "signal_table": B.ALL_CHAIN + f", {_SIG} SELECT page_id, CAST(i - 1 AS INTEGER) AS place, x.id, x.category, x.status, x.evidence FROM (SELECT page_id, unnest(signals) AS x, unnest(generate_series(1, {len(_SIGNALS)})) AS i FROM sig)",
    "signals_summary": B.ALL_CHAIN + f", {_SIG} SELECT page_id, observed, not_tested, array_to_string({_some([('referer', 'referer = ' + _q('observed')), ('mobile', 'mobile = ' + _q('observed'))])}, '|') AS variant_differences FROM sig",
    "result_row": B.CHAIN + f", {_SIG}, {_VERDICT.replace('FROM res', 'FROM sig')} {_ROW}",
    "structural_divergence": B.CHAIN + """, j AS (SELECT page_id, b1.form_hosts AS bf, h1.form_hosts AS hf, b1.script_hosts AS bs, h1.script_hosts AS hs FROM res), k AS (SELECT *, len(list_filter(bs, lambda v: list_contains(hs, v))) / nullif(len(list_distinct(list_concat(bs, hs))), 0)::DOUBLE AS jac FROM j)
        SELECT page_id, array_to_string(list_filter([CASE WHEN len(bf) > 0 AND len(hf) > 0 AND NOT list_has_any(bf, hf) THEN 'form_action_hosts_disjoint:' || array_to_string(bf, ',') || '|' || array_to_string(hf, ',') END, CASE WHEN (len(bf) > 0) <> (len(hf) > 0) THEN 'form_presence_differs' END, CASE WHEN len(bs) > 0 AND len(hs) > 0 AND jac < 0.34 THEN 'script_hosts_jaccard=' || printf('%.2f', jac) END], lambda v: v IS NOT NULL), '|') AS reasons FROM k""",
    "blind_pair": B.CHAIN + f" SELECT asked AS url, b1.status AS bot_status, h1.status AS human_status, regexp_extract({_PLAN.format(u='asked', v='')}, '^([^:]*)', 1) AS crawl_order, 'bot_human' AS pair_mode FROM res",
    "html_summary": f"WITH {B._OBS} SELECT page_id, slot, replicate, {B._title('html')} AS title, sha256({B._visible('html')}) AS text_sha256, array_to_string(list_transform({B._INLINE}, lambda x: substr(sha256(x), 1, 12) || ':' || length(x)), '|') AS inline, array_to_string({B._EXTERNAL}, '|') AS external FROM watched",
    "gate_detection": f"WITH p AS (SELECT page_id, html || {_elt(_GATE_SNIPPETS)} AS html FROM pages), t AS (SELECT *, {B._visible('html')} AS text, {B._HANDLERS} AS handlers, array_to_string({B._rxall('html', T.SCRIPT, 2)}, ' ') AS scripts FROM p) SELECT page_id, array_to_string({B._GATES}, '|') AS gates FROM t",
    "audit_view": f"WITH {B._OBS} SELECT page_id, slot, replicate, sha256(substr({B._visible('html')}, 1, 500)) AS excerpt, CASE WHEN dom_html IS NOT NULL THEN sha256(substr({B._visible('dom_html')}, 1, 500)) END AS dom_excerpt, sha256(html) AS html_sha256, CAST(length(html) AS INTEGER) AS html_length FROM watched",
    "text_simhash": f"WITH t AS (SELECT page_id, {B._visible('html')} AS text FROM pages), g AS (SELECT page_id, g, count(*) AS k FROM (SELECT page_id, substr(text, i, 4) AS g FROM (SELECT page_id, text, unnest(generate_series(1, length(text) - 3)) AS i FROM t WHERE length(text) >= 4)) GROUP BY page_id, g), b AS (SELECT page_id, k, CAST(CAST('0x' || substr(md5(g), 17, 8) AS UBIGINT) AS BIGINT) AS hi, CAST(CAST('0x' || substr(md5(g), 25, 8) AS UBIGINT) AS BIGINT) AS lo FROM g), v AS (SELECT page_id, i, sum(CASE WHEN (hi >> i) & 1 = 1 THEN k ELSE -k END) AS hv, sum(CASE WHEN (lo >> i) & 1 = 1 THEN k ELSE -k END) AS lv FROM b CROSS JOIN (SELECT unnest(generate_series(0, 31)) AS i) GROUP BY page_id, i), s AS (SELECT page_id, CAST(sum(CASE WHEN hv > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN lv > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS lo FROM v GROUP BY page_id) SELECT t.page_id, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM t LEFT JOIN s ON s.page_id = t.page_id",
    "obfuscation_score": f"WITH p AS (SELECT page_id, {_elt(_SCRIPTS)} AS s FROM pages), w AS (SELECT *, regexp_extract_all(s, '({X.WORD})', 1) AS w, {_packed} AS packed FROM p) SELECT page_id, round(coalesce(least(1.0, len(list_filter(w, lambda x: length(x) <= 2)) / nullif(len(w), 0)::DOUBLE * 0.25 + len(list_filter(w, lambda x: starts_with(x, '_0x'))) / nullif(len(w), 0)::DOUBLE * 0.35 + len(regexp_extract_all(s, '\\\\x[0-9a-fA-F]{{2}}')) / nullif(length(s), 0)::DOUBLE * 100 * 0.15 + greatest(0.0, 4 - list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0)::DOUBLE) / 4 * 0.15 + packed * 0.10), 0.0), 9) AS score, packed > 0.85 OR starts_with({_bare}, '$=~[]') OR starts_with({_bare}, '$$$=~[]') AS symbol_encoded FROM w",
    "response_kinds": f"WITH p AS (SELECT page_id, {_elt(_TYPES)} AS t, {_elt(_ERRORS)} AS e FROM pages), k AS (SELECT *, lower(trim(regexp_extract(t, '^([^;]*)', 1))) AS kind FROM p) SELECT page_id, kind = '' OR starts_with(kind, 'text/') OR kind IN ('application/xhtml+xml', 'application/xml', 'application/json', 'application/javascript') AS is_document, CASE WHEN e = '' THEN NULL {' '.join(f'WHEN regexp_matches(e, {_q(w)}) THEN {_q(k)}' for w, k in T.ERROR_KINDS)} ELSE 'other' END AS error_kind, t AS content_type, '' AS referer FROM k",
    "request_policy": f"WITH q AS (SELECT page_id, page_id % 4 <> 0 AS permitted, n, method, kind, sub, c FROM pages CROSS JOIN (VALUES {', '.join(f'({i}, {_q(m)}, {_q(k)}, {s}, {c})' for i, (m, k, s, c) in enumerate(_REQUESTS))}) t(n, method, kind, sub, c)), b AS (SELECT *, CASE WHEN method NOT IN ('GET', 'HEAD') THEN 'non_read_method' WHEN kind IN ('websocket', 'eventsource', 'ping') THEN 'persistent_or_beacon_channel' WHEN sub THEN 'secondary_navigation_blocked' WHEN c > 200 THEN 'request_budget_exceeded' WHEN NOT permitted THEN 'request_outside_scope' ELSE '' END AS reason FROM q) SELECT page_id, n, reason, NOT (sub OR reason = 'secondary_navigation_blocked') AND (reason = 'request_budget_exceeded' OR kind IN {T.CONTENT_TYPES}) AS affects FROM b",
    "url_origin": f"WITH {B._V}, src AS (SELECT * FROM variants), {B._N} SELECT page_id, variant, nullif(regexp_extract(normalized, '^([a-z]+://[^/]*)', 1), '') AS origin FROM normal",
    "observation_plan": f"SELECT page_id, {_PLAN.format(u='url', v='mobile,referer')} AS plan FROM pages",
    "feed_accepted": f"WITH {B.FEED} {_FEED_OK}", "feed_rejected": f"WITH {B.FEED} SELECT reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY reason",
    "candidate_urls": f"WITH {_DATASET} SELECT url, host, reachability_class, place, bucket FROM cd ORDER BY bucket, place LIMIT 30", "candidate_buckets": f"WITH {_DATASET} SELECT reachability_class, count(*) AS hosts FROM cd GROUP BY 1",
    "reputation": f"WITH v AS (SELECT page_id, {_elt(('clean', 'clean', 'malicious', 'error'))} AS g, {_elt(('unknown', 'clean', 'clean'))} AS t, {_elt(('unknown', 'suspicious', 'unknown', 'unknown', 'clean'))} AS u FROM pages) SELECT page_id, CASE WHEN 'malicious' IN (g, t, u) THEN 'malicious' WHEN 'suspicious' IN (g, t, u) THEN 'suspicious' WHEN 'clean' IN (t, u) THEN 'clean' ELSE 'unknown' END AS overall, CASE WHEN g = 'malicious' THEN 'gsb: malicious' ELSE '' END AS hits FROM v",
    "cohort_distribution": f"WITH {_FIX} SELECT source_label AS cohort, field, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT source_label, '{c}' AS field, {c} AS value FROM r" for c in R.VERDICTS) + ") GROUP BY ALL",
    "verdict_crosstab": f"WITH {_FIX} SELECT source_label AS cohort, rule_cloaking_label AS a, cloaking_label AS b, count(*) AS n, 'final' AS kind FROM r GROUP BY ALL UNION ALL SELECT source_label, rule_cloaking_label, llm_cloaking_assessment, count(*), 'model' FROM r GROUP BY ALL",
    "top_reasons": f"WITH {_FIX}, c AS (SELECT source_label AS cohort, unnest(CASE page_id % 4 WHEN 1 THEN ['challenge_or_block_page', 'difference_not_replicated'] WHEN 2 THEN ['frontend_cloaking_code_present', 'http_error_status'] ELSE [] END) AS reason FROM r), n AS (SELECT cohort, reason, count(*) AS n FROM c GROUP BY ALL) SELECT cohort, reason, n, CAST(row_number() OVER (PARTITION BY cohort ORDER BY n DESC, reason) AS INTEGER) AS place FROM n",
    "signal_counts": f"WITH {_FIX} SELECT cohort, signal, count(*) AS n FROM (SELECT source_label AS cohort, {_entries('cloaking_signals')} AS signal FROM r) GROUP BY ALL",
    "group_report": f"WITH {_FIX}, g AS (SELECT source_label AS grp, count(*) AS n, count(*) FILTER (alive = 'True') AS alive, {', '.join(f'''count(*) FILTER (alive = 'True' AND {c}) AS {n}''' for n, c in (('t', 'cloaking = ' + _q('True')), ('f', 'cloaking = ' + _q('False')), ('na', 'cloaking = ' + _q('N/A')), ('raw_k', 'rule_fired_raw = ' + _q('True')), ('raw_n', 'rule_fired_raw <> ' + _q('')), ('phishing', 'is_phishing = ' + _q('True')), ('both', 'is_phishing = ' + _q('True') + ' AND cloaking = ' + _q('True'))))} FROM r GROUP BY 1) SELECT grp, n, alive, t, f, na, raw_k, raw_n, phishing, \"both\", round(alive / n::DOUBLE, 9) AS alive_rate, round(t / (t + f + na)::DOUBLE, 9) AS lower, round((t + na) / (t + f + na)::DOUBLE, 9) AS upper, round(t / (t + f)::DOUBLE, 9) AS conditional, round(raw_k / raw_n::DOUBLE, 9) AS raw_rate FROM g",
    "blind_spot": f"WITH {_FIX} SELECT count(*) AS n, count(*) FILTER (human_mechanisms = '') AS blind, count(*) FILTER (is_phishing = 'True') AS judged FROM r WHERE alive = 'True' AND label = 'phishing'",
    "channel_differential": f"WITH {_FIX}, " + _hits({"bot_channel_blocked": "bot_channel_blocked = 'True'", "bot_blank_without_error": "CAST(human_html_length AS INT) > 0 AND CAST(bot_html_length AS INT) = 0 AND bot_error = ''", "human_failed": "human_error <> ''"}) + _two("benign", "phishing"),
    "single_end_ablation": f"WITH {_FIX}, " + _hits({"bot_mechanisms": "bot_mechanisms <> ''", "human_mechanisms": "human_mechanisms <> ''", "bot_is_phishing": "bot_is_phishing = 'True'", "human_is_phishing": "human_is_phishing = 'True'"}) + _two("benign", "phishing"),
    "direction_skew": f"WITH {_FIX}, g AS (SELECT label, count(*) FILTER (hidden_from_bot <> '') AS forward, count(*) FILTER (reverse_diff <> '') AS backward FROM r WHERE alive = 'True' GROUP BY 1) SELECT label, forward, backward, round(forward / nullif(forward + backward, 0)::DOUBLE, 9) AS skew FROM g",
    "crawl_order_report": f"WITH {_FIX}, " + _fires("crawl_order") + _two("bot_first", "human_first"),
    "baseline_compare": f"WITH {_FIX}, u AS (SELECT 'batch' AS part, alive, rule_fired_raw FROM r UNION ALL SELECT 'baseline', alive, CASE WHEN page_id % 5 = 0 THEN 'True' ELSE 'False' END FROM r), " + _fires("part", "u") + _two("baseline", "batch"),
    "reverse_diff_top": f"WITH {_FIX}, n AS (SELECT mechanism, count(*) AS n FROM (SELECT {_entries('reverse_diff')} AS mechanism FROM r WHERE alive = 'True') GROUP BY 1) SELECT mechanism, n, CAST(row_number() OVER (ORDER BY n DESC, mechanism) AS INTEGER) AS place FROM n ORDER BY place LIMIT 5",
    "fired_rules": f"WITH {_FIX} SELECT rule, count(*) AS n FROM (SELECT {_entries('cloaking_fired')} AS rule FROM r) GROUP BY rule",
    "console_summary": f"WITH {_FIX} SELECT count(*) AS total, count(*) FILTER (alive = 'True') AS responses, count(*) FILTER (alive = '') AS not_observed, {', '.join(f'''count(*) FILTER ({c} = '{v}') AS {c}_{v}''' for c, vs in (('phishing_verdict', ('phishing', 'not_detected', 'unknown')), ('cloaking_label', ('true', 'false', 'unknown')), ('rule_cloaking_label', ('true',))) for v in vs)} FROM r",
    "annotation_scores": f"WITH {_FIX}, ks AS (SELECT 'precision_conservative' AS measure, count(*) FILTER (said = 'yes') AS k, count(*) AS n FROM sc WHERE cloaking = 'True' UNION ALL SELECT 'precision_decided', count(*) FILTER (said = 'yes'), count(*) FROM sc WHERE cloaking = 'True' AND said <> 'unsure' UNION ALL SELECT 'negatives_said_yes', count(*) FILTER (said = 'yes'), count(*) FROM sc WHERE cloaking = 'False'), {_RATES} SELECT measure, k, n, rate, lo, hi FROM rs",
    "precision_by_rule": f"WITH {_FIX}, e AS (SELECT {_entries('cloaking_fired')} AS rule, said FROM sc WHERE cloaking = 'True'), ks AS (SELECT rule, count(*) FILTER (said = 'yes') AS k, count(*) AS n FROM e GROUP BY rule), {_RATES} SELECT rule, k, n, rate, lo, hi FROM rs",
    "annotator_pairs": f"WITH {_FIX}, l AS (SELECT annotator, h, arg_max(said, place) AS said FROM an GROUP BY 1, 2), p AS (SELECT a.annotator AS a, b.annotator AS b, a.said AS x, b.said AS y FROM l a JOIN l b ON a.h = b.h AND a.annotator < b.annotator), t AS (SELECT a, b, count(*) AS n, count(*) FILTER (x = y) / count(*)::DOUBLE AS po FROM p GROUP BY 1, 2), c AS (SELECT x.a, x.b, sum(x.k * y.k) AS s FROM (SELECT a, b, x AS v, count(*) AS k FROM p GROUP BY ALL) x JOIN (SELECT a, b, y AS v, count(*) AS k FROM p GROUP BY ALL) y USING (a, b, v) GROUP BY 1, 2), q AS (SELECT t.*, coalesce(c.s, 0) / (n * n)::DOUBLE AS pe FROM t LEFT JOIN c ON c.a = t.a AND c.b = t.b) SELECT a, b, n, round(po, 9) AS po, round(pe, 9) AS pe, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 9) AS kappa FROM q",
    "stratified_sample": f"WITH {_FIX}, s AS (SELECT url, cloaking, row_number() OVER (PARTITION BY cloaking ORDER BY sha1('seed|pick|' || url), url) AS k FROM r WHERE cloaking IN ('True', 'False') AND page_id % 6 <> 0) SELECT CAST(row_number() OVER (ORDER BY sha1('seed|order|' || url), url) AS INTEGER) AS place, url, cloaking FROM s WHERE k <= CASE WHEN cloaking = 'True' THEN 20 ELSE 10 END",
}
