"""Queries over the long table of observations, and over event logs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as B
from . import report_catalog as G
from .functions import catalogue as C
from .functions import rules as U
from .functions import scripts as K
from .functions import text as X
from .functions.pages import evaluate
from .operators import details as D
from .operators import pairs as P
from .operators import signals as S
from .operators import verdicts as V
from .operators import reports as R
from .plans import observations as O
from .plans import results as fixture
from .streaming import sessions as E


def signal_details(spark, d):
    """All signals of all pages under three pair modes and one to three replicates, with what was compared and the evidence."""
    rows = D.detail_rows(D.signal_details(P.seen(O.planned(spark, d), wanted=P.DETAIL_FACTS), D.variant_table(spark)))
    return rows.select("page_id", "place", "id", "category", "status", F.array_join("compared", "|").alias("compared"), "evidence")


def observation_steps(spark, d):
    """The plan of every page as rows."""
    o = O.planned(spark, d)
    return o.select("page_id", "pair_mode", "slot", "replicate", F.coalesce("variant", F.lit("")).alias("variant"), "kind", "access_index")


def event_sessions(spark, d):
    out = E.sessions(spark.read.parquet(f"{d}/events.parquet"), gap="12 hours", step="7 days")
    return out.select("user_id", *[F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})").alias(f"{c}_us") for c in ("begins", "ends")], "events", "cents", F.array_join("kinds", "|").alias("kinds"))


def script_verdict(spark, d):
    """The page rules on what the first human visit got, with what its own scripts say when decoded."""
    pages = O.observations(spark, d).filter("slot = 'human' AND replicate = 1").select("page_id", "url", "html")
    out = K.with_scripts(pages)
    rule = V.rule_result(F.col("score"), F.col("decisive"), F.col("obfuscated"))
    return out.select("page_id", "scripts", "decoded", "obfuscated", F.array_join("flags", "|").alias("flags"), F.array_join("decisive", "|").alias("decisive"), F.round(rule["score"], 6).alias("score"), rule["positive"].alias("positive"))


def page_scripts(spark, d):
    """Every script of every page, whole, with its readable text."""
    pages = O.observations(spark, d).filter("slot = 'human' AND replicate = 1").select("page_id", "html")
    return K.script_rows(pages).select("page_id", "place", F.sha2("content", 256).alias("sha256"), "readable", "changed", F.round("score", 9).alias("score"))


def cohort_rollup(spark, d):
    rows = fixture.results(spark, d).withColumn("source_label", F.when(F.col("page_id") % 10 != 0, F.col("source_label")))  # a null cohort as well
    return R.rollup(R.check_versions(rows))


def rule_coverage(spark, d):
    """Of each category of the rule table: patterns, weight, scope, and the pages and patterns that hit."""
    table = U.rule_table(spark)
    pages = evaluate(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html"), rules=U.read_rules(table))
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"hits.{c}").alias("hits")) for c in C.CATEGORIES])
    found = pages.select(F.explode(rows).alias("r")).groupBy("r.name").agg(F.count_if(F.col("r.hits") > 0).alias("pages"), F.sum("r.hits").alias("hits"))
    own = table.filter("kind = 'pattern'").groupBy("name").agg(F.count("*").alias("patterns"), F.max("weight").alias("weight"), F.max("scope").alias("scope"))
    return own.join(found, "name", "left").select("name", "patterns", "weight", "scope", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


QUERIES = {f.__name__: f for f in (signal_details, observation_steps, event_sessions, script_verdict, page_scripts, cohort_rollup, rule_coverage)}

_q, _list, _some, _except = B._q, B._list, B._some, B._except
_MODE = "(page_id // 5) % 3"
_WANTED = "1 + (page_id // 7) % 3"
_BASE = f"""
base AS (SELECT page_id, url AS asked, html AS raw, page_id % {O.SCENARIOS} AS s, slot, CASE {_MODE} WHEN 0 THEN kind WHEN 1 THEN '{O.HUMAN}' ELSE '{O.BOT}' END AS kind, replicate
         FROM pages CROSS JOIN (VALUES {", ".join(f"('{s}', '{k}', {r})" for r in (1, 2, 3) for s, k in (("bot", O.BOT), ("human", O.HUMAN)))}) t(slot, kind, replicate) WHERE replicate <= {_WANTED})"""
_ROW = "page_id, asked, s, slot, kind, replicate, access_index, status, error, url AS final, chain, page_url, at_ms, truncated, non_html, body_error, stopped, failed, client_navigations"
_MOBILE = f"FROM (SELECT * REPLACE ('{O.HUMAN}' AS kind, CASE WHEN status = 0 THEN NULL WHEN s = 12 THEN html || {_q(O.EVIL)} ELSE html END AS dom_html, url AS page_url, CASE WHEN status <> 0 THEN html END AS early_html) FROM watched WHERE replicate = 1 AND slot = 'human' AND s IN (0, 17, 18))"
_VIEWS = f"""
obs AS (SELECT {_ROW}, 'html' AS view, '' AS variant, html, url FROM watched UNION ALL SELECT {_ROW}, 'dom', '', dom_html, page_url FROM watched WHERE dom_html IS NOT NULL UNION ALL SELECT {_ROW}, 'early', '', early_html, page_url FROM watched WHERE early_html IS NOT NULL
    UNION ALL SELECT {_ROW.replace(", status,", ", CASE WHEN s = 17 THEN 302 ELSE status END AS status,").replace("kind,", f"'{O.BOT}' AS kind,")}, 'html', 'referer', html, url FROM watched WHERE replicate = 1 AND slot = 'bot' AND s IN (0, 17, 19)
    UNION ALL SELECT {_ROW}, 'html', 'mobile', html, url {_MOBILE} UNION ALL SELECT {_ROW}, 'dom', 'mobile', dom_html || CASE WHEN s = 17 THEN {_q(O.TITLES[0] + O.EVIL)} ELSE '' END, page_url {_MOBILE})"""
_KEYS = {"status": "CAST({v}.status AS VARCHAR)", "final_host": "{v}.final_host", "title": "coalesce({v}.low_title, '')", **{k: "coalesce(array_to_string({v}." + k + ", '|'), '')" for k in ("mechanisms", "form_hosts", "script_hosts")}, "html_sha256": "coalesce({v}.html, '')", "text_sha256": "coalesce(lower({v}.text), '')"}
_DOM_HOST = "lower(regexp_extract(trim(coalesce(h.page_url, h.final)), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_feature = lambda k, v: _DOM_HOST if v == "d" and k == "final_host" else _KEYS[k].format(v="h" if k == "status" else v)
_K = "(CASE WHEN h.kind = 'browser' AND h.replicate = 1 AND h.variant = '' THEN h.page_id % 13 ELSE -1 END)"
_AT = "d.page_id = h.page_id AND d.slot = h.slot AND d.replicate = h.replicate AND d.variant = h.variant"
_differ = lambda x, y, keys=S.COMPARED, a="f", b="f": _some((k, f"{x}.{a}_{k} IS DISTINCT FROM {y}.{b}_{k}") for k in keys)
_meaning = lambda keys: f"list_has_any({keys}, {_list(map(_q, S.MEANINGFUL))})"
_status = lambda seen, measurable="true", tested="true": f"CASE WHEN NOT ({tested}) THEN 'not_tested' WHEN NOT ({measurable}) THEN 'unmeasurable' WHEN {seen} THEN 'observed' ELSE 'not_observed' END"
_json = lambda x: f"CAST(to_json({{'e': {x}}}) AS VARCHAR)"
_of = lambda rows, field: f"coalesce(list_transform({rows}, lambda zz: zz.{field}), [])"
_rows = lambda fields, where="true", order="name": f"coalesce(list({{{', '.join(f'{_q(k)}: {v}' for k, v in fields.items())}}} ORDER BY {order}) FILTER ({where}), [])"
_same_names = lambda *names: {n: n for n in names}
_hosts_of = "list_transform(chain, lambda u: lower(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)))"
_COUNTS = ("console_errors", "failed_all", "n_failed", "blocked_all", "blocked", "dialogs", "downloads", "popups")
_TITLED = f"(regexp_matches(title, {_q('(?i)' + C.ERROR_TITLE)}) OR regexp_matches(dom_title, {_q('(?i)' + C.ERROR_TITLE)}))"
_case = lambda x, y: f"CASE WHEN {x}.status BETWEEN 200 AND 299 AND {x}.text_length > 0 AND len({x}.mechanisms) = 0 AND len({y}.mechanisms) > 0 THEN {{'benign_looking': {x}.name, 'with_mechanisms': {y}.name, 'mechanisms': list_sort({y}.mechanisms), 'titles': [{x}.f_title, {y}.f_title]}} END"
_LONG = f"""
vw AS MATERIALIZED (SELECT *, lower(title) AS low_title FROM isu),
m AS MATERIALIZED (SELECT h.page_id, h.s, h.slot, h.kind, h.replicate, h.variant, h.issues, CASE WHEN h.variant <> '' THEN h.variant ELSE h.slot || '#' || h.replicate END AS name, h.access_index AS place, h.at_ms * 1000 AS us, NOT list_has_any(h.issues, {_list(map(_q, C.BLOCKING))}) AS usable, h.kind = 'browser' AS browser, h.status, h.error,
    {", ".join(f"{_feature(k, v)} AS {a}_{k}" for v, a in (("h", "f"), ("d", "d")) for k in S.COMPARED)}, length(h.html) AS length, length(h.text) AS text_length, substr(h.text, 1, 160) AS excerpt, h.title, h.mechanisms, coalesce(length(d.html), 0) > 0 AS has_dom, coalesce(length(d.text), 0) AS dom_text_length, coalesce(d.title, '') AS dom_title, coalesce(d.mechanisms, []) AS dom_mechanisms,
    e.page_id IS NOT NULL AS has_early, coalesce(length(e.text), 0) AS early_text_length, coalesce(e.mechanisms, []) AS early_mechanisms, list_distinct(h.inline) AS inline, list_distinct(list_transform(h.external, lambda u: regexp_extract(u, '^([^?]*)', 1))) AS external, h.static_rules, h.techniques, coalesce(d.static_rules, []) AS dom_rules, coalesce(d.techniques, []) AS dom_techniques,
    NOT list_has_any(coalesce(d.issues, []), {_list(map(_q, C.BLOCKING))}) AS clear_dom, h.chain, h.final AS url, coalesce(h.page_url, '') AS page_url, h.body_error, h.client_navigations, CAST({_K} = 0 AS INTEGER) AS console_errors, CASE WHEN {_K} = 1 THEN ['a is null', 'b', 'c'] ELSE [] END AS page_errors, CASE WHEN h.kind <> 'browser' THEN '' WHEN {_K} = 2 THEN 'timeout' ELSE 'ok' END AS load_event,
    CAST(h.failed AS INTEGER) AS n_failed, CAST(h.failed AS INTEGER) + CASE WHEN {_K} = 3 THEN 2 ELSE 0 END AS failed_all, CASE WHEN h.stopped THEN 2 ELSE 0 END AS blocked, CASE WHEN h.stopped THEN 2 ELSE 0 END + CAST({_K} = 4 AS INTEGER) AS blocked_all, CAST(h.stopped AS INTEGER) AS dialogs, CAST(h.stopped AS INTEGER) AS downloads, CAST(h.stopped AS INTEGER) AS popups,
    CASE h.error WHEN '' THEN '' WHEN 'timeout' THEN 'timeout' ELSE 'protocol_error' END AS error_kind, h.kind || '/1' AS user_agent
    FROM vw h LEFT JOIN vw d ON {_AT} AND d.view = 'dom' LEFT JOIN vw e ON {_AT.replace("d.", "e.")} AND e.view = 'early' WHERE h.view = 'html'),
n AS MATERIALIZED (SELECT *, round((us - lag(us) OVER o) / 1e6::DOUBLE, 3) AS gap, row_number() OVER o AS access, row_number() OVER k AS nth, list_distinct(flatten(coalesce(list(mechanisms) OVER (PARTITION BY page_id, usable ORDER BY place, name ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), []))) AS later_mechanisms,
    list_distinct(coalesce(list(status) OVER (PARTITION BY page_id, usable ORDER BY place, name ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), [])) AS later_status, greatest(len(chain) - 1, 0) AS hops, {_hosts_of} AS hosts, len(list_distinct(list_filter({_hosts_of}, lambda x: x <> ''))) > 1 AS cross_host,
    list_sort({_except("dom_mechanisms", "mechanisms")}) AS added, list_sort({_except("mechanisms", "dom_mechanisms")}) AS removed, list_sort({_except("dom_mechanisms", "early_mechanisms")}) AS after FROM m WHERE variant = '' WINDOW o AS (PARTITION BY page_id ORDER BY place, name), k AS (PARTITION BY page_id, usable ORDER BY place, name)),
sd AS (SELECT page_id, list({{'pair': pair, 'differences': differences}} ORDER BY pair) AS sides FROM (SELECT x.page_id, x.name || '~' || y.name AS pair, {_differ("x", "y")} AS differences FROM n x JOIN n y ON y.page_id = x.page_id AND y.slot = x.slot AND y.replicate > x.replicate WHERE x.usable AND y.usable AND NOT EXISTS (SELECT 1 FROM n z WHERE z.page_id = x.page_id AND z.slot = x.slot AND z.usable AND z.replicate > x.replicate AND z.replicate < y.replicate)) GROUP BY page_id),
pr0 AS (SELECT b.page_id, b.replicate, b.name || '~' || h.name AS pair, {_differ("b", "h")} AS differences, b.f_text_sha256 IS NOT DISTINCT FROM h.f_text_sha256 AS same_text, [b.text_length, h.text_length] AS text_lengths, [b.excerpt, h.excerpt] AS excerpts, len({_except("b.inline", "h.inline")}) AS inline_only_bot, len({_except("h.inline", "b.inline")}) AS inline_only_human,
    list_slice(list_sort({_except("b.external", "h.external")}), 1, 10) AS external_only_bot, list_slice(list_sort({_except("h.external", "b.external")}), 1, 10) AS external_only_human, list_filter([{_case("b", "h")}, {_case("h", "b")}], lambda v: v IS NOT NULL) AS cases FROM n b JOIN n h ON h.page_id = b.page_id AND h.replicate = b.replicate AND h.slot = 'human' WHERE b.slot = 'bot' AND b.usable AND h.usable),
pg AS (SELECT page_id, list({{'pair': pair, 'differences': differences}} ORDER BY replicate) AS pairs, list({{'pair': pair, 'same_text': same_text, 'text_lengths': text_lengths, 'excerpts': excerpts}} ORDER BY replicate) AS texts, flatten(list(cases ORDER BY replicate)) AS decoys,
    list({{'pair': pair, 'inline_only_bot': inline_only_bot, 'inline_only_human': inline_only_human, 'external_only_bot': external_only_bot, 'external_only_human': external_only_human}} ORDER BY replicate) AS scripts FROM pr0 GROUP BY page_id),
vc AS (SELECT v.page_id, v.variant, any_value(v.usable) AS v_usable, any_value(v.issues) AS v_issues, any_value(v.kind) AS v_kind, any_value(v.chain) AS v_chain, {_rows({"name": "c.name", "chain": "c.chain"}, "c.usable", "c.name")} AS chains,
    coalesce(list({{'name': c.name, 'keys': CASE v.variant WHEN 'mobile' THEN {_differ("c", "v", S.VARIANT_KEYS, "d", "d")} ELSE {_differ("c", "v", S.VARIANT_KEYS)} END}} ORDER BY c.name) FILTER (c.usable), []) AS differences,
    list_filter([{", ".join(f"CASE WHEN count(DISTINCT CASE v.variant WHEN 'mobile' THEN c.d_{k} ELSE c.f_{k} END) FILTER (c.usable) = 1 AND bool_and(CASE v.variant WHEN 'mobile' THEN c.d_{k} <> v.d_{k} ELSE c.f_{k} <> v.f_{k} END) FILTER (c.usable) THEN '{k}' END" for k in S.VARIANT_KEYS)}], lambda x: x IS NOT NULL) AS keys
    FROM m v LEFT JOIN n c ON c.page_id = v.page_id AND c.slot = CASE v.variant WHEN 'mobile' THEN 'human' ELSE 'bot' END WHERE v.variant <> '' GROUP BY v.page_id, v.variant),
ob AS (SELECT page_id, {_rows(_same_names("name", "kind", "user_agent"))} AS clients, {_rows(_same_names("name", "status"))} AS statuses, count(DISTINCT status) FILTER (status <> 0) AS codes, count(*) FILTER (status <> 0) AS answers, bool_or(browser) AS has_browser,
    {_rows({**_same_names("name", "added", "removed"), "text_lengths": "[text_length, dom_text_length]", "text_changed": "f_text_sha256 IS DISTINCT FROM d_text_sha256", "titles": "[f_title, d_title]"}, "browser AND usable AND has_dom")} AS rendered,
    {_rows({"name": "name", **{c.replace("n_failed", "failed"): c for c in _COUNTS}, **_same_names("page_errors", "load_event", "body_error", "error", "error_kind")}, "browser")} AS browser_errors, {_rows(_same_names("name", "error", "error_kind"), "NOT browser")} AS plain_errors,
    bool_or(error <> '' OR browser AND ({" + ".join(_COUNTS)} > 0 OR len(page_errors) > 0 OR load_event = 'timeout' OR body_error <> '')) AS faulty, {_rows(_same_names("name", "hops", "hosts", "cross_host"))} AS redirects, bool_or(hops >= 2 OR cross_host) AS redirected,
    {_rows({"name": "name", "final_url": "url", **_same_names("page_url", "client_navigations")}, "browser")} AS moves, bool_or(browser AND (client_navigations > 0 OR (page_url <> '' AND page_url <> url))) AS moved,
    {_rows({"name": "name", "text_lengths": "[early_text_length, dom_text_length]", "mechanisms_after": "after"}, "browser AND has_early")} AS delays, bool_or(browser AND has_early AND (len(after) > 0 OR (early_text_length = 0 AND dom_text_length > 0))) AS delayed,
    {_rows({"name": "name", "document_text_empty": "text_length = 0", "html_length": "length", "dom_text_empty": "CASE WHEN browser THEN dom_text_length = 0 END"}, "status <> 0")} AS blanks, bool_or(status <> 0 AND (text_length = 0 OR (browser AND dom_text_length = 0))) AS blank,
    {_rows(_same_names("name", "status", "title", "dom_title"), "status <> 0")} AS titles, bool_or(status <> 0 AND (NOT status BETWEEN 200 AND 299 OR {_TITLED})) AS error_page,
    {_rows({"name": "name", "access_index": "place", "observed_us": "us"}, order="access")} AS accesses, coalesce(list(gap ORDER BY access) FILTER (gap IS NOT NULL), []) AS gaps, {_rows({"name": "name", "status": "status", "mechanisms": "mechanisms"}, "usable", "nth")} AS per_access,
    any_value(list_sort({_except("mechanisms", "later_mechanisms")})) FILTER (usable AND nth = 1) AS only_first, coalesce(bool_or(len(later_status) = 1 AND NOT list_contains(later_status, status)) FILTER (usable AND nth = 1), false) AS status_first, any_value(name) FILTER (usable AND nth = 1) AS first_name,
    first({{'r': CASE WHEN browser AND has_dom THEN dom_rules ELSE static_rules END, 't': CASE WHEN browser AND has_dom THEN dom_techniques ELSE techniques END}} ORDER BY slot <> 'human', replicate) FILTER (CASE WHEN browser AND has_dom THEN clear_dom ELSE usable END) AS judged,
    list_filter([{", ".join(f"CASE WHEN count(*) FILTER (usable AND slot = 'bot') = max(replicate) AND count(*) FILTER (usable AND slot = 'human') = max(replicate) AND max(replicate) >= 2 AND count(DISTINCT f_{k}) FILTER (usable AND slot = 'bot') = 1 AND count(DISTINCT f_{k}) FILTER (usable AND slot = 'human') = 1 AND min(f_{k}) FILTER (usable AND slot = 'bot') <> min(f_{k}) FILTER (usable AND slot = 'human') THEN '{k}' END" for k in S.COMPARED)}], lambda x: x IS NOT NULL) AS systematic
    FROM n GROUP BY page_id),
pj AS (SELECT ob.*, pg.* EXCLUDE (page_id), coalesce(sd.sides, []) AS sides, vr.v_usable AS r_ok, vr AS r, vm AS mo FROM ob LEFT JOIN pg ON pg.page_id = ob.page_id LEFT JOIN sd ON sd.page_id = ob.page_id LEFT JOIN vc vr ON vr.page_id = ob.page_id AND vr.variant = 'referer' LEFT JOIN vc vm ON vm.page_id = ob.page_id AND vm.variant = 'mobile')"""


def _changed(v: str, name: str, profile: str, sent: str) -> tuple[str, str, str]:
    ok = f"({v}.v_usable AND len({v}.differences) > 0)"
    evidence = f"CASE WHEN {v}.page_id IS NULL THEN NULL ELSE {{'variant_issues': CASE WHEN NOT {ok} THEN {v}.v_issues END, 'variant_profile': {v}.v_kind || ':{name}', 'referer_sent': '{sent}', 'variant_chain': {v}.v_chain, 'chains': {v}.chains, 'differences': {v}.differences, 'differs_from_all_controls': {v}.keys, 'replicated': false}} END"
    return _status(f"len({v}.keys) > 0", ok, f"{v}.page_id IS NOT NULL"), f"CASE WHEN {v}.page_id IS NOT NULL AND {ok} THEN list_concat(['variant:{name}'], {_of(v + '.differences', 'name')}) ELSE [] END", evidence


_PAIRED = "pairs IS NOT NULL"
_TOLD = {
    "client_type_response_difference": (_status(f"len(list_filter(pairs, lambda x: {_meaning('x.differences')})) > 0 OR len(systematic) > 0", _PAIRED), "coalesce(flatten(list_transform(pairs, lambda x: string_split(x.pair, '~'))), [])", "{'clients': clients, 'pairs': pairs, 'systematic': systematic}"),
    "referer_presence_effect": _changed("r", "referer", O.BOT, "https://search.example/"), "desktop_mobile_difference": _changed("mo", "mobile", O.HUMAN, ""),
    "http_status_difference": (_status("codes > 1", "answers >= 2"), f"CASE WHEN answers >= 2 THEN {_of('statuses', 'name')} ELSE [] END", "statuses"),
    "visible_text_difference": (_status("len(list_filter(texts, lambda x: NOT x.same_text)) > 0", _PAIRED), _of("texts", "pair"), "{'pairs': texts, 'systematic': list_contains(systematic, 'text_sha256')}"),
    "js_modified_dom": (_status("len(list_filter(rendered, lambda x: len(x.added) > 0 OR len(x.removed) > 0 OR x.text_changed)) > 0", "len(rendered) > 0", "has_browser"), _of("rendered", "name"), "rendered"),
    "script_inventory_difference": (_status("len(list_filter(scripts, lambda x: x.inline_only_bot > 0 OR x.inline_only_human > 0 OR len(x.external_only_bot) > 0 OR len(x.external_only_human) > 0)) > 0", _PAIRED), _of("scripts", "pair"), "scripts"),
    "frontend_cloaking_code": (_status("len(coalesce(judged.r, [])) > 0"), "['analysis_js']", "{'static_rules': coalesce(judged.r, []), 'categories': coalesce(judged.t, [])}"),
    "browser_errors": (_status("faulty"), _of("clients", "name"), "{'browsers': browser_errors, 'others': plain_errors}"), "multi_hop_redirect": (_status("redirected"), _of("redirects", "name"), "redirects"),
    "client_side_redirect": (_status("moved", tested="has_browser"), _of("moves", "name"), "moves"), "delayed_content": (_status("delayed", tested="len(delays) > 0"), _of("delays", "name"), "delays"),
    "blank_page": (_status("blank", "answers > 0"), _of("blanks", "name"), "blanks"), "error_page": (_status("error_page", "answers > 0"), _of("titles", "name"), "titles"),
    "decoy_candidate": (_status("len(decoys) > 0", _PAIRED), _of("decoys", "benign_looking"), "decoys"),
    "repeat_instability": (_status(f"len(list_filter(sides, lambda x: {_meaning('x.differences')})) > 0", "len(sides) > 0"), _of("sides", "pair"), "{'accesses': accesses, 'gaps_sec': gaps, 'within_side_differences': sides}"),
    "first_access_only": (_status("len(coalesce(only_first, [])) > 0 OR status_first", "len(per_access) >= 2"), f"CASE WHEN len(per_access) >= 2 THEN {_of('per_access', 'name')} ELSE [] END", "{'first': first_name, 'mechanisms_only_in_first_access': coalesce(only_first, []), 'status_differs_only_in_first_access': status_first, 'per_access': per_access}"),
}
_ONE_BY_ONE = " UNION ALL ".join(f"SELECT page_id, CAST({place} AS INTEGER) AS place, '{i}' AS id, '{c}' AS category, {_TOLD[i][0]} AS status, array_to_string({_TOLD[i][1]}, '|') AS compared, {_json(_TOLD[i][2])} AS evidence FROM pj" for place, (i, c) in enumerate(D.SIGNALS))
#: What a match of each pattern stands for, ``g`` being its group.
_UNITS = "(('0x' || substr({g}, 3, 4))::INTEGER - 55296) * 1024 + ('0x' || substr({g}, 9, 4))::INTEGER - 56320 + 65536"
_MEANINGS = (
    (K.ATOB, "CASE WHEN length({g}) % 4 = 0 THEN try(decode(from_base64({g}))) END"), (K.UNESCAPE, "try(url_decode(replace({g}, '+', '%2B')))"),
    (K.HEX, "CASE WHEN ('0x' || {g})::INTEGER < 128 THEN chr(('0x' || {g})::INTEGER) ELSE '" + K.LOST + "' END"), (K.PAIR, f"chr({_UNITS})"), (K.UNIT, "chr(('0x' || {g})::INTEGER)"),
)
_index = lambda m: f"regexp_extract({m}, {_q(K.CALL[1])}, 1)"
_around = lambda parts, name: f"{_q(parts[0])} || replace({name}, '$', '\\$') || {_q(parts[1])}"


def _decoding(first: str) -> tuple[str, str]:
    """CTEs that decode column c of ``first`` (one step each keeps the text short), and the name of the last."""
    steps, last = [], first

    def add(expression: str) -> None:
        nonlocal last
        steps.append(f"{first}_{len(steps)} AS MATERIALIZED (SELECT * REPLACE ({expression} AS c) FROM {last})")
        last = f"{first}_{len(steps) - 1}"

    for _ in range(K.ROUNDS):
        for pattern, meaning in _MEANINGS:
            add(f"list_reduce(list_distinct(regexp_extract_all(c, {_q(pattern)}, 0)), lambda a, m: replace(a, m, coalesce({meaning.format(g=f'regexp_extract(m, {_q(pattern)}, 1)')}, m)), c)")
        table, items = f"regexp_extract(c, {_q(K.TABLE)}, 1)", f"regexp_extract_all(regexp_extract(c, {_q(K.TABLE)}, 2), {_q(K.LITERAL)})"
        name = f"CASE WHEN {table} <> '' THEN regexp_extract(c, {_around(K.LOOKUP, table)}, 1) ELSE '' END"
        number = f"CASE WHEN lower({_index('m')}) LIKE '0x%' THEN lower({_index('m')})::INTEGER ELSE {_index('m')}::INTEGER END"
        add(f"CASE WHEN {name} = '' THEN c ELSE list_reduce(list_distinct(regexp_extract_all(c, {_around(K.CALL, name)}, 0)), lambda a, m: replace(a, m, coalesce({items}[{number} + 1], m)), c) END")
        for pattern, other in K.JOINS:
            add(f"regexp_replace(c, {_q(pattern)}, {_q(other)}, 'g')")
    return ", ".join(steps), last


_HUMAN_FIRST = "substr(sha1(url), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f')"
_STEPS, _LAST = _decoding("sc0")
_HUMAN = "SELECT page_id, url, html FROM watched WHERE slot = 'human' AND replicate = 1"
_SCRIPTS = f"""
hu AS ({_HUMAN}), si AS (SELECT page_id, {B._INLINE} AS inline FROM hu), sc0 AS MATERIALIZED (SELECT page_id, unnest(inline) AS s, unnest(inline) AS c, unnest(generate_series(0, len(inline) - 1)) AS place FROM si WHERE len(inline) > 0), {_STEPS},
scr AS MATERIALIZED (SELECT page_id, CAST(place AS INTEGER) AS place, s, c, {B._obfuscation("s")} AS score FROM {_LAST}),
sg AS (SELECT page_id, string_agg(c, chr(10) ORDER BY place) AS js, count(*) AS scripts, count(*) FILTER (c <> s) AS decoded, count(*) FILTER (score > {X.OBFUSCATED}::DOUBLE) AS obfuscated FROM scr GROUP BY page_id)"""
_SCOPED = ", ".join(f"({' + '.join(f'CAST(regexp_matches({dict(html="html", page="page")[scope]}, {_q("(?i)" + p)}) AS INTEGER)' for p in patterns)}) AS {name}" for name, (_, scope, patterns) in C.CATEGORIES.items())
_RAISED = "CASE WHEN obfuscated > 0 THEN least(0.9::DOUBLE, score + least(0.15::DOUBLE, obfuscated * 0.05::DOUBLE)) ELSE score END"
_HIT = ", ".join(f"({' + '.join(f'CAST(regexp_matches(html, {_q("(?i)" + p)}) AS BIGINT)' for p in patterns)}) AS {name}" for name, (_, _, patterns) in C.CATEGORIES.items())
SQL = {
    "cohort_rollup": f"WITH {G._FIX}, q AS (SELECT * REPLACE (CASE WHEN page_id % 10 <> 0 THEN source_label END AS source_label) FROM r) SELECT CASE GROUPING(source_label, label) WHEN 0 THEN 'label' WHEN 1 THEN 'cohort' ELSE 'total' END AS level, source_label AS cohort, label, count(*) AS n, count(*) FILTER (rule_cloaking_label = 'true') AS rule_true, count(*) FILTER (cloaking_label = 'true') AS cloaking, count(*) FILTER (phishing_verdict = 'phishing') AS phishing FROM q GROUP BY GROUPING SETS ((source_label, label), (source_label), ())",
    "rule_coverage": f"WITH h AS (SELECT {_HIT} FROM (SELECT coalesce(html, '') AS html FROM pages)) " + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({len(p)} AS BIGINT) AS patterns, {w}::DOUBLE AS weight, '{s}' AS scope, count(*) FILTER ({c} > 0) AS pages, CAST(coalesce(sum({c}), 0) AS BIGINT) AS hits FROM h" for c, (w, s, p) in C.CATEGORIES.items()),
    "deobfuscated_scripts": f"WITH ds AS (SELECT page_id, {G._elt(G._SCRIPTS)} AS s, {G._elt(G._SCRIPTS)} AS c FROM pages), {_decoding('ds')[0]} SELECT page_id, c AS deobfuscated, round({B._obfuscation('c')}, 9) AS score_after, c <> s AS changed FROM {_decoding('ds')[1]}",
    "page_scripts": f"WITH {B._OBS}, {_SCRIPTS} SELECT page_id, place, sha256(s) AS sha256, c AS readable, c <> s AS changed, round(score, 9) AS score FROM scr",
    "script_verdict": f"WITH {B._OBS}, {_SCRIPTS}, obs AS (SELECT hu.*, html || chr(10) || coalesce(js, '') AS page, coalesce(scripts, 0) AS scripts, coalesce(decoded, 0) AS decoded, coalesce(obfuscated, 0) AS obfuscated FROM hu LEFT JOIN sg ON sg.page_id = hu.page_id), {B._EVAL.replace(B._HITS, _SCOPED)}, fin AS (SELECT *, least(0.9::DOUBLE, final_value) AS score FROM ev), "
    f"ra AS (SELECT *, {_RAISED} AS raised FROM fin) SELECT page_id, scripts, decoded, obfuscated, array_to_string(flags, '|') AS flags, array_to_string(decisive, '|') AS decisive, round(raised, 6) AS score, len(decisive) > 0 OR raised >= 0.45::DOUBLE AS positive FROM ra",
    "signal_details": f"WITH {_BASE}, {B._WATCHED}, {_VIEWS}, {B._EVAL}, {B._ALL_FACTS}, {_LONG} {_ONE_BY_ONE}",
    "observation_steps": f"""
WITH p AS (SELECT page_id, {_MODE} AS m, {_WANTED} AS n, page_id % {O.SCENARIOS} AS s, {_HUMAN_FIRST} AS hf FROM pages)
SELECT page_id, ['bot_human', 'human_human', 'bot_bot'][m + 1] AS pair_mode, slot, CAST(replicate AS INTEGER) AS replicate, '' AS variant, CASE m WHEN 0 THEN kind WHEN 1 THEN '{O.HUMAN}' ELSE '{O.BOT}' END AS kind, CAST(2 * (replicate - 1) + CASE WHEN hf = (slot = 'human') THEN 1 ELSE 2 END AS INTEGER) AS access_index
FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS replicate) CROSS JOIN (VALUES ('bot', '{O.BOT}'), ('human', '{O.HUMAN}')) t(slot, kind) WHERE replicate <= n
UNION ALL SELECT page_id, ['bot_human', 'human_human', 'bot_bot'][m + 1], 'human', 1, 'mobile', '{O.HUMAN}', CAST(2 * n + 1 AS INTEGER) FROM p WHERE s IN (0, 17, 18)
UNION ALL SELECT page_id, ['bot_human', 'human_human', 'bot_bot'][m + 1], 'bot', 1, 'referer', '{O.BOT}', CAST(2 * n + CASE WHEN s = 19 THEN 1 ELSE 2 END AS INTEGER) FROM p WHERE s IN (0, 17, 19)""",
    "event_sessions": """
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS begins_us, epoch_us(max(ts)) AS ends_us, count(*) AS events, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) AS BIGINT) AS cents, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS kinds FROM s GROUP BY user_id, k""",
}
