"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import catalogue as C
from .functions import pages as R
from .functions import records as T
from .functions import text as X
from .functions.pages import evaluate, evaluate_once, signatures
from .functions.urls import entropy, host_of, human_first, normalize_url, registered_domain, reject_reason, url_hash
from .operators import pairs as P
from .operators import signals as S
from .operators import verdicts as V
from .operators.stats import cohens_kappa, prevalence
from .plans import observations as O
from .sources.feeds import classify

VARIANTS = ("", "?email=a", "/verify", ":8443/x", "@evil.example/", " bad", "#frag", "?", "#", ":00443/y", ":99999/", ":/z", "/a?b#", "\t\n")
_BARE = (3, 4, 9, 10, 11)


def _variants(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    tails = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(v).alias("tail")) for i, v in enumerate(VARIANTS)])
    v = pages.withColumn("v", F.explode(tails)).select("page_id", "url", "v.variant", "v.tail")
    bare = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    return v.select("page_id", "variant", F.when(F.col("variant").isin(*_BARE), F.concat(bare, "tail")).otherwise(F.concat("url", "tail")).alias("url"))


def url_normalize(spark, d):
    return _variants(spark, d).select("page_id", "variant", normalize_url(F.col("url")).alias("normalized"), reject_reason(F.col("url")).alias("reason"))


def url_registered_domain(spark, d):
    return _variants(spark, d).select("page_id", "variant", host_of(F.col("url")).alias("host"), registered_domain(host_of(F.col("url"))).alias("domain"))


def url_entropy(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.round(entropy(F.col("url")), 9).alias("bits"))


def crawl_order(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", url_hash(F.col("url")).alias("url_hash"), human_first(F.col("url")).alias("human_first"))


def feed_lines(spark, d) -> DataFrame:
    """A feed with many addresses that are the same but for what follows the path."""
    return _variants(spark, d).select((F.col("page_id") * len(VARIANTS) + F.col("variant") + 1).alias("line"), F.regexp_replace("url", "(?s)[?#].*$", "").alias("raw_url"))


def feed_import(spark, d):
    return classify(feed_lines(spark, d)).select("line", "raw_url", "reason", "normalized_url", "accepted")


def _rule_columns() -> list:
    return [*[F.col(f"hits.{k}").alias(k) for k in C.CATEGORIES], F.array_join("flags", "|").alias("flags"), F.array_join("decisive", "|").alias("decisive"), F.round("score", 6).alias("score"), "is_phishing"]


def page_rules(spark, d):
    """The rules on what the first human visit of each page got."""
    return evaluate(O.observations(spark, d).filter("slot = 'human' AND replicate = 1").select("page_id", "url", "html")).select("page_id", *_rule_columns())


def observation_rules(spark, d):
    """``page_rules`` of all four observations of a page."""
    return evaluate_once(O.observations(spark, d).select("page_id", "slot", "replicate", "url", "html")).select("page_id", "slot", "replicate", *_rule_columns())


#: Hosts with something before, after or below them, and what follows the URL.
RISKS = (("", "", ""), ("verify9.", "", "/bn/troftnikon1"), ("", ".duckdns.org", "/paypal/login"), ("microsoft.", ".pages.dev", "/"), ("", ":8443", "/a?x=1&email=b"), ("paypal.com@", "", "/"), ("xn--a-b-c-d-e.", "", "/en/abcdefgh"), ("", "-a-b-c-d.com", "/1234567890123456789012345678901234567890123456789012345678901234567890"))


def url_risk(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, (a, b, c) in enumerate(RISKS)])).alias("v"), "url")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    risky = pages.select("page_id", "v.variant", F.concat(F.lit("https://"), "v.a", host, "v.b", "v.c").alias("url"), F.lit("").alias("html"))
    return evaluate(risky).select("page_id", "variant", F.array_join("flags", "|").alias("flags"), F.array_join("decisive", "|").alias("decisive"), F.round("score", 6).alias("score"))


#: Script snippets after each page, one of six in turn.
SNIPPETS = ("", "<script>if(navigator.webdriver){location.href='https://a.example'}</script>", "<script>document.referrer; screen.width < 600</script>", "<script>canvas.x; if (a) b; setTimeout(function(){location='x'})</script>", "<script>window.__cdc_a; WebGL; if (c) d</script>", "<script>el.onmousemove = f; geoip()</script>")


def frontend_signatures(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat("html", F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("page_id") % len(SNIPPETS) + 1).cast("int"))).alias("html"))
    return signatures(pages).select("page_id", F.array_join("techniques", "|").alias("techniques"), F.array_join("static_rules", "|").alias("static_rules"))


#: Snippets of form, frame and asset structure, one after each page in turn.
_PASS = '<input type="password">'
PIECES = (
    "", f'<form action="https://login.okta.com/x">{_PASS}</form>', f'<form action="http://192.168.1.9/go">{_PASS}<input type="email"></form>', f'<form method=post action="/a/login2.php">{_PASS}</form>', f"<form action='//evil.example/p' id=f>{_PASS}</form>",
    f'<form action="javascript:go()">{_PASS}</form><img src="https://www.paypal.com/logo.png">', '<form action="https://x.netlify.app/s"><input name="cvv"></form>', '<script src="https://apple.com/a.js"></script><form><input name="q"></form>', '<iframe src="https://unknown.example/t" style="display:none"></iframe>',
    '<iframe hidden src="https://www.googletagmanager.com/ns"></iframe>', '<IFRAME hidden src="/own"></IFRAME>', f'<form action="https://a.duckdns.org/">{_PASS}</form><form action="https://b.example/send.php">{_PASS}</form>', '<script>eval(atob("x"))</script><body oncontextmenu="return false"><form action="/l"><input name=otp></form>', '<iframe style="display:none"></iframe>',
)


def page_structure(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.concat("html", F.element_at(F.array(*map(F.lit, PIECES)), (F.col("page_id") % len(PIECES) + 1).cast("int"))).alias("html"))
    return evaluate(pages).select("page_id", F.array_join("flags", "|").alias("flags"), F.array_join("decisive", "|").alias("decisive"), F.array_join("mechanisms", "|").alias("mechanisms"), F.round("score", 6).alias("score"), "is_phishing")


def seen(spark, d, wanted=R.FACTS) -> DataFrame:
    """Every observation with the facts, or those that are wanted, and issues of its views."""
    return P.seen(O.observations(spark, d), wanted=wanted)


def observation_issues(spark, d):
    o = seen(spark, d).withColumn("dom_issues", F.when(F.col("dom").isNotNull(), F.col("dom_issues")))
    views = o.select("slot", "replicate", F.explode(F.array(F.struct(F.lit("html").alias("view"), "issues"), F.struct(F.lit("dom").alias("view"), F.col("dom_issues").alias("issues")))).alias("v"))
    return views.select("slot", "replicate", "v.view", F.explode("v.issues").alias("issue")).groupBy("slot", "replicate", "view", "issue").agg(F.count("*").alias("n"))


def _side_by_side(spark, d, wanted) -> DataFrame:
    """One row per page: its observations side by side and the judged page, with the facts that are asked for."""
    pairs = V.choose_page(P.pair_table(P.seen(O.everything(spark, d), wanted=wanted)))
    return pairs.withColumn("static_rules", F.coalesce("page.facts.static_rules", P.nothing()))


def signalled(spark, d) -> DataFrame:
    """One row per page with its signals, and no verdict."""
    pairs = _side_by_side(spark, d, P.SIGNAL_FACTS)
    return S.signals(pairs, F.col("static_rules"))


def labelled(spark, d) -> DataFrame:
    """One row per page with its cloaking label, and what the label does not read left out."""
    pairs = S.variant_differences(_side_by_side(spark, d, P.brief(P.LABEL_FACTS)))
    return P.label(pairs, F.col("static_rules"), F.col("variant_differences"))


def judged(spark, d) -> DataFrame:
    """One row per page: its observations side by side, judged page, signals, verdicts and cloaking label."""
    pairs = _side_by_side(spark, d, P.RESULT_FACTS).withColumn("techniques", F.coalesce("page.facts.techniques", P.nothing()))
    return P.label(V.classify(S.signals(pairs, F.col("static_rules")), F.col("page.facts.obfuscated")), F.col("static_rules"), F.col("variant_differences"))


def cloaking_label(spark, d):
    bar = lambda c: F.array_join(c, "|").alias(c)
    return labelled(spark, d).select("page_id", bar("fired"), bar("hidden"), bar("reverse"), "channel_blocked", bar("evidence"), "rule_label", "label", bar("reasons"), "basis", "reason")


def reason_counts(spark, d):
    return labelled(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def label_prevalence(spark, d):
    p = prevalence(labelled(spark, d).withColumn("cohort", F.col("page_id") % 3), "cohort")
    return p.select("cohort", "n", "t", "f", "na", *[F.round(c, 9).alias(c) for c in ("lower", "upper", "conditional", "ci_lo", "ci_hi")])


def annotator_kappa(spark, d):
    k = cohens_kappa(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic")
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("po", "pe", "kappa")])


QUERIES = {f.__name__: f for f in (url_normalize, url_registered_domain, url_entropy, crawl_order, feed_import, page_rules, observation_rules, url_risk, page_structure, frontend_signatures, observation_issues, cloaking_label, reason_counts, label_prevalence, annotator_kappa)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_V = f"""
variants AS (SELECT page_id, variant, CASE WHEN variant IN {_BARE} THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || tail ELSE url || tail END AS url
             FROM pages CROSS JOIN (VALUES {", ".join(f"({i}, {_q(v)})" for i, v in enumerate(VARIANTS))}) t(variant, tail))"""
_P = _q(r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$")
_N = f"""
cut AS (SELECT *, regexp_replace(url, '^[\\x09-\\x0D\\x1C-\\x20]+|[\\x09-\\x0D\\x1C-\\x20]+$', '', 'g') AS u FROM src),
parts AS (SELECT *, lower(regexp_extract(u, {_P}, 1)) AS scheme, regexp_extract(u, {_P}, 2) AS netloc, regexp_extract(regexp_extract(u, {_P}, 2), '([^@]*)$', 1) AS place FROM cut),
named AS (SELECT *, regexp_extract(place, '^(\\[[^\\]]*\\]|[^:]*)', 1) AS h, regexp_extract(place, '^(?:\\[[^\\]]*\\]|[^:]*):(.*)$', 1) AS port FROM parts),
judged AS (SELECT *, regexp_replace(port, '^0+', '') AS p, CASE WHEN u = '' OR regexp_matches(u, '[\\x00-\\x20\\x7f\\\\]') THEN 'invalid_url_characters' WHEN scheme NOT IN ('http', 'https') OR h = '' THEN 'http_url_required' WHEN contains(netloc, '@') THEN 'userinfo_not_allowed'
    WHEN port <> '' AND (NOT regexp_matches(port, '^[0-9]+$') OR length(regexp_replace(port, '^0+', '')) > 5 OR coalesce(TRY_CAST(port AS INTEGER), 0) > 65535) THEN 'invalid_port' WHEN NOT starts_with(h, '[') AND regexp_matches(h, '^\\.|\\.\\.|[^.]{{64}}') THEN 'invalid_host' END AS reason FROM named),
normal AS (SELECT *, CASE WHEN reason IS NULL THEN scheme || '://' || lower(h) || CASE WHEN p = '' OR (scheme = 'http' AND p = '80') OR (scheme = 'https' AND p = '443') THEN '' ELSE ':' || p END || CASE WHEN regexp_extract(u, {_P}, 3) = '' THEN '/' ELSE regexp_extract(u, {_P}, 3) END
    || CASE WHEN regexp_extract(u, {_P}, 4) = '?' THEN '' ELSE regexp_extract(u, {_P}, 4) END || CASE WHEN regexp_extract(u, {_P}, 5) = '#' THEN '' ELSE regexp_extract(u, {_P}, 5) END END AS normalized FROM judged)"""
_FREE = "(" + ", ".join(map(_q, C.FREE_HOSTS)) + ")"
_SECOND = "(" + ", ".join(map(_q, C.SECOND_LEVEL)) + ")"


def _domain(h: str) -> str:
    h = f"regexp_extract(lower({h}), '^([^:]*)', 1)"
    p = f"string_split({h}, '.')"
    k = f"(CASE WHEN len({p}) >= 3 AND {p}[len({p}) - 1] IN {_SECOND} THEN 3 ELSE 2 END)"
    tail = lambda n: f"array_to_string(list_slice({p}, len({p}) - {n} + 1, len({p})), '.')"
    return f"(CASE WHEN len({p}) < 2 THEN {h} WHEN len({p}) > {k} AND {tail(k)} IN {_FREE} THEN {tail(f'({k} + 1)')} ELSE {tail(k)} END)"


_HOST = "lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_EVIL = "((slot = 'human' AND s IN (1, 3, 5, 6, 14)) OR (slot = 'human' AND replicate = 1 AND s = 2) OR (slot = 'bot' AND replicate = 1 AND s = 7) OR s = 8)"
_EMPTY = "((slot = 'bot' AND s IN (5, 14)) OR (slot = 'human' AND replicate = 1 AND s = 10))"
_FIRST = "(substr(sha1(asked), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f')) = (slot = 'human')"
_BASE = f"""
base AS (SELECT page_id, url AS asked, html AS raw, page_id % {O.SCENARIOS} AS s, slot, kind, replicate FROM pages CROSS JOIN (VALUES ('bot', '{O.BOT}', 1), ('human', '{O.HUMAN}', 1), ('bot', '{O.BOT}', 2), ('human', '{O.HUMAN}', 2)) t(slot, kind, replicate))"""
_WATCHED = f"""
placed AS (SELECT *, 2 * (replicate - 1) + CASE WHEN {_FIRST} THEN 1 ELSE 2 END AS access_index,
    CASE WHEN slot = 'bot' AND s IN (3, 4) THEN 403 WHEN slot = 'bot' AND replicate > 1 AND s = 11 THEN 503 WHEN (slot = 'human' AND replicate = 1 AND s = 10) OR (slot = 'bot' AND s = 14) THEN 0 WHEN slot = 'human' AND s = 23 THEN 404 ELSE 200 END AS status,
    CASE WHEN {_EMPTY} THEN '' WHEN s = 20 THEN {_q(O.BLANK)} ELSE coalesce(raw, '') || CASE WHEN {_EVIL} THEN {_q(O.EVIL)} WHEN s = 0 THEN {_q(O.SCRIPTED)} WHEN slot = 'human' AND s = 4 THEN {_q(O.LOGIN)} WHEN slot = 'human' AND s IN (9, 13) THEN {_q(O.GATE)}
        WHEN slot = 'human' AND s = 15 THEN {_q(O.TITLES[0])} WHEN s = 16 THEN {_q(O.ARTIFACT)} WHEN slot = 'human' AND s = 23 THEN {_q(O.TITLES[1] + O.PROMPT)} ELSE '' END END AS html,
    CASE WHEN slot = 'human' AND s = 6 THEN 'https://other.example/' ELSE asked END AS final FROM base),
watched AS (SELECT page_id, asked, s, slot, kind, replicate, access_index, status, html, final AS url, CASE WHEN s = 20 AND access_index = 3 THEN NULL ELSE 1704067200000 + page_id * 60000 + access_index * (17250 + page_id % 7) END AS at_ms,
    CASE WHEN slot = 'human' AND replicate = 1 AND s = 10 THEN 'timeout' WHEN slot = 'bot' AND s = 14 THEN '{O.RESET}' ELSE '' END AS error,
    CASE WHEN status = 0 THEN [] WHEN s = 22 THEN [asked, 'https://hop.example/', asked] WHEN final <> asked THEN [asked, final] ELSE [asked] END AS chain,
    CASE WHEN kind <> 'browser' OR status = 0 THEN NULL WHEN s = 12 THEN html || {_q(O.EVIL)} WHEN s = 20 THEN coalesce(raw, '') ELSE html END AS dom_html, CASE WHEN kind = 'browser' AND s = 22 THEN asked || '#late' WHEN kind = 'browser' THEN final END AS page_url,
    slot = 'human' AND replicate = 1 AND s = 18 AS truncated, slot = 'bot' AND s = 19 AS non_html, CASE WHEN slot = 'human' AND replicate > 1 AND s = 10 THEN 'body lost' ELSE '' END AS body_error, slot = 'human' AND s = 21 AS stopped, slot = 'human' AND s = 21 AND replicate = 1 AS failed,
    CASE WHEN kind = 'browser' AND s = 22 THEN 1 ELSE 0 END AS client_navigations, CASE WHEN kind = 'browser' AND status <> 0 THEN html END AS early_html FROM placed)"""
_OBS = f"{_BASE}, {_WATCHED}"
_NARROW = "page_id, asked, s, slot, kind, replicate, access_index, status, error, url AS final, chain, page_url, at_ms, truncated, non_html, body_error, stopped, failed, client_navigations"
#: One row per observation and view: what the evaluation below reads.
_VIEWS = f"""
obs AS (SELECT {_NARROW}, 'html' AS view, '' AS variant, html, url FROM watched UNION ALL SELECT {_NARROW}, 'dom', '', dom_html, page_url FROM watched WHERE dom_html IS NOT NULL UNION ALL SELECT {_NARROW}, 'early', '', early_html, page_url FROM watched WHERE early_html IS NOT NULL
    UNION ALL SELECT {_NARROW.replace(", status,", ", CASE WHEN s = 17 THEN 302 ELSE status END AS status,")}, 'html', 'referer', html, url FROM watched WHERE replicate = 1 AND slot = 'bot' AND s IN (0, 17, 19)
    UNION ALL SELECT {_NARROW.replace("url AS final", "page_url AS final")}, 'html', 'mobile', coalesce(dom_html, html) || CASE WHEN s = 17 THEN {_q(O.TITLES[0] + O.EVIL)} ELSE '' END, page_url FROM watched WHERE replicate = 1 AND slot = 'human' AND s IN (0, 17, 18))"""
_below = lambda d, hosts: f"regexp_matches('.' || {d}, {_q(C.suffixes(hosts))})"
_rx = lambda text, pattern: f"regexp_matches({text}, {_q(pattern)})"
_get = lambda text, pattern: f"regexp_extract({text}, {_q(pattern)}, 1)"
_HITS = ", ".join(f"({' + '.join(f'CAST(regexp_matches(html, {_q("(?i)" + p)}) AS INTEGER)' for p in patterns)}) AS {name}" for name, (_, _, patterns) in C.CATEGORIES.items())
_ON = {k: f"{k} > 0" for k in C.CATEGORIES} | {k: k for k in (*C.FORM_FLAGS, *C.URL_FLAGS)}
_list = lambda items: "[" + ", ".join(items) + "]"
_SCORE = "0.0::DOUBLE" + "".join(f" + {w}::DOUBLE * least(1.0::DOUBLE, {k} / 3.0::DOUBLE)" for k, (w, _, _) in C.CATEGORIES.items())


def _combo_steps() -> str:
    """One CTE for each combination keeps the text short."""
    steps, last = [], "k0"
    for i, (bonus, least) in enumerate(C.COMBOS, 1):
        steps.append(f"k{i} AS (SELECT * EXCLUDE (x), CASE WHEN {' AND '.join(f'{k} >= {n}' for k, n in least.items())} THEN least(1.0::DOUBLE, x + {bonus}::DOUBLE) ELSE x END AS x FROM {last})")
        last = f"k{i}"
    return ",\n".join(steps)


_BRAND = " OR ".join(f"(contains(full_path, {_q(b)}) AND NOT {_below('reg', own)})" for b, own in C.BRANDS.items())
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(url, '')), lambda c: -((length(url) - length(replace(url, c, ''))) / length(url)::DOUBLE) * log2((length(url) - length(replace(url, c, ''))) / length(url)::DOUBLE)))"
_TARGET = f"list_transform(frames, lambda s: CASE WHEN {_get('s', R.TARGET_HOST)} = '' THEN own ELSE {_domain(_get('s', R.TARGET_HOST))} END)"
_AWAY = f"f.aimed AND NOT f.ip AND f.host <> '' AND f.dom <> own AND NOT {_below('f.dom', C.COMMON_HOSTS)} AND NOT {_below('f.dom', C.SSO_HOSTS)}"
_KINDS = {"form_action_to_ip": "ip", "form_action_free_host": "free", "form_action_cross_domain": "cross", "form_action_kit_script": "kit"}
_w = lambda name, weight, other="0.0::DOUBLE": f"CASE WHEN {name} THEN {weight}::DOUBLE ELSE {other} END"
_STRUCTURE = " + ".join([_w("cred_param_in_url", 0.22), _w("risky", "0.30", _w("suspicious_registrar", 0.18)), _w("fake_service_subdomain", 0.15), _w("suspicious_path_keyword", 0.08), _w("opaque_path_pattern", 0.14)])
_LEXICAL = " + ".join([_w("ip_in_hostname", "0.30"), _w("at_symbol_in_url", 0.45), _w("punycode_domain", 0.35), _w("url_extreme_length", 0.16, _w("url_long", 0.09)), _w("high_digit_ratio", 0.14), _w("high_entropy", 0.08), _w("high_hyphen_density", 0.05), _w("non_standard_port", 0.12)])
_EVAL = f"""
adr AS (SELECT *, lower(regexp_extract(url, {_P}, 2)) AS netloc, regexp_extract(url, {_P}, 3) AS raw_path, lower(regexp_extract(url, {_P}, 4)) AS query, {_HOST} AS host, string_split(lower(regexp_extract(url, {_P}, 2)), '.') AS labels FROM obs),
reg AS (SELECT *, {_domain('netloc')} AS reg, {_domain('host')} AS own, netloc || lower(raw_path) AS full_path, string_split(host, '.') AS hp, '.' || array_to_string(list_slice(labels, greatest(1, len(labels) - 1), len(labels)), '.') AS tail FROM adr),
uf AS (SELECT *, ({_BRAND}) AS brand, {_below('reg', C.HOSTING)} AS hosted, regexp_matches(regexp_replace(query, '^\\?', ''), {_q(C.CREDENTIAL_PARAMS)}) AS cred_param_in_url, len(labels) >= 2 AND {_rx('tail', C.suffixes(C.REGISTRARS))} AS suspicious_registrar, len(labels) >= 2 AND {_rx('tail', C.suffixes(C.HIGH_RISK))} AS risky,
        len(labels) >= 3 AND labels[1] <> 'www' AND {_rx('labels[1]', C.FAKE_SERVICES)} AS fake_service_subdomain, {_rx('lower(raw_path)', C.PATH_KEYWORDS)} AS suspicious_path_keyword,
        {_rx('raw_path', R.OPAQUE_PATH)} AND lower({_get('raw_path', R.OPAQUE_PATH)}) NOT IN {C.SHORT_PREFIXES} AS opaque_path_pattern, {_rx('host', R.IP_HOST)} AS ip_in_hostname, regexp_matches(url, '://[^/]*@') AS at_symbol_in_url, contains(netloc, 'xn--') AS punycode_domain,
        length(url) > 120 AS url_extreme_length, length(url) BETWEEN 76 AND 120 AS url_long, coalesce(length(regexp_replace(url, '[^0-9]', '', 'g')) / nullif(length(url), 0)::DOUBLE > 0.10::DOUBLE, false) AS high_digit_ratio, coalesce({_ENTROPY} > 4.2::DOUBLE, false) AS high_entropy,
        length(regexp_replace(CASE WHEN len(hp) > 1 THEN hp[len(hp) - 1] ELSE host END, '[^-]', '', 'g')) >= 4 AS high_hyphen_density, coalesce(TRY_CAST(regexp_extract(netloc, ':([0-9]{{1,5}})$', 1) AS INTEGER) BETWEEN 1 AND 65535 AND TRY_CAST(regexp_extract(netloc, ':([0-9]{{1,5}})$', 1) AS INTEGER) NOT IN (80, 443), false) AS non_standard_port FROM reg),
hit AS (SELECT *, brand AND hosted AS brand_squatting_suspicious_host, brand AND NOT hosted AS brand_squatting, {_HITS}, list_filter(regexp_extract_all(html, {_q(R.FORM)}, 0), lambda f: {_rx(_get('f', R.FORM_BODY), R.CREDENTIAL_FIELD)}) AS blocks,
        list_transform(regexp_extract_all(html, {_q(R.ASSET)}, 1), lambda a: {_domain("lower(regexp_extract(a, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))")}) AS assets, list_filter(list_transform(list_filter(regexp_extract_all(html, {_q(R.IFRAME)}, 0), lambda t: {_rx('t', R.HIDDEN)}), lambda t: {_get('t', R.IFRAME_SRC)}), lambda s: s <> '') AS frames FROM uf),
fr1 AS (SELECT *, list_transform(list_transform(blocks, lambda b: {{'a': trim({_get(_get('b', R.FORM_ATTRS), R.ACTION)}), 'lax': NOT {_rx(_get('b', R.FORM_BODY), R.VALIDATION)}}}), lambda f: {{'aimed': NOT {_rx('f.a', R.NO_TARGET)}, 'host': lower({_get('f.a', R.TARGET_HOST)}), 'path': '/' || {_get('f.a', R.TARGET_PATH)}, 'lax': f.lax}}) AS raw_forms FROM hit),
fr2 AS (SELECT *, list_transform(raw_forms, lambda f: {{'aimed': f.aimed, 'host': f.host, 'ip': {_rx('f.host', R.IP_HOST)}, 'dom': {_domain('f.host')}, 'kit': {_rx('f.path', R.KIT_SCRIPT)}, 'lax': f.lax}}) AS more_forms FROM fr1),
fr3 AS (SELECT *, list_transform(more_forms, lambda f: {{'kind': CASE WHEN f.aimed AND f.ip THEN 'ip' WHEN {_AWAY} THEN CASE WHEN {_below('f.dom', C.FREE_HOSTS)} THEN 'free' ELSE 'cross' END WHEN f.aimed AND f.kit THEN 'kit' ELSE '' END, 'lax': f.lax}}) AS forms FROM fr2),
frm AS (SELECT *, len(forms) > 0 AS cred_form, {', '.join(f"len(list_filter(forms, lambda f: f.kind = '{kind}')) > 0 AS {name}" for name, kind in _KINDS.items())}, len(list_filter(forms, lambda f: f.lax)) > 0 AS form_without_validation,
        len(list_filter(assets, lambda a: a IN {tuple(R.BRAND_HOSTS)} AND a <> own AND NOT {_below('a', C.COMMON_HOSTS)})) > 0 AS brand_asset_hotlink, len(list_filter({_TARGET}, lambda s: NOT {_below('s', C.COMMON_HOSTS + C.SOCIAL_HOSTS + C.EMBED_HOSTS)})) > 0 AS hidden_iframe,
        coalesce(list_sum(list_transform(forms, lambda f: CASE f.kind WHEN 'ip' THEN 0.45::DOUBLE WHEN 'free' THEN 0.45::DOUBLE WHEN 'cross' THEN 0.35::DOUBLE WHEN 'kit' THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN f.lax THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)), 0.0::DOUBLE) AS form_score FROM fr3),
sco AS (SELECT *, {_SCORE} AS s1, least(0.60::DOUBLE, form_score + CASE WHEN brand_asset_hotlink THEN CASE WHEN cred_form THEN 0.25::DOUBLE ELSE 0.08::DOUBLE END ELSE 0.0::DOUBLE END + {_w('hidden_iframe', 0.12)}) AS b1, {_w('brand_squatting_suspicious_host', '0.50', _w('brand_squatting', '0.30'))} AS b2,
        least(0.55::DOUBLE, {_STRUCTURE}) AS b3, least(0.60::DOUBLE, {_LEXICAL}) AS b4 FROM frm),
k0 AS (SELECT *, least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, s1 + b1) + b2) + b3) + b4) AS s0, least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, s1 + b1) + b2) + b3) + b4) AS x,
       list_filter({_list(f"CASE WHEN {' AND '.join(_ON[f] for f in flags)} THEN '{k}' END" for k, flags in C.DECISIVE.items())}, lambda v: v IS NOT NULL) AS decisive,
       list_sort(list_filter({_list(f"CASE WHEN {c} THEN '{k}' END" for k, c in _ON.items())}, lambda v: v IS NOT NULL)) AS flags FROM sco),
{_combo_steps()},
ev AS (SELECT *, CASE WHEN len(decisive) > 0 THEN s0 ELSE x END AS final_value, len(decisive) > 0 OR CASE WHEN len(decisive) > 0 THEN s0 ELSE x END >= 0.45::DOUBLE AS is_phishing, list_filter(flags, lambda v: list_contains({_list(map(_q, C.MECHANISMS))}, v)) AS mechanisms FROM k{len(C.COMBOS)})"""
_HIGH = _list(map(_q, C.HIGH_SPECIFICITY))
_in = lambda items: _list(map(_q, items))
_some = lambda conditions: f"list_filter({_list(f'CASE WHEN {c} THEN {_q(n)} END' for n, c in conditions)}, lambda v: v IS NOT NULL)"
_within = lambda a, b: f"list_filter({a}, lambda v: list_contains({b}, v))"
_except = lambda a, b: f"list_filter({a}, lambda v: NOT list_contains({b}, v))"
_rxall = lambda text, pattern, g=1: f"regexp_extract_all({text}, {_q(pattern)}, {g})"
_squash = lambda text: f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
_hosts = lambda pattern: f"list_sort(list_distinct(list_filter(list_transform({_rxall('html', pattern)}, lambda u: lower(regexp_extract(u, '^https?://([^/]+)', 1))), lambda h: h <> '')))"
_visible = lambda html: _squash(f"regexp_replace(regexp_replace({html}, {_q(T.UNSEEN)}, ' ', 'g'), {_q(T.TAG)}, ' ', 'g')")
_title = lambda html: _squash(f"regexp_replace({_get(html, T.TITLE)}, {_q(T.TAG)}, ' ', 'g')")
_HANDLERS = f"array_to_string({_rxall('html', T.HANDLER_DOUBLE)}, ' ') || ' ' || array_to_string({_rxall('html', T.HANDLER_SINGLE)}, ' ')"
_GATES = "list_sort(list_distinct(" + _some((name, _rx({"markup": "html", "handler": "handlers", "script": "(scripts || ' ' || handlers)", "text": "text"}[scope], "(?i)" + pattern)) for name, scope, pattern in C.GATES) + "))"
_OWN_SCRIPTS = f"list_filter({_rxall('html', T.SCRIPT, 0)}, lambda x: {_get(_get('x', T.SCRIPT), T.SCRIPT_SOURCE)} = '' AND regexp_extract(x, {_q(T.SCRIPT)}, 2) <> '')"
#: All own scripts of a page, whole, and what queries of the first scripts read: so many of them, cut.
_ALL_INLINE = f"list_transform({_OWN_SCRIPTS}, lambda x: regexp_extract(x, {_q(T.SCRIPT)}, 2))"
_INLINE = f"list_transform(list_slice({_OWN_SCRIPTS}, 1, {T.INLINE_SCRIPTS}), lambda x: substr(regexp_extract(x, {_q(T.SCRIPT)}, 2), 1, {T.INLINE_CHARS}))"
_FOLDER = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)', 1)"
_JOINED = f"CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN u WHEN starts_with(u, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || u WHEN starts_with(u, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || u ELSE CASE WHEN ends_with({_FOLDER}, '/') THEN {_FOLDER} ELSE {_FOLDER} || '/' END || u END"
_EXTERNAL = f"list_transform(list_filter(list_transform({_rxall('html', T.SCRIPT)}, lambda a: {_get('a', T.SCRIPT_SOURCE)}), lambda u: u <> ''), lambda u: {_JOINED})"
_TECHNIQUES = "list_sort(" + _some((k, " OR ".join(_rx("html", "(?i)" + p) for p in patterns)) for k, patterns in C.SIGNATURES.items()) + ")"
_STATIC = _some((k, " AND ".join(f"list_has_any(techniques, {_in(g)})" for g in groups)) for k, groups in C.SIGNATURE_RULES.items())
_BAD = "(error <> '' OR status = 0)"
_ISSUES = "list_sort(" + _some([
    ("crawl_error", _BAD), ("http_error_status", "status <> 0 AND NOT status BETWEEN 200 AND 299"), ("non_html_document", "non_html"), ("document_body_unavailable", "NOT non_html AND status <> 0 AND html = '' AND view = 'html' AND body_error <> ''"),
    ("empty_document", "NOT non_html AND status <> 0 AND html = '' AND NOT (view = 'html' AND body_error <> '')"), ("content_truncated", "truncated AND view = 'html'"), ("blank_visible_text", "html <> '' AND text = ''"), ("challenge_or_block_page", f"list_has_any(gates, {_in(C.CHALLENGES)})"),
    ("interaction_gate", f"list_has_any(gates, {_in(C.INTERACTIONS)})"), ("content_requests_blocked", "view = 'dom' AND stopped"), ("content_requests_failed", "view = 'dom' AND failed"), *[(x, "view = 'dom' AND stopped") for x in ("dialog_dismissed", "download_blocked", "popup_closed")],
]) + ")"
def _obfuscation(x: str) -> str:
    words, bare = f"regexp_extract_all({x}, '({X.WORD})', 1)", f"regexp_replace({x}, '\\s', '', 'g')"
    n = f"nullif(len({words}), 0)::DOUBLE"
    packed = f"coalesce(length(regexp_replace({bare}, '[^\\[\\]!+()]', '', 'g')) / nullif(length({bare}), 0)::DOUBLE, 0.0)"
    escapes = f"len(regexp_extract_all({x}, '\\\\x[0-9a-fA-F]{{2}}')) / nullif(length({x}), 0)::DOUBLE"
    score = f"len(list_filter({words}, lambda y: length(y) <= 2)) / {n} * 0.25 + len(list_filter({words}, lambda y: starts_with(y, '_0x'))) / {n} * 0.35 + {escapes} * 100 * 0.15 + greatest(0.0, 4 - list_sum(list_transform({words}, lambda y: length(y))) / {n}) / 4 * 0.15 + {packed} * 0.10"
    return f"coalesce(least(1.0, {score}), 0.0)"


#: Facts of each view, its issues, and the observations side by side as b1, b2, h1, h2 with their views (d: the page after its scripts ran, e: the early one).
_FACTS = f"""
tx AS (SELECT *, {_visible('html')} AS text, {_title('html')} AS title, {_HANDLERS} AS handlers, array_to_string({_rxall('html', T.SCRIPT, 2)}, ' ') AS scripts, {_TECHNIQUES} AS techniques, {_INLINE} AS inline, {_EXTERNAL} AS external, {_hosts(R.FORM_ACTION)} AS form_hosts, {_hosts(R.SOURCE_HOST)} AS script_hosts, {_HOST} AS final_host FROM ev),
gt AS (SELECT *, {_GATES} AS gates, {_STATIC} AS static_rules FROM tx),
isu AS (SELECT *, {_ISSUES} AS issues, len(list_filter(inline, lambda z: {_obfuscation('z')} > {X.OBFUSCATED}::DOUBLE)) AS obfuscated FROM gt)"""
_ALL_FACTS = _FACTS.replace(_INLINE, _ALL_INLINE)
_REST = "page_id, asked, s, slot, kind, replicate, access_index, status, error, final, chain, page_url, at_ms, client_navigations, stopped, failed, body_error, title, lower(title) AS low_title, text, html, final_host, form_hosts, script_hosts, gates, issues, mechanisms, decisive, least(0.9::DOUBLE, final_score) AS score, is_phishing, techniques, static_rules, inline, external, obfuscated"
_one = lambda c, r: f"CASE WHEN {c} THEN [{_q(r)}] ELSE [] END"


def _cat(items) -> str:
    return "flatten([" + ", ".join(items) + "])"


_NAMES = (("b1", "bot#1"), ("b2", "bot#2"), ("h1", "human#1"), ("h2", "human#2"))
_HALF = (("b1", "h1"), ("b2", "h2"))
_KEYS = {"status": "status", "final_host": "final_host", "mechanisms": "mechanisms", "title": "low_title", "form_hosts": "form_hosts", "script_hosts": "script_hosts", "html_sha256": "html", "text_sha256": "lower_text"}


def _side(b: str, h: str, tag: str) -> str:
    mb, mh = f"{b}.mechanisms", f"{h}.mechanisms"
    hidden, shared, reverse = f"list_sort({_except(mh, mb)})", f"list_sort({_within(mh, mb)})", f"list_sort({_except(mb, mh)})"
    evil, shut, reset = f"list_has_any({mh}, {_HIGH})", f"{b}.status IN (403, 404, 503)", f"contains({b}.error, 'ERR_HTTP2_PROTOCOL_ERROR')"
    last = lambda n: f"coalesce({n}.chain[-1], '')"
    host = lambda n: f"CASE WHEN regexp_extract({last(n)}, 'https?://([^/]+)', 1) <> '' THEN regexp_extract({last(n)}, 'https?://([^/]+)', 1) ELSE {last(n)} END"
    fork = f"({last(b)} <> '' AND {last(h)} <> '' AND {host(b)} <> {host(h)})"
    lone = f"({h}.text <> '' AND {b}.text = '' AND {b}.error = '')"
    fired = _some([
        ("C1", f"len({hidden}) > 0 AND {b}.text <> '' AND {b}.error = '' AND NOT {shut}"), ("C2", f"{shut} AND {h}.status = 200 AND {evil}"), ("C3", f"{reset} AND {h}.error = '' AND {evil}"), ("C4", f"{lone} AND {evil}"), ("C5", f"{fork} AND len({mh}) > 0 AND len({mb}) = 0"),
    ])
    blocked = f"(({shut} AND {h}.status = 200) OR ({reset} AND {h}.error = '') OR {lone})"
    return f"{fired} AS fired{tag}, {hidden} AS hidden{tag}, {shared} AS shared{tag}, {reverse} AS rev{tag}, {blocked} AS blocked{tag}, {fork} AS fork{tag}"


def _tag(col: str, name: str, allowed, skip: str | None = None) -> str:
    found = _within(f"{col}.issues", _in(allowed))
    if skip:
        found = f"CASE WHEN {skip} THEN {_except(found, _in(['crawl_error']))} ELSE {found} END"
    return f"list_transform({found}, lambda v: '{name}:' || v)"


_same = lambda a, b, k: f"{a}.{_KEYS[k]} IS NOT DISTINCT FROM {b}.{_KEYS[k]}"
_systematic = lambda k: f"{_same('b1', 'b2', k)} AND {_same('h1', 'h2', k)} AND NOT ({_same('b1', 'h1', k)})"
_C3 = "list_contains(fired1, 'C3')"
_clear = lambda n: f"NOT list_has_any({n}.issues, {_in(C.BLOCKING)})"
_SPECIFIC_H = _within("h1.mechanisms", _HIGH)
#: The judged page: the first observation that nothing blocks, after its scripts ran where there is such a view.
_CHOICES = [(n, name, n.startswith("h")) for n, name in (("h1", "human#1"), ("h2", "human#2"), ("b1", "bot#1"), ("b2", "bot#2"))]


def _pick(what) -> str:
    """CASE over the candidates; ``what(row, name, view)`` gives the value."""
    steps = []
    for n, name, browser in _CHOICES:
        if browser:
            steps.append(f"WHEN coalesce({n}d.html, '') <> '' AND {_clear(n + 'd')} THEN {what(n + 'd', name, 'dom')}")
            steps.append(f"WHEN coalesce({n}d.html, '') = '' AND {_clear(n)} THEN {what(n, name, 'html')}")
        else:
            steps.append(f"WHEN {_clear(n)} THEN {what(n, name, 'html')}")
    return "CASE " + " ".join(steps)


_PAGE_ISSUES = _pick(lambda n, name, view: f"{n}.issues" if view == "dom" else f"list_sort(list_append({n}.issues, 'analysis_without_js_execution'))") + " ELSE CASE WHEN coalesce(h1d.html, '') <> '' THEN h1d.issues ELSE h1.issues END END"
_DIFFERS = {
    "referer": ("vr", ("b1", "b2"), ""), "mobile": ("vm", ("h1", "h2"), "d"),
}


def _variant(name: str) -> tuple[str, str]:
    """(status, keys) of a variant's signal."""
    v, (a, b), view = _DIFFERS[name]
    keys = {"status": "status", "final_host": "final_host", "mechanisms": "mechanisms", "title": "low_title"}
    of = lambda n, k: f"{n}.{k}" if k == "status" or not view else (f"coalesce({n}d.{k}, {'[]' if k == 'mechanisms' else _q('')})" if k != "final_host" else f"{n}.dom_host")
    parts = []
    for k, c in keys.items():
        x, y = of(a, c), of(b, c)
        other = f"CASE WHEN {_clear(a)} THEN {x} ELSE {y} END"
        parts.append((k, f"(NOT ({_clear(a)} AND {_clear(b)}) OR {x} IS NOT DISTINCT FROM {y}) AND ({other}) IS DISTINCT FROM {v}.{c}"))
    differs = _some(parts)
    status = f"CASE WHEN {v}.page_id IS NULL THEN 'not_tested' WHEN NOT ({_clear(v)} AND ({_clear(a)} OR {_clear(b)})) THEN 'unmeasurable' WHEN len({differs}) > 0 THEN 'observed' ELSE 'not_observed' END"
    return status, f"CASE WHEN {v}.page_id IS NULL THEN [] ELSE {differs} END"


_JOINS = " ".join(f"JOIN o {n} ON {n}.page_id = b1.page_id AND {n}.slot = '{'bot' if n[0] == 'b' else 'human'}' AND {n}.replicate = {n[1]}" for n in ("b2", "h1", "h2")) + " " + " ".join(f"LEFT JOIN {v} {n}{v} ON {n}{v}.page_id = b1.page_id AND {n}{v}.replicate = {n[1]}" for n in ("h1", "h2") for v in ("d", "e")) + " LEFT JOIN vr ON vr.page_id = b1.page_id LEFT JOIN vm ON vm.page_id = b1.page_id"
_SIDES = f"""
vw AS MATERIALIZED (SELECT {_REST}, lower(text) AS lower_text, view, variant FROM (SELECT *, final_value AS final_score FROM isu)),
o AS (SELECT *, lower(regexp_extract(trim(coalesce(page_url, final)), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS dom_host FROM vw WHERE view = 'html' AND variant = ''), d AS (SELECT * FROM vw WHERE view = 'dom'), e AS (SELECT * FROM vw WHERE view = 'early'),
vr AS (SELECT * FROM vw WHERE variant = 'referer'), vm AS (SELECT * FROM vw WHERE variant = 'mobile')"""
_LABEL = f"""
pr AS MATERIALIZED (SELECT b1.page_id, b1.asked, b1.s, {_side("b1", "h1", "1")}, {_side("b2", "h2", "2")},
    {_pick(lambda n, name, view: _q(name))} ELSE '' END AS page_name, {_pick(lambda n, name, view: _q(view))} ELSE '' END AS page_view, {_PAGE_ISSUES} AS page_issues, {_pick(lambda n, name, view: f"{n}.static_rules")} ELSE [] END AS static_rules, {_pick(lambda n, name, view: f"{n}.techniques")} ELSE [] END AS techniques,
    {_pick(lambda n, name, view: f"{n}.score")} ELSE 0.0::DOUBLE END AS page_score, {_pick(lambda n, name, view: f"{n}.decisive")} ELSE [] END AS page_decisive, {_pick(lambda n, name, view: f"{n}.obfuscated")} ELSE 0 END AS page_obfuscated, {_pick(lambda n, name, view: f"length({n}.html)")} ELSE 0 END AS page_length, {_variant("referer")[0]} AS referer, {_variant("referer")[1]} AS referer_keys, {_variant("mobile")[0]} AS mobile, {_variant("mobile")[1]} AS mobile_keys,
    {_cat(_one(f"NOT ({_same(f'{x}1', f'{x}2', k)})", f"{n}_unstable_{k}") for x, n in (("b", "bot"), ("h", "human")) for k in P.STABLE)} AS unstable,
    {_cat(_one(_systematic(k), f"systematic_{k}_difference_without_mechanism_evidence") for k in P.SYSTEMATIC)} AS steady,
    {_cat(_one(f"coalesce({n}d.html, '') <> '' AND len({_except(f'{n}d.mechanisms', f'{n}.mechanisms')}) > 0", f"{name}:js_rendered_mechanisms_not_compared") for n, name in (("h1", "human#1"), ("h2", "human#2")))} AS rendered,
    b1, b2, h1, h2, h1d, h2d, h1e, h2e, {_SPECIFIC_H} AS specific FROM o b1 {_JOINS} WHERE b1.slot = 'bot' AND b1.replicate = 1),
blk AS (SELECT *, {_cat([_tag("b1", "bot#1", P.RULE_BOT, _C3), _tag("h1", "human#1", P.UNUSABLE)])} AS block, {_cat([_tag("h1", "human#1", P.TRUE_HUMAN), _tag("h2", "human#2", P.TRUE_HUMAN), _tag("b1", "bot#1", P.TRUE_BOT, _C3), _tag("b2", "bot#2", P.TRUE_BOT, _C3)])} AS bt,
    {_cat(_tag(c, n, P.FALSE_ALL) for c, n in _NAMES)} AS bf, {_cat([_one("referer = 'observed'", "variant_difference_unconfirmed:referer"), _one("mobile = 'observed'", "variant_difference_unconfirmed:mobile")])} AS changed FROM pr),
rl AS (SELECT *, CASE WHEN len(block) > 0 THEN 'unknown' WHEN len(fired1) > 0 THEN 'true' ELSE 'false' END AS rule_label FROM blk),
why AS (SELECT *, CASE rule_label WHEN 'unknown' THEN block WHEN 'true' THEN {_cat(["bt", _one("fired1 <> fired2 OR hidden1 <> hidden2", "difference_not_replicated"), _one(f"NOT list_has_any(hidden1, {_HIGH})", "difference_without_high_specificity_evidence")])}
    ELSE {_cat(["bf", _one("len(fired2) > 0", "difference_not_replicated")])} END AS w FROM rl),
lab AS (SELECT *, {_cat(["w", "CASE WHEN rule_label = 'false' AND len(w) = 0 THEN flatten([unstable, steady, rendered]) ELSE [] END", "CASE WHEN rule_label = 'false' THEN flatten([CASE WHEN len(static_rules) > 0 THEN ['frontend_cloaking_code_present:' || array_to_string(static_rules, ',')] ELSE [] END, changed]) ELSE [] END", _one("rule_label <> 'unknown' AND (len(rev1) > 0 OR len(rev2) > 0)", "reverse_difference_or_order_effect")])} AS reasons FROM why),
res AS (SELECT *, CASE WHEN rule_label <> 'unknown' AND len(reasons) = 0 THEN rule_label ELSE 'unknown' END AS label,
    CASE WHEN len(fired1) > 0 THEN list_transform(fired1, lambda x: x || ':' || CASE x WHEN 'C1' THEN array_to_string(hidden1, ',') WHEN 'C5' THEN h1.final ELSE array_to_string(list_sort(specific), ',') END)
    ELSE {_cat(["CASE WHEN len(shared1) > 0 THEN ['same_mechanisms:' || array_to_string(shared1, ',')] WHEN len(h1.mechanisms) = 0 THEN ['no_mechanisms'] ELSE [] END", _one("blocked1 AND len(specific) = 0", "anti_bot_only"), _one("fork1", "benign_fork")])} END AS evidence FROM lab)"""
_W = "(t / n::DOUBLE + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {sign} 1.96 * sqrt(t / n::DOUBLE * (1 - t / n::DOUBLE) / n + 3.8416 / (4 * n::DOUBLE * n)) / (1 + 3.8416 / n)"
CHAIN = f"WITH {_OBS}, {_VIEWS}, {_EVAL}, {_FACTS}, {_SIDES}, {_LABEL} "
ALL_CHAIN = f"WITH {_OBS}, {_VIEWS}, {_EVAL}, {_ALL_FACTS}, {_SIDES}, {_LABEL} "
FEED = f"{_V}, src AS (SELECT page_id * {len(VARIANTS)} + variant + 1 AS line, regexp_replace(url, '(?s)[?#].*$', '') AS url FROM variants), {_N}, d AS (SELECT line, url, normalized, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY normalized ORDER BY line) > 1 THEN 'duplicate_normalized_url' END AS reason FROM normal)"
SQL = {
    "url_normalize": f"WITH {_V}, src AS (SELECT * FROM variants), {_N} SELECT page_id, variant, normalized, reason FROM normal",
    "url_registered_domain": f"WITH {_V}, h AS (SELECT page_id, variant, {_HOST} AS host FROM variants) SELECT page_id, variant, host, {_domain('host')} AS domain FROM h",
    "url_entropy": "WITH c AS (SELECT page_id, length(url) AS n, c, count(*) AS k FROM (SELECT page_id, url, unnest(string_split(url, '')) AS c FROM pages) WHERE c <> '' GROUP BY ALL) SELECT page_id, round(sum(-(k / n::DOUBLE) * log2(k / n::DOUBLE)), 9) AS bits FROM c GROUP BY page_id",
    "crawl_order": "SELECT page_id, substr(sha1(url), 1, 12) AS url_hash, substr(sha1(url), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS human_first FROM pages",
    "feed_import": f"WITH {FEED} SELECT line, url AS raw_url, reason, normalized AS normalized_url, reason IS NULL AS accepted FROM d",
    "page_rules": f"WITH {_OBS}, {_VIEWS}, {_EVAL} SELECT page_id, {', '.join(C.CATEGORIES)}, array_to_string(flags, '|') AS flags, array_to_string(decisive, '|') AS decisive, round(least(0.9::DOUBLE, final_value), 6) AS score, is_phishing FROM ev WHERE view = 'html' AND variant = '' AND slot = 'human' AND replicate = 1",
    "observation_rules": f"WITH {_OBS}, {_VIEWS}, {_EVAL} SELECT page_id, slot, replicate, {', '.join(C.CATEGORIES)}, array_to_string(flags, '|') AS flags, array_to_string(decisive, '|') AS decisive, round(least(0.9::DOUBLE, final_value), 6) AS score, is_phishing FROM ev WHERE view = 'html' AND variant = ''",
    "url_risk": f"WITH obs AS (SELECT page_id, variant, 'https://' || a || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || b || c AS url, '' AS html FROM pages CROSS JOIN (VALUES {', '.join(f'({i}, {_q(a)}, {_q(b)}, {_q(c)})' for i, (a, b, c) in enumerate(RISKS))}) t(variant, a, b, c)), {_EVAL} SELECT page_id, variant, array_to_string(flags, '|') AS flags, array_to_string(decisive, '|') AS decisive, round(least(0.9::DOUBLE, final_value), 6) AS score FROM ev",
    "page_structure": f"WITH obs AS (SELECT page_id, url, html || {_list(map(_q, PIECES))}[page_id % {len(PIECES)} + 1] AS html FROM pages), {_EVAL} SELECT page_id, array_to_string(flags, '|') AS flags, array_to_string(decisive, '|') AS decisive, array_to_string(mechanisms, '|') AS mechanisms, round(least(0.9::DOUBLE, final_value), 6) AS score, is_phishing FROM ev",
    "frontend_signatures": f"WITH t AS (SELECT page_id, html || {_list(map(_q, SNIPPETS))}[page_id % {len(SNIPPETS)} + 1] AS html FROM pages), c AS (SELECT page_id, list_sort(list_filter({_list(f"CASE WHEN {' OR '.join(_rx('html', '(?i)' + p) for p in patterns)} THEN '{k}' END" for k, patterns in C.SIGNATURES.items())}, lambda v: v IS NOT NULL)) AS t FROM t) SELECT page_id, array_to_string(t, '|') AS techniques, array_to_string(list_filter({_list(f"CASE WHEN {' AND '.join(f'list_has_any(t, {_list(map(_q, g))})' for g in groups)} THEN '{k}' END" for k, groups in C.SIGNATURE_RULES.items())}, lambda v: v IS NOT NULL), '|') AS static_rules FROM c",
    "observation_issues": f"WITH {_OBS}, {_VIEWS}, {_EVAL}, {_FACTS} SELECT slot, replicate, view, issue, count(*) AS n FROM (SELECT slot, replicate, view, unnest(issues) AS issue FROM isu WHERE variant = '' AND view <> 'early') GROUP BY ALL",
    "cloaking_label": CHAIN
    + """SELECT page_id, array_to_string(fired1, '|') AS fired, array_to_string(hidden1, '|') AS hidden, array_to_string(rev1, '|') AS reverse, blocked1 AS channel_blocked, array_to_string(evidence, '|') AS evidence, rule_label, label, array_to_string(reasons, '|') AS reasons,
    CASE label WHEN 'true' THEN 'rules=' || array_to_string(fired1, '+') || ' in both pairs; hidden_from_bot=' || array_to_string(hidden1, ',') WHEN 'false' THEN 'no rule in either pair; equal across clients and stable within each' ELSE 'rule=' || rule_label || '; gated by ' || len(reasons) || ' reason(s)' END AS basis,
    CASE label WHEN 'true' THEN 'replicated_client_type_mechanism_difference' WHEN 'false' THEN 'not_observed_in_tested_client_types' ELSE array_to_string(reasons, ';') END AS reason FROM res""",
    "reason_counts": CHAIN + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM res) GROUP BY reason",
    "label_prevalence": CHAIN + f", g AS (SELECT page_id % 3 AS cohort, count(*) AS n, count(*) FILTER (label = 'true') AS t, count(*) FILTER (label = 'false') AS f, count(*) FILTER (label = 'unknown') AS na FROM res GROUP BY 1) SELECT cohort, n, t, f, na, round(t / n::DOUBLE, 9) AS lower, round((t + na) / n::DOUBLE, 9) AS upper, round(t / nullif(t + f, 0)::DOUBLE, 9) AS conditional, round(greatest(0.0, {_W.format(sign='-')}), 9) AS ci_lo, round(least(1.0, {_W.format(sign='+')}), 9) AS ci_hi FROM g",
    "annotator_kappa": "WITH a AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS po FROM a), p AS (SELECT sum(x.k * y.k) / (SELECT n * n FROM t)::DOUBLE AS pe FROM (SELECT a, count(*) AS k FROM a GROUP BY a) x JOIN (SELECT b, count(*) AS k FROM a GROUP BY b) y ON x.a = y.b) SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa FROM t, p",
}
