"""Page evaluation as columns: category hits, URL and form structure, decisive rules, combinations, score and mechanisms.

Every step adds plain columns that later steps read more than once, which keeps the optimizer from writing a pattern out
twice, and every bonus is one term of a sum, so the plan grows with the number of rules and not faster. The literals that
patterns need are looked for in one pass over the page; a pattern runs only where one of its own was found.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalogue as C
from . import records as R
from .rules import BUILT_IN, Rules
from .text import heavily_obfuscated
from .urls import entropy, host_of, registered_domain, split_url

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FORM = r"(?is)<form\b.*?</form\s{0,9}>"
FORM_ATTRS, FORM_BODY = r"(?is)^<form\b([^>]*)>", r"(?is)^<form\b[^>]*>(.*)</form\s{0,9}>$"
CREDENTIAL_FIELD = r"(?i)<input\b[^>]*\b(?:type|name|id)\s{0,9}=\s{0,9}['\"]?(?:password|passwd|pass|pwd|pin|otp|ssn|cvv|cvc|card(?:number|no)?)\b"
ACTION = r"(?i)\baction\s{0,9}=\s{0,9}['\"]([^'\"]*)"
NO_TARGET = r"(?i)^(?:$|#|javascript:|mailto:)"
TARGET_HOST, TARGET_PATH = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", r"(?i)^(?:(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)"
VALIDATION = r"(?i)\brequired\b|\b(?:pattern|minlength|maxlength)\s{0,9}=|\btype\s{0,9}=\s{0,9}['\"]?email"
KIT_SCRIPT = rf"(?i)/(?:{'|'.join(C.KIT_SCRIPTS)})[0-9]*\.php\b"
IFRAME, IFRAME_SRC = r"(?i)<iframe\b[^>]*>", r"(?i)\bsrc\s{0,9}=\s{0,9}['\"]([^'\"]+)"
HIDDEN = r"(?i)\bhidden\b|display\s{0,9}:\s{0,9}none|opacity\s{0,9}:\s{0,9}0|\b(?:width|height)\s{0,9}=\s{0,9}['\"]?0\b"
ASSET = r"(?i)<(?:img|script|link)\b[^>]*?\b(?:src|href)\s{0,9}=\s{0,9}['\"](https?://[^'\"]+)"
IP_HOST = "^" + r"\.".join([_OCTET] * 4) + "$"
OPAQUE_PATH = r"(?i)^/([a-z]{1,3})/([a-z0-9]{6,})/*$"
BRAND_HOSTS = sorted({d for own in C.BRANDS.values() for d in own})


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _below(domain: Column, hosts) -> Column:
    return F.concat(F.lit("."), domain).rlike(C.suffixes(hosts))


#: What a page has to hold before its elements are looked for.
MARKS = ("<form", "<input", "<script", "<iframe", "<title", "http", "src")


def _threes(raw: bytes) -> np.ndarray:
    """A number below 2^16 for every three bytes in a row."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint16)
    return (b[:-2] << 11) ^ (b[1:-1] << 5) ^ b[2:]


def _rarest(literal: bytes, most: int = 3) -> list[int]:
    """The numbers of a literal's threes with the fewest of the letters that texts are full of."""
    parts = [literal[i : i + 3] for i in range(len(literal) - 2)]
    parts = sorted(parts, key=lambda part: sum(13 - b"etaoinsrhdlu".find(b) for b in part if b in b"etaoinsrhdlu"))
    return [int(_threes(part)[0]) for part in parts[:most]]


def held(text: Column, patterns, more=()) -> Column:
    """Which of ``MARKS``, of ``more`` and of the literals that the patterns need a text holds, whatever the case of A-Z.

    One pass over a text notes which of the literals' rarest three bytes in a row it has; only a literal all of whose are there is looked
    for. One of two bytes is told by what stands before its second byte.
    """
    names = list(dict.fromkeys((*MARKS, *more, *(n for p in patterns for n in C.needles(p)))))
    literals = [n.encode() for n in names]
    signs = {i: frozenset(_rarest(n)) for i, n in enumerate(literals) if len(n) > 2}
    telling, first = np.zeros(1 << 16, bool), {}
    for i, own in signs.items():
        telling[list(own)] = True
        first.setdefault(min(own), []).append(i)
    twos = {n: i for i, n in enumerate(literals) if len(n) == 2}
    seconds = {n[1] for n in twos}

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in texts.cast(pa.large_binary()):
            low = (raw.as_py() or b"").lower()
            each, threes = np.frombuffer(low, np.uint8), _threes(low)
            there = set(threes[telling[threes]].tolist())
            likely = [i for sign in there for i in first.get(sign, ()) if signs[i] <= there and literals[i] in low]
            for s in seconds:
                before = np.bincount(each[np.flatnonzero(each[1:] == s)]) if s in low else ()
                likely += [twos[two] for b in np.flatnonzero(before).tolist() if (two := bytes((b, s))) in twos]
            rows.append([names[i] for i in sorted(likely)])
        return pa.array(rows, pa.list_(pa.string()))

    return find(text)


def holds(name: str, column: str = "__held") -> Column:
    return F.array_contains(column, name)


# Long rule tables are written as SQL text: one parsed expression and not thousands of calls into the JVM.
def matches(text: str, found: str, pattern: str) -> str:
    """SQL for whether a pattern is found, without case; ``found`` names the literals that the text holds. Only ``\\n`` ends a line."""
    match = f"{text} RLIKE {_quote('(?id)' + pattern)}"
    first = " OR ".join(f"array_contains({found}, {_quote(n)})" for n in C.needles(pattern))
    return f"(({first}) AND {match})" if first else f"({match})"


def named(conditions: dict[str, str]) -> str:
    """SQL for the names, in order, whose condition holds."""
    return f"array_compact(array({', '.join(f'CASE WHEN {c} THEN {_quote(k)} END' for k, c in conditions.items())}))"


def url_flags(url: Column) -> tuple[list[tuple[str, Column]], list[Column]]:
    """Flags of the address, and the three capped boosts (brand, structure, lexical) in the order they are added.

    Reads ``__reg``, the registered domain of the network location, and ``__full``, that location and the path; the boosts read the flags as ``__u_`` columns.
    """
    url = F.coalesce(url, F.lit(""))
    netloc, raw_path, query = split_url(url)
    netloc, path, query, host = F.lower(netloc), F.lower(raw_path), F.lower(query), host_of(url)
    brand = F.expr(" OR ".join(f"(contains(__full, {_quote(b)}) AND NOT concat('.', __reg) RLIKE {_quote(C.suffixes(d))})" for b, d in C.BRANDS.items()))
    hosted = brand & _below(F.col("__reg"), C.HOSTING)
    parts = F.split(netloc, r"\.")
    n = F.size(parts)
    last = F.concat(F.lit("."), F.regexp_extract(netloc, r"([^.]*\.[^.]*)$", 1))
    registrar, risky = last.rlike(C.suffixes(C.REGISTRARS)), last.rlike(C.suffixes(C.HIGH_RISK))
    first = F.when((n >= 3) & (parts[0] != "www"), parts[0]).otherwise("")
    opaque = raw_path.rlike(OPAQUE_PATH) & ~F.lower(F.regexp_extract(raw_path, OPAQUE_PATH, 1)).isin(*C.SHORT_PREFIXES)
    size = F.length(url)
    digits = F.length(F.regexp_replace(url, "[^0-9]", "")) / F.nullif(size, F.lit(0))
    penultimate = F.when(host.contains("."), F.regexp_extract(host, r"([^.]*)\.[^.]*$", 1)).otherwise(host)
    port = F.regexp_extract(netloc, r":([0-9]{1,5})$", 1).try_cast("int")
    flags = [
        ("brand_squatting_suspicious_host", hosted), ("brand_squatting", brand & ~hosted), ("cred_param_in_url", query.rlike(C.CREDENTIAL_PARAMS)), ("suspicious_registrar", registrar),
        ("fake_service_subdomain", first.rlike(C.FAKE_SERVICES)), ("suspicious_path_keyword", path.rlike(C.PATH_KEYWORDS)), ("opaque_path_pattern", opaque), ("ip_in_hostname", host.rlike(IP_HOST)),
        ("at_symbol_in_url", url.rlike("://[^/]*@")), ("punycode_domain", netloc.contains("xn--")), ("url_extreme_length", size > 120), ("url_long", size.between(76, 120)),
        ("high_digit_ratio", F.coalesce(digits > 0.10, F.lit(False))), ("high_entropy", F.coalesce(entropy(url) > 4.2, F.lit(False))), ("high_hyphen_density", F.length(F.regexp_replace(penultimate, "[^-]", "")) >= 4),
        ("non_standard_port", F.coalesce(port.between(1, 65535) & ~port.isin(80, 443), F.lit(False))), ("risky", risky),
    ]
    w = lambda name, weight: F.when(F.col(f"__u_{name}"), weight).otherwise(0.0)
    brands = F.when(F.col("__u_brand_squatting_suspicious_host"), 0.50).when(F.col("__u_brand_squatting"), 0.30).otherwise(0.0)
    structure = w("cred_param_in_url", 0.22) + F.when(F.col("__u_risky"), 0.30).when(F.col("__u_suspicious_registrar"), 0.18).otherwise(0.0) + w("fake_service_subdomain", 0.15) + w("suspicious_path_keyword", 0.08) + w("opaque_path_pattern", 0.14)
    lexical = w("ip_in_hostname", 0.30) + w("at_symbol_in_url", 0.45) + w("punycode_domain", 0.35) + F.when(F.col("__u_url_extreme_length"), 0.16).when(F.col("__u_url_long"), 0.09).otherwise(0.0)
    lexical = lexical + w("high_digit_ratio", 0.14) + w("high_entropy", 0.08) + w("high_hyphen_density", 0.05) + w("non_standard_port", 0.12)
    return flags, [brands, F.least(F.lit(0.55), structure), F.least(F.lit(0.60), lexical)]


def _forms(blocks: Column, page_domain: Column) -> Column:
    """What each credential form does: its target's kind and whether it validates nothing.

    One transform for each step, so that what a later step reads often is worked out once.
    """
    step = F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(F.regexp_extract(b, FORM_ATTRS, 1), ACTION, 1)).alias("action"), (~F.regexp_extract(b, FORM_BODY, 1).rlike(VALIDATION)).alias("lax")))
    step = F.transform(step, lambda f: F.struct((~f["action"].rlike(NO_TARGET)).alias("aimed"), F.lower(F.regexp_extract(f["action"], TARGET_HOST, 1)).alias("host"), F.concat(F.lit("/"), F.regexp_extract(f["action"], TARGET_PATH, 1)).rlike(KIT_SCRIPT).alias("kit"), f["lax"].alias("lax")))
    step = F.transform(step, lambda f: F.struct(f["aimed"].alias("aimed"), f["kit"].alias("kit"), f["lax"].alias("lax"), (f["host"] != "").alias("named"), f["host"].rlike(IP_HOST).alias("ip"), registered_domain(f["host"]).alias("domain")))
    away = lambda f: f["named"] & (f["domain"] != page_domain) & ~_below(f["domain"], C.COMMON_HOSTS + C.SSO_HOSTS)
    kind = lambda f: F.when(~f["aimed"], "").when(f["ip"], "ip").when(away(f), F.when(_below(f["domain"], C.FREE_HOSTS), "free").otherwise("cross")).when(f["kit"], "kit").otherwise("")
    return F.transform(step, lambda f: F.struct(kind(f).alias("kind"), f["lax"].alias("lax")))


def _patterns(rules: Rules = BUILT_IN) -> list[str]:
    return [p for _, _, patterns in rules.categories.values() for p in patterns]


def evaluate(df: DataFrame, html: str = "html", url: str = "url", extra_js: str | None = None, rules: Rules = BUILT_IN, found: str | None = None) -> DataFrame:
    """Adds hits (struct), flags, decisive, score, is_phishing and mechanisms. Null pages count as empty.

    ``rules``: categories, combinations and decisive sets, the catalogue's own or those of a table (``rules.read_rules``).
    ``found``: the column of what ``held`` found in the page for these rules, where there is one.
    """
    own_columns = df.columns
    body = F.coalesce(F.col(html), F.lit(""))
    page = F.concat(body, F.lit("\n"), F.coalesce(F.col(extra_js), F.lit(""))) if extra_js else body
    url_hits, boosts = url_flags(F.col(url))
    address = F.coalesce(F.col(url), F.lit(""))
    netloc, path, _ = split_url(address)
    df = df.withColumns({"__reg": registered_domain(netloc), "__full": F.lower(F.concat(netloc, path))}).withColumns({"__html": body, "__page": page, "__held": F.col(found) if found else held(page, _patterns(rules)), "__own": registered_domain(host_of(address)), **{f"__u_{k}": v for k, v in url_hits}})
    text = {"html": "__html", "page": "__page"}
    hits = {f"__n_{name}": F.expr(" + ".join(f"int({matches(text[scope], '__held', p)})" for p in patterns)) for name, (_, scope, patterns) in rules.categories.items()}
    empty = F.array().cast("array<string>")
    forms = F.when(holds("<form"), F.filter(F.regexp_extract_all("__html", F.lit(FORM), 0), lambda f: F.regexp_extract(f, FORM_BODY, 1).rlike(CREDENTIAL_FIELD))).otherwise(empty)
    assets = F.when(holds("http"), F.array_distinct(F.transform(F.regexp_extract_all("__html", F.lit(ASSET), 1), lambda a: registered_domain(host_of(a))))).otherwise(empty)
    frames = F.when(holds("<iframe"), F.transform(F.filter(F.regexp_extract_all("__html", F.lit(IFRAME), 0), lambda t: t.rlike(HIDDEN) & (F.regexp_extract(t, IFRAME_SRC, 1) != "")), lambda t: F.regexp_extract(t, IFRAME_SRC, 1))).otherwise(empty)
    df = df.withColumns({**hits, "__blocks": forms, "__assets": assets, "__frames": frames})
    df = df.withColumn("__forms", _forms(F.col("__blocks"), F.col("__own")))
    has = lambda kind: F.exists("__forms", lambda f: f["kind"] == kind)
    source = lambda s: F.when(F.regexp_extract(s, TARGET_HOST, 1) == "", F.col("__own")).otherwise(registered_domain(F.lower(F.regexp_extract(s, TARGET_HOST, 1))))
    structure = {
        "cred_form": F.size("__forms") > 0, "form_action_to_ip": has("ip"), "form_action_free_host": has("free"), "form_action_cross_domain": has("cross"), "form_action_kit_script": has("kit"),
        "form_without_validation": F.exists("__forms", lambda f: f["lax"]), "brand_asset_hotlink": F.exists("__assets", lambda a: a.isin(*BRAND_HOSTS) & (a != F.col("__own")) & ~_below(a, C.COMMON_HOSTS)),
        "hidden_iframe": F.exists("__frames", lambda s: ~_below(source(s), C.COMMON_HOSTS + C.SOCIAL_HOSTS + C.EMBED_HOSTS)),
    }
    worth = lambda f: F.when(f["kind"].isin("ip", "free"), 0.45).when(f["kind"] == "cross", 0.35).when(f["kind"] == "kit", 0.12).otherwise(0.0) + F.when(f["lax"], 0.05).otherwise(0.0)
    df = df.withColumns({**{f"__u_{k}": v for k, v in structure.items()}, "__forms_score": F.aggregate("__forms", F.lit(0.0), lambda s, f: s + worth(f))})
    on = {k: f"__n_{k} > 0" for k in rules.categories} | {k: f"__u_{k}" for k in (*C.FORM_FLAGS, *C.URL_FLAGS)}
    score = F.expr("0.0D" + "".join(f" + {weight}D * least(1.0D, __n_{name} / 3.0D)" for name, (weight, _, _) in rules.categories.items()))
    page_boost = F.expr("__forms_score + CASE WHEN __u_brand_asset_hotlink THEN IF(__u_cred_form, 0.25D, 0.08D) ELSE 0.0D END + IF(__u_hidden_iframe, 0.12D, 0.0D)")
    # a clamp without a bonus changes only sums above 1, which cap and threshold treat alike
    for boost in (F.least(F.lit(0.60), page_boost), *boosts):
        score = F.least(F.lit(1.0), score + boost)
    decisive = F.expr(named({k: " AND ".join(on[f] for f in flags) for k, flags in rules.decisive.items()}))
    # of their own and not taken from the flags: who asks for mechanisms alone pays for no address, score or combination
    mechanisms = F.array_sort(F.expr(named({k: c for k, c in on.items() if k in C.MECHANISMS})))
    df = df.withColumns({"__flags": F.array_sort(F.expr(named(on))), "__mechanisms": mechanisms, "__decisive": decisive, "__score": score})
    final = "__score"
    for bonus, least in rules.combos:
        met = " AND ".join(f"__n_{k} >= {n}" for k, n in least.items())
        final = f"least(1.0D, {final} + IF(size(__decisive) = 0 AND {met}, {bonus}D, 0.0D))"
    df = df.withColumn("__final", F.expr(final))
    return df.select(
        *own_columns, F.struct(*[F.col(f"__n_{k}").alias(k) for k in rules.categories]).alias("hits"), F.col("__flags").alias("flags"), F.col("__decisive").alias("decisive"), F.least(F.lit(C.CAP), "__final").alias("score"),
        ((F.size("__decisive") > 0) | (F.col("__final") >= C.THRESHOLD)).alias("is_phishing"), F.col("__mechanisms").alias("mechanisms"),
    )


#: Facts of a page that observations are compared and judged by.
FACTS = (
    "length", "html_sha256", "title", "text_length", "text_sha256", "excerpt", "form_hosts", "script_hosts", "gates", "inline", "external", "forms", "input_types", "hits", "flags", "decisive", "score", "is_phishing", "mechanisms", "techniques", "static_rules", "obfuscated",
)
#: Those that need the whole visible text; whether there is any is told by ``visible``, no one of ``FACTS`` but to be wanted instead of them,
#: as are, instead of ``inline``, which lists all own scripts of a page, ``inline_set``, one hash of their set, and ``first_inline``, which lists
#: the first of them by their beginnings (``records.first_scripts``).
TEXT_FACTS = ("text_length", "text_sha256", "excerpt")
FORM_ACTION, INPUT_TYPE = r"(?i)<form[^>]+action\s{0,9}=\s{0,9}[\"']([^\"']+)", r"(?i)<input\b[^>]*\btype\s{0,9}=\s{0,9}[\"']?([a-z]+)"
SOURCE_HOST = r"(?i)<script[^>]+src\s{0,9}=\s{0,9}[\"']([^\"']+)"


def link_hosts(html: Column, pattern: str) -> Column:
    """Sorted distinct hosts, with their ports, of the absolute addresses a pattern finds."""
    found = F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), lambda u: F.lower(F.regexp_extract(u, "^https?://([^/]+)", 1)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda h: h != "")))


def facts(df: DataFrame, html: str = "html", url: str = "url", wanted=FACTS) -> DataFrame:
    """Adds the struct ``facts`` of every page in place of its text: all ``FACTS``, or those that are ``wanted``.

    Visible text is taken from a page whole only where a fact needs it; else where the page holds the words of a gate.
    """
    own = [c for c in df.columns if c != html]
    body = F.coalesce(F.col(html), F.lit(""))
    df = df.withColumn("__found", held(body, [*_patterns(), *_SIGNS, *R.GATE_PATTERNS], R.GATE_WORDS))
    df = signatures(evaluate(df, html, url, found="__found"), html, "__found").withColumn("__body", body)
    some = lambda marks, value, none=None: F.when(reduce(Column.__and__, [holds(m, "__found") for m in marks.split()]), value).otherwise(F.array().cast("array<string>") if none is None else none)
    text = R.visible_text(F.col("__body"))
    text = text if {*TEXT_FACTS} & {*wanted} else F.when(R.may_tell(F.col("__body"), F.col("__found")), text)
    df = df.withColumns({"__text": text, "__scripts": some("<script", R.inline_scripts(F.col("__body")))})
    folded = F.lower(F.col("__text"))
    names = {
        "length": F.length("__body"), "html_sha256": F.sha2("__body", 256), "title": some("<title", R.title(F.col("__body")), F.lit("")), "text_length": F.length("__text"), "text_sha256": F.sha2(folded, 256), "excerpt": F.substring("__text", 1, 500), "visible": R.has_text(F.col("__body")),
        "form_hosts": some("<form http", link_hosts(F.col("__body"), FORM_ACTION)), "script_hosts": some("<script src http", link_hosts(F.col("__body"), SOURCE_HOST)), "gates": R.gates(F.col("__body"), F.col("__text"), F.col("__found")), "inline": R.script_inventory(F.col("__scripts")), "inline_set": R.script_set(F.col("__scripts")), "first_inline": R.script_inventory(R.first_scripts(F.col("__scripts"))), "obfuscated": heavily_obfuscated(R.first_scripts(F.col("__scripts"))),
        "external": some("<script src", R.external_scripts(F.col("__body"), F.coalesce(F.col(url), F.lit("")))), "forms": some("<form", F.regexp_count("__body", F.lit(r"(?i)<form\b[^>]*>")), F.lit(0)),
        "input_types": some("<input", F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("__body", F.lit(INPUT_TYPE), 1), F.lower))), 1, 20)),
    }
    return df.select(*own, F.struct(*[names.get(k, F.col(k)).alias(k) for k in (*FACTS, "visible", "inline_set", "first_inline") if k in wanted]).alias("facts"))


def _once(df: DataFrame, html: str, url: str, work) -> DataFrame:
    """``work`` on each distinct (page, url), joined back to the rows without their pages.

    Equal pages of a task are combined before the shuffle, so a page is sent once per task that has it and judged once.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = df.withColumn("__key", F.sha2(F.concat_ws("\x00", text(html), text(url)), 256))
    each = work(keyed.select("__key", text(html).alias(html), text(url).alias(url)).distinct(), html, url).drop(html, url)
    return keyed.drop(html).join(each, "__key").drop("__key")


def facts_once(df: DataFrame, html: str = "html", url: str = "url", wanted=FACTS) -> DataFrame:
    return _once(df, html, url, lambda pages, html, url: facts(pages, html, url, wanted))


def evaluate_once(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``evaluate`` on distinct pages; the page itself is dropped."""
    return _once(df, html, url, evaluate)


_SIGNS = [p for patterns in C.SIGNATURES.values() for p in patterns]


def signatures(df: DataFrame, text: str = "html", found: str | None = None) -> DataFrame:
    """Adds the signature categories found in scripts and page (sorted) and the rules S1 to S3 they fire."""
    df = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__held", F.col(found) if found else held(F.col("__text"), _SIGNS))
    told = named({k: " OR ".join(matches("__text", "__held", p) for p in patterns) for k, patterns in C.SIGNATURES.items()})
    df = df.withColumn("techniques", F.array_sort(F.expr(told))).drop("__text", "__held")
    either = lambda group: f"arrays_overlap(techniques, array({', '.join(map(_quote, group))}))"
    return df.withColumn("static_rules", F.expr(named({k: " AND ".join(map(either, groups)) for k, groups in C.SIGNATURE_RULES.items()})))
