"""Columns of one recorded observation: visible text, title, scripts, gates, issue codes, headers, types, decoding."""

from __future__ import annotations

import codecs
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalogue as C

UNSEEN = r"(?is)<script\b.*?</script\s{0,9}>|<style\b.*?</style\s{0,9}>|<noscript\b.*?</noscript\s{0,9}>|<!--.*?-->"
#: The same with its first sign once, which spares Java's matcher four attempts at every other character.
_UNSEEN = UNSEEN.replace("|<", "|").replace("(?is)<", "(?is)<(?:", 1) + ")"
#: Runs of white space other than one blank, which stays as it is.
_SPACES = r"\s(?:\s+|(?<! ))"
#: What stands before the first visible character: white space, what is unseen, and tags, in which unseen parts are passed as well.
_NO_TEXT = rf"(?is)\A(?>\s++|{_UNSEEN[5:]}|<(?>[^<>]++|{_UNSEEN[5:]}|<)*+>)*+"
TAG, TITLE = "<[^>]*>", r"(?is)<title\b[^>]*>(.*?)</title\s{0,9}>"
SCRIPT, SCRIPT_SOURCE = r"(?is)<script\b([^>]*)>(.*?)</script\s{0,9}>", r"(?i)\bsrc\s{0,9}=\s{0,9}['\"]([^'\"]+)"
HANDLER_DOUBLE, HANDLER_SINGLE = r"(?i)\bon[a-z]+\s{0,9}=\s{0,9}\"([^\"]*)\"", r"(?i)\bon[a-z]+\s{0,9}=\s{0,9}'([^']*)'"
INLINE_SCRIPTS, INLINE_CHARS, DOCUMENT_CHARS = 30, 60_000, 2_000_000


def _text(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles, noscript and comments, the title's included, with runs of white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(_text(html), _UNSEEN, " "), TAG, " ")
    return F.trim(F.regexp_replace(bare, _SPACES, " "))


def has_text(html: Column) -> Column:
    """Whether there is any visible text; looks no further than its first character."""
    return _text(html).rlike(_NO_TEXT + r"\S")


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(_text(html), TITLE, 1), TAG, " "), r"\s+", " "))


def inline_scripts(html: Column) -> Column:
    """Bodies of all scripts without a source that are not empty, whole."""
    whole = F.regexp_extract_all(_text(html), F.lit(SCRIPT), 0)
    own = F.filter(whole, lambda s: (F.regexp_extract(F.regexp_extract(s, SCRIPT, 1), SCRIPT_SOURCE, 1) == "") & (F.regexp_extract(s, SCRIPT, 2) != ""))
    return F.transform(own, lambda s: F.regexp_extract(s, SCRIPT, 2))


def first_scripts(scripts: Column, most: int = INLINE_SCRIPTS, chars: int = INLINE_CHARS) -> Column:
    """The first ``most`` scripts of an array, cut to ``chars``."""
    return F.transform(F.slice(scripts, 1, most), lambda s: F.substring(s, 1, chars))


def external_scripts(html: Column, base: Column) -> Column:
    """Sources of scripts, joined to the page's own address."""
    found = F.transform(F.regexp_extract_all(_text(html), F.lit(SCRIPT), 1), lambda a: F.regexp_extract(a, SCRIPT_SOURCE, 1))
    return F.transform(F.filter(found, lambda u: u != ""), lambda u: join_url(base, u))


def join_url(base: Column, link: Column) -> Column:
    """An address seen from a page: absolute, scheme-relative, host-relative or in the page's folder; dots are left in."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, link))
    )


def script_inventory(scripts: Column) -> Column:
    return F.transform(scripts, lambda s: F.struct(F.sha2(s, 256).alias("sha256"), F.length(s).alias("length")))


def script_set(scripts: Column) -> Column:
    """One hash of what scripts there are, whatever their order and number."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.transform(scripts, lambda s: F.sha2(s, 256)))), ","), 256)


def _handlers(html: Column) -> Column:
    return F.concat_ws(" ", F.regexp_extract_all(html, F.lit(HANDLER_DOUBLE), 1), F.regexp_extract_all(html, F.lit(HANDLER_SINGLE), 1))


#: Patterns of the gates that are looked for in a page's markup and scripts.
GATE_PATTERNS = [pattern for _, scope, pattern in C.GATES if scope != "text"]
#: Words that a page holds where its visible text has a gate, by the gate's alternatives. What visible text drops leaves a blank, so a word
#: of it stands in the page as it is.
_TOLD = [branch for _, scope, pattern in C.GATES if scope == "text" for branch in C.words(pattern)]
GATE_WORDS = sorted({w for branch in _TOLD for w in branch})


def may_tell(html: Column, found: Column | None = None, told=_TOLD) -> Column:
    """Whether a page holds all words of one of the alternatives that gates of visible text have. ``found``: those of its words, where they are known."""
    seen = lambda w: F.array_contains(found, w) if found is not None else F.lower(_text(html)).contains(w)
    return reduce(Column.__or__, [reduce(Column.__and__, map(seen, branch)) for branch in told])


def gates(html: Column, text: Column | None = None, found: Column | None = None) -> Column:
    """Sorted names of the gates on a page, each looked for in its own scope; none is ever passed.

    A scope is taken from the page, and a pattern run over it, only where the page holds a literal that the pattern needs (those
    of handlers and scripts have no blank, so none spans two of them). ``found``: such literals of the page, where they are known.
    """
    html = _text(html)
    text = visible_text(html) if text is None else _text(text)
    where = {"markup": html, "handler": _handlers(html), "script": F.concat_ws(" ", F.regexp_extract_all(html, F.lit(SCRIPT), 2), _handlers(html)), "text": text}

    def gate(name: str, scope: str, pattern: str) -> Column:
        seen = lambda n: F.array_contains(found, n) if found is not None else F.lower(html).contains(n)
        first = may_tell(html, found, C.words(pattern)) if scope == "text" else reduce(Column.__or__, map(seen, C.needles(pattern)))
        return F.when(first, F.when(where[scope].rlike(f"(?i){pattern}"), F.lit(name)))

    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[gate(*g) for g in C.GATES]))))


def issues(view: str = "html", length: str = "text_length") -> Column:
    """Sorted issue codes of an observation, by its server document (``html``) or by the page after its scripts ran (``dom``).

    Reads status, error, non_html and the view's struct ``html`` or ``dom`` of page facts (length, text_length or what
    ``length`` names, such as visible, gates); for
    ``html`` truncated and body_error, for ``dom`` dom_truncated, blocked and failed (content-affecting requests), dialogs,
    downloads and popups.
    """
    dom = view == "dom"
    size, text = (F.coalesce(F.col(f"{view}.{k}").cast("int"), F.lit(0)) for k in ("length", length))
    found = F.coalesce(F.col(f"{view}.gates"), F.array().cast("array<string>"))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.coalesce("status", F.lit(0))
    no_body = ~yes("non_html") & (status != 0) & (size == 0)
    lost = F.lit(False) if dom else F.coalesce("body_error", F.lit("")) != ""
    codes = [
        ((F.coalesce("error", F.lit("")) != "") | (status == 0), "crawl_error"), ((status != 0) & ~status.between(200, 299), "http_error_status"), (yes("non_html"), "non_html_document"),
        (no_body & lost, "document_body_unavailable"), (no_body & ~lost, "empty_document"), (yes("dom_truncated" if dom else "truncated"), "content_truncated"), ((size > 0) & (text == 0), "blank_visible_text"),
        (F.arrays_overlap(found, F.array(*map(F.lit, C.CHALLENGES))), "challenge_or_block_page"), (F.arrays_overlap(found, F.array(*map(F.lit, C.INTERACTIONS))), "interaction_gate"),
    ]
    if dom:
        codes += [(some(c), name) for c, name in (("blocked", "content_requests_blocked"), ("failed", "content_requests_failed"), ("dialogs", "dialog_dismissed"), ("downloads", "download_blocked"), ("popups", "popup_closed"))]
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in codes])))


def among(codes: Column, allowed) -> Column:
    """Issue codes of one of the sets: blocking, caveats."""
    return F.array_sort(F.array_intersect(codes, F.array(*map(F.lit, allowed))))


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name; of several the one whose name sorts first, empty for none."""
    found = F.array_sort(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower()))
    return F.coalesce(F.try_element_at(F.transform(found, lambda e: e["value"]), F.lit(1)), F.lit(""))


def is_document_type(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.regexp_extract(_text(content_type), "^([^;]*)", 1)))
    return (kind == "") | kind.startswith("text/") | kind.isin("application/xhtml+xml", "application/xml", "application/json", "application/javascript")


#: Words of a browser's error text and the kind they mean, the first that fits (fixed values).
ERROR_KINDS = (
    ("Timeout|timeout", "timeout"), ("ERR_NAME_NOT_RESOLVED", "dns"), ("ERR_CERT|SSL", "tls"), ("ERR_HTTP2_PROTOCOL_ERROR", "protocol_error"), ("ERR_BLOCKED_BY_CLIENT|request_outside_scope", "blocked_by_policy"), ("Download is starting", "download"),
    ("ERR_CONNECTION|ERR_EMPTY_RESPONSE", "connection"),
)
#: The same for the plain client's exceptions, by their names and text.
EXCEPTION_KINDS = (
    ("SSLError", "tls"), ("Timeout", "timeout"), ("NameResolutionError|getaddrinfo|Name or service not known", "dns"), ("RemoteDisconnected|ConnectionResetError|Connection aborted", "connection_reset"), ("ConnectionError", "connection"),
    ("InvalidURL|MissingSchema|InvalidSchema", "invalid_url"),
)


def error_kind(error: Column, kinds=ERROR_KINDS) -> Column:
    """What kind of failure an error's text tells of; ``other`` for the rest, null for none."""
    text = _text(error)
    out = F.when(text == "", F.lit(None).cast("string"))
    for words, kind in kinds:
        out = out.when(text.rlike(words), kind)
    return out.otherwise("other")


#: Request policy (fixed values): methods that only read, channels that only send, types whose loss can hide content.
READ_METHODS, CHANNELS, CONTENT_TYPES = ("GET", "HEAD"), ("websocket", "eventsource", "ping"), ("document", "script", "xhr", "fetch", "websocket", "eventsource")


def block_reason(method: Column, kind: Column, subframe: Column, count: Column, budget: Column, permitted: Column) -> Column:
    """Why a page's own request was stopped, or an empty string. ``permitted``: its address was within the run's scope."""
    return (
        F.when(~method.isin(*READ_METHODS), "non_read_method").when(kind.isin(*CHANNELS), "persistent_or_beacon_channel").when(subframe, "secondary_navigation_blocked")
        .when(F.coalesce(count > budget, F.lit(False)), "request_budget_exceeded").when(~permitted, "request_outside_scope").otherwise("")
    )


def content_affecting(kind: Column, reason: Column, subframe: Column) -> Column:
    """Whether a stopped or failed request can leave a gap in the page that is judged."""
    elsewhere = subframe | (reason == "secondary_navigation_blocked")
    return ~elsewhere & ((reason == "request_budget_exceeded") | kind.isin(*CONTENT_TYPES))


def cloaking_projection(label: Column) -> Column:
    return F.when(label == "true", "True").when(label == "false", "False").otherwise("N/A")


def phishing_projection(verdict: Column) -> Column:
    return F.when(verdict == "phishing", "True").when(verdict == "not_detected", "False").otherwise("N/A")


def assessment(status: Column, value: Column) -> Column:
    """What a model said: ``not_run`` without a call, its value if the answer was valid, else ``unavailable``."""
    return F.when(status.isNull(), "not_run").when(status == "valid", value).otherwise("unavailable")


HEADER_CHARSET, META_CHARSET = r"(?i)charset\s{0,9}=\s{0,9}\"?([A-Za-z0-9_:.-]+)", r"(?i)<meta[^>]+charset\s{0,9}=\s{0,9}[\"']?\s{0,9}([A-Za-z0-9_:.-]+)"


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())]))
def decode_body(body: pa.Array, content_type: pa.Array) -> pa.Array:
    """The text of each body and ``name:source`` of its charset: byte order mark, header, meta tag of the first 4096 bytes, UTF-8.

    Unknown names fall through to the next source; bytes that are not of the charset become U+FFFD. Spark's own ``decode``
    fails on such bytes and knows a handful of charsets, hence Python's here.
    """
    rows = []
    for raw, declared in zip(body.to_pylist(), content_type.to_pylist(), strict=True):
        raw = raw or b""
        sources = [(m.group(1), name) for m, name in ((re.search(HEADER_CHARSET, declared or ""), "header"), (re.search(META_CHARSET, raw[:4096].decode("latin-1")), "meta")) if m]
        if raw[:3] == codecs.BOM_UTF8:
            raw, sources = raw[3:], [("utf-8", "bom")]
        elif raw[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
            sources = [("utf-16", "bom")]
        for name, source in [*sources, ("utf-8", "default")]:
            try:
                text = raw.decode(name, "replace")
            except LookupError:
                continue
            rows.append({"text": text.encode("utf-8", "replace").decode(), "charset": f"{name.lower()}:{source}"})
            break
    return pa.array(rows, pa.struct([("text", pa.string()), ("charset", pa.string())]))


def fill_document(df: DataFrame, body: str = "body", content_type: str = "content_type", url: str = "url", chars: int = DOCUMENT_CHARS) -> DataFrame:
    """A recorded body as a document, in one step: content_type, charset, body_sha256, html_length (whole), truncated, html (cut), html_sha256, text_content, title, scripts.

    A null body is an empty document; ``truncated`` also stays true where it was; other columns of these names are replaced.
    """
    new = ("content_type", "charset", "body_sha256", "html_length", "truncated", "html", "html_sha256", "text_content", "title", "scripts")
    before = F.coalesce(F.col("truncated"), F.lit(False)) if "truncated" in df.columns else F.lit(False)
    rows = df.withColumns({"__d": decode_body(F.col(body), F.col(content_type)), "__t": before, "content_type": F.coalesce(F.col(content_type), F.lit("")), "body_sha256": F.sha2(F.coalesce(F.col(body), F.lit(b"")), 256)})
    rows = rows.withColumns({"html": F.substring("__d.text", 1, chars), "html_length": F.length("__d.text"), "charset": F.col("__d.charset")}).withColumn("truncated", F.col("__t") | (F.col("html_length") > chars))
    scripts = F.struct(script_inventory(first_scripts(inline_scripts(F.col("html")))).alias("inline"), external_scripts(F.col("html"), F.coalesce(F.col(url), F.lit(""))).alias("external"))
    rows = rows.withColumns({"html_sha256": F.sha2("html", 256), "text_content": visible_text(F.col("html")), "title": title(F.col("html")), "scripts": scripts})
    return rows.select(*[c for c in df.columns if c not in (*new, body)], *new)
