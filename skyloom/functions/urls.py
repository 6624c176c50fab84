"""URL functions as columns. Split by one pattern, not by java.net.URI, which drops hosts it finds odd."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalogue import FREE_HOSTS, SECOND_LEVEL, suffixes

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: What Python's strip takes from both ends, within ASCII.
_ENDS = r"^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$"


def stripped(url: Column) -> Column:
    return F.regexp_replace(url, _ENDS, "")


def _pieces(url: Column) -> dict[str, Column]:
    u = stripped(url)
    netloc = F.regexp_extract(u, _PARTS, 2)
    place = F.regexp_extract(netloc, "([^@]*)$", 1)
    return {"u": u, "scheme": F.lower(F.regexp_extract(u, _PARTS, 1)), "netloc": netloc, "host": F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1), "port": F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1), "path": F.regexp_extract(u, _PARTS, 3), "query": F.regexp_extract(u, _PARTS, 4), "fragment": F.regexp_extract(u, _PARTS, 5)}


def reject_reason(url: Column) -> Column:
    """Why a URL is not accepted, or null."""
    p = _pieces(url)
    return (
        F.when(p["u"].isNull() | (p["u"] == "") | p["u"].rlike(r"[\x00-\x20\x7f\\]"), "invalid_url_characters")
        .when(~p["scheme"].isin("http", "https") | (p["host"] == ""), "http_url_required").when(p["netloc"].contains("@"), "userinfo_not_allowed")
        .when((p["port"] != "") & (~p["port"].rlike("^[0-9]+$") | (F.length(F.regexp_replace(p["port"], "^0+", "")) > 5) | (F.coalesce(p["port"].try_cast("int"), F.lit(0)) > 65535)), "invalid_port")
        .when(~p["host"].startswith("[") & p["host"].rlike(r"^\.|\.\.|[^.]{64}"), "invalid_host")
    )


@F.arrow_udf(T.StringType())
def idna(hosts: pa.Array) -> pa.Array:
    """Hosts in their ASCII form; null where there is none. Called for hosts with other characters only."""

    def one(host: str | None) -> str | None:
        try:
            return None if host is None else host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return pa.array([one(h) for h in hosts.to_pylist()], pa.string())


def normalize_url(url: Column, international: bool = False) -> Column:
    """Lower-case scheme and host, no default or empty port, ``/`` for an empty path, no empty query or fragment; null where rejected.

    Path, query and fragment stay as written. ``international``: hosts with other than ASCII characters are converted by an
    Arrow function; without it they are lower-cased only.
    """
    p = _pieces(url)
    host = F.lower(p["host"])
    if international:
        host = F.when(host.rlike(r"[^\x00-\x7F]"), F.lower(idna(F.when(host.rlike(r"[^\x00-\x7F]"), host)))).otherwise(host)
    port = F.regexp_replace(p["port"], "^0+", "")
    usual = (port == "") | ((p["scheme"] == "http") & (port == "80")) | ((p["scheme"] == "https") & (port == "443"))
    tail = lambda c, sign: F.when(p[c] == sign, "").otherwise(p[c])
    full = F.concat(p["scheme"], F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(p["path"] == "", "/").otherwise(p["path"]), tail("query", "?"), tail("fragment", "#"))
    return F.when(reject_reason(url).isNull(), full)


def origin(url: Column) -> Column:
    """Scheme, host and port of an accepted URL."""
    return F.nullif(F.regexp_extract(normalize_url(url), "^([a-z]+://[^/]*)", 1), F.lit(""))


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Network location, path and query, without ``?``; empty where the URL has no scheme."""
    return F.regexp_extract(url, _PARTS, 2), F.regexp_extract(url, _PARTS, 3), F.regexp_replace(F.regexp_extract(url, _PARTS, 4), r"^\?", "")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels, three below a second-level or free-hosting suffix."""
    h = F.lower(F.regexp_extract(host, "^([^:]*)", 1))
    two, three, four = (F.regexp_extract(h, rf"((?:[^.]*\.){{{n}}}[^.]*)$", 1) for n in (1, 2, 3))
    base = F.when(F.regexp_extract(h, r"[^.]*\.([^.]*)\.[^.]*$", 1).isin(*SECOND_LEVEL), three).otherwise(two)
    more = F.when(base == three, four).otherwise(three)
    free = F.concat(F.lit("."), base).rlike("^" + suffixes(FREE_HOSTS))
    return F.when(two == "", h).when(free & (more != ""), more).otherwise(base)


def entropy(text: Column) -> Column:
    """Shannon bits per character."""
    n = F.length(text).cast("double")
    chars = F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    share = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 12)


def human_first(url: Column) -> Column:
    """Who goes first: the low bit of the first SHA-1 byte."""
    return F.substring(F.sha1(url), 2, 1).isin("1", "3", "5", "7", "9", "b", "d", "f")
