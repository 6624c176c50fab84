"""Scripts of a page as columns: what encoded parts of them say, how encoded they are, and the page rules with both.

Decoding is by column functions only: each distinct encoded part of a script is replaced by what it stands for, so a script with a
million escapes costs as many replacements as it has different ones. Calls are decoded whole (``eval`` of ``atob`` or ``unescape``
of one literal), escapes one by one (a hex escape above 7F is no character alone and becomes U+FFFD, halves of surrogate pairs
without a partner stay), calls that look a number up in the script's first table of literals become that literal, and
literals that are added are joined where they meet. What is decoded may be decoded again, ``ROUNDS`` times in all. Code is
read by its signs, not parsed, and never run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import records as R
from .pages import evaluate
from .text import OBFUSCATED, is_symbol_encoded, obfuscation_score

ROUNDS, CHUNK = 2, 2500
ATOB, UNESCAPE = r"eval\s{0,9}\(\s{0,9}atob\s{0,9}\(\s{0,9}['\"]([A-Za-z0-9+/]+={0,2})['\"]\s{0,9}\)\s{0,9}\)", r"eval\s{0,9}\(\s{0,9}unescape\s{0,9}\(\s{0,9}['\"]([^'\"]+)['\"]\s{0,9}\)\s{0,9}\)"
HEX, PAIR, UNIT = r"\\x([0-9a-fA-F]{2})", r"(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})", r"\\u([0-9a-ce-fA-CE-F][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2})"
JOINS = ((r"'\s{0,9}\+\s{0,9}'", ""), (r"\"\s{0,9}\+\s{0,9}\"", ""), (r"'\s{0,9}\+\s{0,9}\"([^'\"\\]{0,999})\"", "\\1'"), (r"\"\s{0,9}\+\s{0,9}'([^'\"\\]{0,999})'", "\\1\""))
#: A table of literals, a literal, and around the table's name a function that looks it up; a call of that function.
NAME = "[A-Za-z_$][A-Za-z0-9_$]{0,60}"
TABLE, LITERAL = rf"\b(?:var|let|const)\s{{1,9}}({NAME})\s{{0,9}}=\s{{0,9}}\[([^\[\]]+)\]", r"'(?:[^'\\]|\\.){0,500}'|\"(?:[^\"\\]|\\.){0,500}\""
LOOKUP = (rf"\bfunction\s{{1,9}}({NAME})\s{{0,9}}\([^()]*\)\s{{0,9}}\{{[^{{}}]*[^A-Za-z0-9_$]", r"\s{0,9}\[")
CALL = ("", r"\(\s{0,9}(0[xX][0-9a-fA-F]{1,4}|[0-9]{1,5})\s{0,9}\)")
LOST = "�"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is read."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _each(code: Column, pattern: str, meaning) -> Column:
    """The code with every whole match replaced by ``meaning(group)``; null keeps the match."""
    swap = lambda text, m: F.replace(text, m, F.coalesce(meaning(F.regexp_extract(m, pattern, 1)), m))
    return _let(code, lambda c: F.aggregate(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), 0)), c, swap))


def _from_base64(x: Column) -> Column:
    return F.when(F.length(x) % 4 == 0, F.try_validate_utf8(F.try_to_binary(x, F.lit("base64")).cast("string")))


def _from_hex(h: Column) -> Column:
    n = F.conv(h, 16, 10).cast("int")
    return F.when(n < 128, F.char(n)).otherwise(LOST)


def _utf16(h: Column) -> Column:
    return F.decode(F.unhex(F.replace(h, F.lit("\\u"), F.lit(""))), "UTF-16BE")


def _around(parts: tuple[str, str], name: Column) -> Column:
    return F.concat(F.lit(parts[0]), F.replace(name, F.lit("$"), F.lit("\\$")), F.lit(parts[1]))


def _inlined(code: Column) -> Column:
    """Calls of the function that looks up the script's first table of literals, by the literal."""
    index = lambda m: F.regexp_extract(m, CALL[1], 1)
    number = lambda m: F.when(F.lower(index(m)).startswith("0x"), F.conv(F.substring(index(m), 3, 9), 16, 10)).otherwise(index(m)).cast("int")

    def called(c: Column, items: Column, name: Column) -> Column:
        found = F.when(name != "", F.array_distinct(F.regexp_extract_all(c, _around(CALL, name), F.lit(0)))).otherwise(F.array().cast("array<string>"))
        return F.aggregate(found, c, lambda text, m: F.replace(text, m, F.coalesce(F.get(items, number(m)), m)))

    def looked_up(c: Column, own: Column) -> Column:
        name = F.when(own["name"] != "", F.call_function("regexp_extract", c, _around(LOOKUP, own["name"]), F.lit(1))).otherwise("")
        return _let(name, lambda n: called(c, own["items"], n))

    table = lambda c: F.struct(F.regexp_extract(c, TABLE, 1).alias("name"), F.regexp_extract_all(F.regexp_extract(c, TABLE, 2), F.lit(LITERAL), F.lit(0)).alias("items"))
    return _let(code, lambda c: _let(table(c), lambda own: looked_up(c, own)))


def readable(code: Column, rounds: int = ROUNDS) -> Column:
    """The script with its encoded parts decoded; null is null."""
    for _ in range(rounds):
        code = _each(code, ATOB, _from_base64)
        code = _each(code, UNESCAPE, lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))
        code = _each(_each(_each(code, HEX, _from_hex), PAIR, _utf16), UNIT, _utf16)
        code = _inlined(code)
        for pattern, other in JOINS:
            code = F.regexp_replace(code, pattern, other.replace("\\1", "$1"))
    return code


def deobfuscate(df: DataFrame, code: str = "script") -> DataFrame:
    """Adds deobfuscated, the scores before and after, whether the script is written in signs, and whether it changed."""
    out = df.withColumn("deobfuscated", readable(F.col(code)))
    return out.withColumns({"score_before": obfuscation_score(F.col(code)), "score_after": obfuscation_score(F.col("deobfuscated")), "symbol_encoded": is_symbol_encoded(F.col(code)), "changed": ~F.col("deobfuscated").eqNullSafe(F.col(code))})


def chunks(code: Column, size: int = CHUNK) -> Column:
    """Pieces of at most ``size`` characters that end before a line end where there is one; joined, they are the script."""
    line = lambda s, at: F.substr(s, at, F.lit(size))
    fold = lambda done, piece: F.when((F.size(done) > 0) & (F.length(F.element_at(done, -1)) + F.length(piece) < size), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), piece)))).otherwise(F.concat(done, F.array(piece)))
    lines = F.transform(F.split(code, "\n"), lambda s, i: F.when(i > 0, F.concat(F.lit("\n"), s)).otherwise(s))
    cut = F.flatten(F.transform(lines, lambda s: F.when(F.length(s) < size, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(size)), lambda at: line(s, at)))))
    return F.aggregate(F.filter(cut, lambda s: s != ""), F.array().cast("array<string>"), fold)


def script_rows(pages: DataFrame, key: str = "page_id", html: str = "html", external: str | None = None) -> DataFrame:
    """One row per script of a page: place, type, src, content, readable, changed and score.

    ``external``: a column of recorded scripts as array<struct<url, content>>; those without content are left out.
    """
    own = F.transform(R.first_scripts(R.inline_scripts(F.col(html))), lambda s: F.struct(F.lit("inline").alias("type"), F.lit(None).cast("string").alias("src"), s.alias("content")))
    if external:
        there = F.filter(F.coalesce(F.col(external), F.array().cast("array<struct<url:string,content:string>>")), lambda s: F.coalesce(s["content"], F.lit("")) != "")
        own = F.concat(own, F.transform(there, lambda s: F.struct(F.lit("external").alias("type"), s["url"].alias("src"), s["content"].alias("content"))))
    rows = pages.select(key, F.posexplode(own).alias("place", "s")).select(key, "place", "s.*")
    rows = rows.withColumns({"readable": readable(F.col("content")), "score": obfuscation_score(F.col("content"))})
    return rows.withColumn("changed", F.col("readable") != F.col("content"))


def with_scripts(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", external: str | None = None) -> DataFrame:
    """The page rules on each page and the readable text of its scripts, and the counts scripts, decoded and obfuscated.

    Scripts are rows, aggregated back by page in their order. A page without scripts has zero counts.
    """
    each = script_rows(pages, key, html, external).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "readable"))), lambda s: s["readable"]), "\n").alias("__js"), F.count("*").alias("scripts"), F.sum(F.col("changed").cast("int")).alias("decoded"), F.sum((F.col("score") > OBFUSCATED).cast("int")).alias("obfuscated")
    )
    known = pages.join(each, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("scripts", "decoded", "obfuscated")})
    return evaluate(known, html, url, "__js").drop("__js")
