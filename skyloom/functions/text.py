"""Text comparison and script measures: simhash, similarity, structural divergence, obfuscation score, packed scripts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM, BITS, SEQUENCE_CHARS = 4, 64, 5000
#: Above this score a script raises its page's score (fixed value).
OBFUSCATED = 0.6
WORD = "[a-zA-Z_$][a-zA-Z0-9_$]*"


_SLICE = 1 << 20


def _bits_of(grams: list[str]) -> np.ndarray:
    """The last 64 bits of each gram's MD5, the lowest first."""
    raw = b"".join(hashlib.md5(g.encode(), usedforsecurity=False).digest()[15:7:-1] for g in grams)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _simhashes(texts: list[str]) -> list[int]:
    """The 64 bits that most of each text's character 4-grams set; each different gram of all texts is hashed once."""
    n = np.array([len(t) for t in texts], np.int64)
    letters, place = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    width = np.int64(max(len(letters), 1))
    if width**GRAM > 2**62:  # more kinds of characters than a packed gram can hold: halves of the texts, or all grams of one
        if len(texts) > 1:
            return _simhashes(texts[: len(texts) // 2]) + _simhashes(texts[len(texts) // 2 :])
        grams, inverse = np.unique([texts[0][i : i + GRAM] for i in range(len(texts[0]) - GRAM + 1)], return_inverse=True)
        bits = _bits_of(grams.tolist())
    else:
        packed = np.zeros(max(len(place) - GRAM + 1, 0), np.int64)
        for i in range(GRAM):
            packed = packed * width + place[i : len(packed) + i]
        codes, inverse = np.unique(packed, return_inverse=True)  # grams across two texts are hashed, and not counted
        shown = [chr(c) for c in letters.tolist()]
        digits = [codes // width**i % width for i in range(GRAM - 1, -1, -1)]
        bits = _bits_of(["".join(map(shown.__getitem__, g)) for g in zip(*(d.tolist() for d in digits), strict=True)])
    out = []
    for start, size in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
        k = max(size - GRAM + 1, 0)
        most = 2 * bits[inverse[start : start + k]].sum(0, dtype=np.int64) > k
        out.append(int.from_bytes(np.packbits(most, bitorder="little").tobytes(), "little"))
    return out


@F.arrow_udf(T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())]))
def simhash_bits(text: pa.Array) -> pa.Array:
    """A text's simhash as two numbers of 32 bits, without a shuffle; texts of fewer than four characters have no bits."""
    texts, out, held, room = [t or "" for t in text.to_pylist()], [], [], 0
    for t in texts:
        if held and room + len(t) > _SLICE:
            out += _simhashes(held)
            held, room = [], 0
        held.append(t)
        room += len(t)
    out += _simhashes(held) if held else []
    return pa.StructArray.from_arrays([pa.array([x >> 32 for x in out], pa.int64()), pa.array([x & 0xFFFFFFFF for x in out], pa.int64())], ["hi", "lo"])


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hi, lo) of each row: the 64 bits that most of its text's character 4-grams set, by MD5."""
    return df.select(key, simhash_bits(F.col(text)).alias("s")).select(key, "s.hi", "s.lo")


def simhash_similarity(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return 1 - (F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))) / F.lit(float(BITS))


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks that ``difflib.SequenceMatcher(None, a, b)`` finds.

    Its rules, with less to walk through: where ``b`` has 200 characters or more, those that make up over a hundredth of it start no
    block, so only places of ``a`` with another character of ``b`` are visited, and of that character only the places inside the window.
    """
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    if len(b) >= 200:
        most = len(b) // 100 + 1
        places = {c: at for c, at in places.items() if len(at) <= most}
    starts = [(i, places[c]) for i, c in enumerate(a) if c in places]
    index = [i for i, _ in starts]
    total, windows = 0, [(0, len(a), 0, len(b))]
    while windows:
        alo, ahi, blo, bhi = windows.pop()
        x, y, size, before, last = alo, blo, 0, {}, -2
        for i, at in starts[bisect_left(index, alo) : bisect_left(index, ahi)]:
            here: dict[int, int] = {}
            if i != last + 1:
                before = here
            for j in at if blo <= at[0] and at[-1] < bhi else at[bisect_left(at, blo) : bisect_left(at, bhi)]:
                k = here[j] = before.get(j - 1, 0) + 1 if before is not here else 1
                if k > size:
                    x, y, size = i - k + 1, j - k + 1, k
            before, last = here, i
        while x > alo and y > blo and a[x - 1] == b[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size < ahi and y + size < bhi and a[x + size] == b[y + size]:
            size += 1
        if size:
            total += size
            if alo < x and blo < y:
                windows.append((alo, x, blo, y))
            if x + size < ahi and y + size < bhi:
                windows.append((x + size, ahi, y + size, bhi))
    return total


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of characters in common matching blocks of the first 5,000 of both texts; Spark has no such function."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = ((t.as_py() or "")[:SEQUENCE_CHARS] for t in (x, y))
        out.append(2.0 * matched(x, y) / (len(x) + len(y)) if x or y else 1.0)
    return pa.array(out, pa.float64())


def similarity(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Adds ``similarity``: 0.6 of the simhash's and 0.4 of the sequence's; 1 for two empty texts, 0 for one."""
    both = pairs.withColumns({"__a": simhash_bits(F.col(a)), "__b": simhash_bits(F.col(b))})
    empty_a, empty_b = F.coalesce(F.col(a), F.lit("")) == "", F.coalesce(F.col(b), F.lit("")) == ""
    mixed = simhash_similarity(F.col("__a.hi"), F.col("__a.lo"), F.col("__b.hi"), F.col("__b.lo")) * 0.6 + sequence_ratio(a, b) * 0.4
    return both.withColumn("similarity", F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(mixed)).drop("__a", "__b")


def structural_divergence(forms_a: Column, forms_b: Column, scripts_a: Column, scripts_b: Column) -> Column:
    """Why two pages cannot be called the same one: where forms go, whether there are any, where scripts come from."""
    jaccard = F.size(F.array_intersect(scripts_a, scripts_b)) / F.size(F.array_union(scripts_a, scripts_b))
    return F.array_compact(F.array(
        F.when((F.size(forms_a) > 0) & (F.size(forms_b) > 0) & ~F.arrays_overlap(forms_a, forms_b), F.concat(F.lit("form_action_hosts_disjoint:"), F.array_join(forms_a, ","), F.lit("|"), F.array_join(forms_b, ","))),
        F.when((F.size(forms_a) > 0) != (F.size(forms_b) > 0), F.lit("form_presence_differs")),
        F.when((F.size(scripts_a) > 0) & (F.size(scripts_b) > 0) & (jaccard < 0.34), F.concat(F.lit("script_hosts_jaccard="), F.format_string("%.2f", jaccard))),
    ))


def _bare(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code, F.lit("")), r"\s", "")


def packed_share(code: Column) -> Column:
    """Share of ``[]!+()`` among the characters that are not white space; 0 for none."""
    bare = _bare(code)
    return F.coalesce(F.length(F.regexp_replace(bare, r"[^\[\]!+()]", "")) / F.nullif(F.length(bare), F.lit(0)), F.lit(0.0))


def is_symbol_encoded(code: Column) -> Column:
    """Scripts written in signs only, by their share of signs or by how they begin."""
    bare = _bare(code)
    return (packed_share(code) > 0.85) | bare.startswith("$=~[]") | bare.startswith("$$$=~[]")


def obfuscation_score(code: Column) -> Column:
    """0 to 1 from short names, generated names, hex escapes, mean name length and signs; 0 without a name."""
    words = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(f"({WORD})"), 1)
    n = F.nullif(F.size(words).cast("double"), F.lit(0.0))
    short, generated = F.size(F.filter(words, lambda w: F.length(w) <= 2)) / n, F.size(F.filter(words, lambda w: w.startswith("_0x"))) / n
    mean = F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.length(w)) / n
    escapes = F.regexp_count(code, F.lit(r"\\x[0-9a-fA-F]{2}")) / F.length(code)
    score = short * 0.25 + generated * 0.35 + escapes * 100 * 0.15 + F.greatest(F.lit(0.0), 4 - mean) / 4 * 0.15 + packed_share(code) * 0.10
    return F.coalesce(F.least(F.lit(1.0), score), F.lit(0.0))


def heavily_obfuscated(scripts: Column) -> Column:
    """How many scripts of an array score above ``OBFUSCATED``."""
    return F.size(F.filter(scripts, lambda s: obfuscation_score(s) > OBFUSCATED))
