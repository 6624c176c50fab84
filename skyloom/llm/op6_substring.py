"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every 9 consecutive 5-word hashes (one 13-word window) the smallest is an anchor, so two
equal windows always share their anchor. Documents are dealt by hash into groups of about ``group_bytes`` of text. Each
group asks, in blocks of sorted keys, which of its anchors occur elsewhere; only windows around recurring anchors are
then looked up, with the smallest document of the group that holds them, and runs of windows that start in a smaller
document extend each seed both ways to its maximal repeat. A group's blocks hold each key once however often it occurs,
so a passage shared by a third of all documents is combined before it is shuffled, and every answer is a key, never a
pair of documents; repeats within a group are found where it removes words. The three visits of the texts read one and the same
shuffle (Spark reuses equal exchanges). Anchors, which only choose candidates, are 64-bit hashes; windows are decided on
128 bits.

Defined cases: null text has no words; a window is judged against the input, not what is left; rows with the same
doc_id do not remove each other's words; rows with a null doc_id are kept whole and take part in no comparison; texts
without removals are returned unchanged in ``kept_text``; a group holds one text at least, however long; extra columns
stay, whatever their names, and columns named like the results, in any case, are replaced; an empty table gives no rows;
repeated rows with one id keep equal texts equal; a very long text is one group of its own size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, aside, hash_spans, quoted, runs, text_bytes, without, words

WINDOW, SEED, GROUP, PART = 13, 5, 4 << 20, 64 << 20
_KEY, _OWNED = np.dtype([("a", U64), ("b", U64)]), np.dtype([("a", U64), ("b", U64), ("least", np.int64)])


def _windows(table: pa.Table, id_col: str, text_col: str, window: int = WINDOW) -> dict:
    """Words, each window's row, first word, owner and 128-bit key of one group of documents."""
    data, at = text_bytes(table.column(text_col))
    starts, ends, first = words(data, at)
    h = hash_spans(data, starts, ends)
    n = np.maximum(np.diff(first) - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    word = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    ids = table.column(id_col).to_pandas()
    known = ids.notna().to_numpy()
    keys = np.zeros(len(row), _KEY)
    if len(row):
        keys["a"], keys["b"] = runs(h, window)[word], runs(h, window, factor=0xD1342543DE82EF95)[word]
    owner = ids.fillna(0).astype("int64").to_numpy()
    return {"data": data, "at": at, "starts": starts, "ends": ends, "first": first, "row": row, "word": word, "hash": h, "id": owner[row], "known": known[row], "keys": keys}


def _anchors(w: dict, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """The smallest seed hash within each window."""
    s, span = runs(w["hash"], seed, salt=1), window - seed + 1
    if not len(w["row"]):
        return np.zeros(0, U64)
    low, done = s, 1
    while done < span:  # minima of doubling spans
        step = min(done, span - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low[w["word"]]


def _ask(group: int, items: np.ndarray, keys: np.ndarray, parts: int) -> pa.Table:
    """Items in the order of their ascending 64-bit keys, dealt into rows by the keys' top bits; only parts that get any have one."""
    part = ((keys >> U64(32)) * U64(parts)) >> U64(32)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))[: len(part)])
    cut, size = np.append(at, len(keys)).astype(np.int64) * items.dtype.itemsize, len(at)
    lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(items))]).cast(pa.binary())
    return pa.table({"part": pa.array(part[at].astype(np.int32)), "grp": pa.array(np.full(size, group, np.int32)), "keys": lists})


def _reply(who: np.ndarray, items: np.ndarray) -> pa.Table:
    """One row for each group that is told something."""
    order = np.argsort(who, kind="stable")
    who, items = who[order], items[order]
    use, cut = np.unique(who, return_index=True)
    cut = [*cut, len(who)]
    return pa.table({"grp": pa.array(use, pa.int32()), "keys": pa.array([items[cut[i] : cut[i + 1]].tobytes() for i in range(len(use))], pa.binary())})


def _gather(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    groups, lists = table.column("grp").to_numpy(), [np.frombuffer(x.as_py(), kind) for x in table.column("keys")]
    return np.repeat(groups, [len(x) for x in lists]), np.concatenate([np.zeros(0, kind), *lists])


def _recurring(table: pa.Table) -> pa.Table:
    """Anchors that at least two groups hold."""
    who, keys = _gather(table, U64)
    order = np.argsort(keys, kind="stable")
    who, keys = who[order], keys[order]
    same = np.concatenate(([False], keys[1:] == keys[:-1]))
    hit = same | np.concatenate((same[1:], [False]))
    return _reply(who[hit], keys[hit])


def _elsewhere(table: pa.Table) -> pa.Table:
    """Window keys of a group whose smallest document is smaller in another group."""
    who, items = _gather(table, _OWNED)
    order = np.lexsort((items["least"], items["b"], items["a"]))
    who, items = who[order], items[order]
    new = np.concatenate(([True], (items["a"][1:] != items["a"][:-1]) | (items["b"][1:] != items["b"][:-1])))[: len(items)]
    least = items["least"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(items) else items["least"]
    hit = least < items["least"]
    told = np.zeros(int(hit.sum()), _KEY)
    told["a"], told["b"] = items["a"][hit], items["b"][hit]
    return _reply(who[hit], told)


def _within(values: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which values are among those told (64-bit numbers or 128-bit keys)."""
    if not len(told):
        return np.zeros(len(values), bool)
    if told.dtype == U64:
        told = np.sort(told)
        return told[np.minimum(np.searchsorted(told, values), len(told) - 1)] == values
    order = np.lexsort((told["b"], told["a"]))
    a, b = told["a"][order], told["b"][order]
    lo, hi = np.searchsorted(a, values["a"], "left"), np.searchsorted(a, values["a"], "right")
    out = np.zeros(len(values), bool)
    for step in range(int((hi - lo).max(initial=0))):  # one step, but for keys that agree in their first half
        at = np.minimum(lo + step, len(a) - 1)
        out |= (lo + step < hi) & (b[at] == values["b"])
    return out


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, group_bytes: int = GROUP, with_text: bool = True) -> DataFrame:
    """Remove words covered by a ``window``-word run that also starts in a document with a smaller id.

    Adds n_words, n_removed, kept_sha256 and, if asked for, kept_text: the text without the removed words and what
    separates them from the next kept one.
    """
    if not 0 < seed <= window:
        raise ValueError("the seed must not be longer than the window")
    new = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    df = without(df, [*new, "__grp"])
    shown = df.columns
    # grouping resolves names as they stand, so columns have plain ones until the end
    id_col, text_col = (f"__c{shown.index(c)}" for c in (id_col, text_col))
    df = df.toDF(*[f"__c{i}" for i in range(len(shown))])
    df = df.withColumn(id_col, F.col(id_col).cast("long"))
    total = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n = max(1, -(-total // group_bytes))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    dealt = df.withColumn("__grp", F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int"))
    names = df.columns
    keys_type, ask_type = "grp int, keys binary", "part int, grp int, keys binary"

    def seeds(table: pa.Table) -> pa.Table:
        w = _windows(table, id_col, text_col, window)
        keys = np.unique(_anchors(w, window, seed)[w["known"]])  # repeats within the group are found where it is read last
        return _ask(table.column("__grp")[0].as_py(), keys, keys, parts)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ask(0, np.zeros(0, _OWNED), np.zeros(0, U64), parts)
        w = _windows(left, id_col, text_col, window)
        use = np.flatnonzero(_within(_anchors(w, window, seed), _gather(right, U64)[1]) & w["known"])
        keys, ids = w["keys"][use], w["id"][use]
        order = np.lexsort((ids, keys["b"], keys["a"]))
        keys, ids = keys[order], ids[order]
        new = np.concatenate(([True], (keys["a"][1:] != keys["a"][:-1]) | (keys["b"][1:] != keys["b"][:-1])))[: len(keys)]
        items = np.zeros(int(new.sum()), _OWNED)
        items["a"], items["b"], items["least"] = keys["a"][new], keys["b"][new], ids[new]
        return _ask(left.column("__grp")[0].as_py(), items, items["a"], parts)

    out_schema = T.StructType([*df.schema.fields])
    for name, kind in zip(new if with_text else new[:3], ("long", "long", "string", "string"), strict=False):
        out_schema.add(name, kind)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        w = _windows(left, id_col, text_col, window)
        keys, ids, known = w["keys"], w["id"], w["known"]
        dup = _within(keys, _gather(right, _KEY)[1]) & known
        own = np.flatnonzero(known)
        order = own[np.lexsort((ids[own], keys["b"][own], keys["a"][own]))]
        k, i = keys[order], ids[order]
        start = np.concatenate(([True], (k["a"][1:] != k["a"][:-1]) | (k["b"][1:] != k["b"][:-1])))[: len(k)]
        least = i[np.flatnonzero(start)][np.cumsum(start) - 1] if len(k) else i
        dup[order] |= least < i
        cover = np.zeros(len(w["starts"]) + 1, np.int64)
        np.add.at(cover, w["word"][dup], 1)
        np.add.at(cover, w["word"][dup] + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        raw, at, first, s, e = w["data"].tobytes(), w["at"], w["first"], w["starts"], w["ends"]
        n_words, n_removed, digests, texts = np.diff(first), [], [], []
        originals = left.column(text_col)
        for d in range(left.num_rows):
            a, b = first[d], first[d + 1]
            out = gone[a:b]
            n_removed.append(int(out.sum()))
            if n_removed[-1]:
                stay = np.flatnonzero(~out) + a
                kept = b" ".join(raw[s[x] : e[x]] for x in stay)
                if with_text:  # a kept run goes up to the next word, so the white space between kept words stays
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~out, [False])).astype(np.int8)))
                    runs_ = [raw[(at[d] if lo == 0 else s[a + lo]) : (at[d + 1] if a + hi == b else s[a + hi])] for lo, hi in edge.reshape(-1, 2)]
                    texts.append(b"".join(runs_).decode())
            else:
                kept = b" ".join(raw[at[d] : at[d + 1]].split())
                if with_text:
                    texts.append(originals[d].as_py())
            digests.append(hashlib.sha256(kept).hexdigest())
        cols = {c: left.column(c) for c in names} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    by_group = dealt.groupBy("__grp")
    anchors = by_group.applyInArrow(seeds, ask_type).groupBy("part").applyInArrow(_recurring, keys_type)
    spans = by_group.cogroup(anchors.groupBy("grp")).applyInArrow(extend, ask_type).groupBy("part").applyInArrow(_elsewhere, keys_type)
    out = by_group.cogroup(spans.groupBy("grp")).applyInArrow(remove, out_schema)
    return out.toDF(*shown, *out.columns[len(names) :])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **how) -> DataFrame:
    """All rows and columns of ``df``; texts lose their repeated words, and ``length_col``, if there, follows."""
    names = df.columns
    df, back = aside(df, ["n_words", "n_removed", "kept_sha256", "kept_text", "__grp"])
    out = substring_dedup(df, id_col, text_col, **how)
    out = out.withColumn(text_col, F.col("kept_text"))
    if length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.col("n_removed") > 0, F.length(text_col)).otherwise(F.col(length_col)).cast(df.schema[length_col].dataType))
    return out.select(*map(quoted, df.columns)).withColumnsRenamed(back).select(*map(quoted, names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k
        FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM t WHERE len(w) >= 13)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, p FROM (SELECT win.r, unnest(generate_series(i, i + 12)) AS p FROM win JOIN low ON win.k = low.k AND low.m < win.doc_id)),
word AS (SELECT r, doc_id, p, w[p] AS x FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w))) AS p FROM t WHERE len(w) > 0)),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.p) AS s FROM word LEFT JOIN gone ON gone.r = word.r AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.r)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.r = t.r LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) g ON g.r = t.r
"""
