"""MinHash near-dedup by a chosen-path set similarity join.

Each distinct shingle set gets 64 minwise tokens. Independent trees send a set down a path of tokens. First every node's
sets are compared with its smallest member, which joins most copies of a text at once; nodes of a single component are
then done. In the others, a node with few sets compares those of different components exhaustively, and a larger node
compares its smallest member with the rest and branches by the tree's next token. Only pairs whose tokens agree often enough are confirmed, on the full shingle sets of both texts.
Leaves that stay large and mixed at the last level finish exactly, by a prefix join on their rarest shingles, so nothing
is capped. Equal sets are collapsed first (partial
aggregation), hence thousands of copies are one member. Components come from alternating large-star and small-star
rounds, which keep at most as many rows as there are links. A tree misses a pair of similarity 0.85 with a probability of
at most 1 - 0.85^3, so 14 trees miss it with one of about 2e-6 even where nodes are dense, and of 3e-12 elsewhere.

A class of equal sets has a key of its own, whatever its ids, and its text is that of its first row, found by row number.

Defined cases: A-Z are lower-cased; fewer than ``k`` words are one shingle; texts without words (or null) have no
shingles and no links and are kept; rows that repeat an id count by their own texts, so an id can be in two components;
a component's id is its smallest one, null only if all its ids are; of rows with null ids one is kept where a component
has no other; very long texts are read one at a time when pairs are confirmed; ties of the smallest id go to the first row in file
order; an empty table gives no rows; ``near_duplicates`` drops other columns and ``keep_first`` keeps them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, aside, durable, forget, hash_spans, lower, mix, numbered, pieces, quoted, runs, text_bytes, words

TOKENS, TREES, LEVELS, NODE = 64, 14, 3, 16
_MULTIPLIERS = np.random.default_rng(90210).integers(1, 2**63, TOKENS).astype(U64) | U64(1)


def shingle_sets(column, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, at = text_bytes(column)
    data = lower(data)
    starts, ends, first = words(data, at)
    h = hash_spans(data, starts, ends)
    s, out = runs(h, k), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        else:
            out.append(runs(h[a:b], int(b - a), salt=2) if b > a else np.zeros(0, U64))
    return out


def _sketch(k: int):
    """Per row: its number, id, set size, two hashes of the set and its minwise tokens."""

    def sketch(batches):
        for part in (x for batch in batches for x in pieces(batch, "text")):
            sets = shingle_sets(part.column("text"), k)
            n = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(n)
            tokens = np.zeros((len(n), TOKENS), np.uint32)
            f1, f2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
            if len(full):
                all_, cut = np.concatenate([sets[i] for i in full]), np.concatenate(([0], np.cumsum(n[full])[:-1]))
                for t in range(TOKENS):
                    tokens[full, t] = np.minimum.reduceat(all_ * _MULTIPLIERS[t] ^ (all_ >> U64(29)), cut) >> U64(32)
                f1[full], f2[full] = np.add.reduceat(mix(all_ + U64(11)), cut), np.add.reduceat(mix(all_ + U64(23)), cut)
            flat = pa.array(tokens.view(np.int32).reshape(-1), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TOKENS), flat)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("__f", "__r", "id")), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], names=["__f", "__r", "id", "n", "f1", "f2", "tokens"])

    return sketch


class _Search:
    """One near-duplicate search: its classes of equal sets, where their texts lie, its threshold and its tables."""

    def __init__(self, texts: DataFrame, k: int, num: int, den: int):
        self.k, self.num, self.den, self.made, self.texts = k, num, den, [], texts.select("__f", "__r", "text")
        self.spark = texts.sparkSession
        self.sets = durable(texts.mapInArrow(_sketch(k), "__f long, __r long, id long, n long, f1 long, f2 long, tokens array<int>"))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__f", "__r")).alias("first")
        # the tokens of equal sets are equal, so a row for each class needs any of them
        classes = self.sets.filter("n > 0").groupBy("f1", "f2", "n").agg(first, F.any_value("tokens").alias("tokens"))
        # keys ascend with the classes' smallest ids, so a node's smallest member is the same document in all trees
        self.classes = self.keep(classes.repartitionByRange("first").sortWithinPartitions("first").withColumn("key", F.monotonically_increasing_id()))
        self.sides = self.classes.select("key", "n", "tokens", F.col("first.__f").alias("f"), F.col("first.__r").alias("r"))

    def keep(self, df: DataFrame) -> DataFrame:
        return durable(df, self.made)

    def members(self, at: DataFrame) -> DataFrame:
        """Rows of nodes that hold more than one class, with the node's size and smallest member."""
        size = at.groupBy("node").agg(F.count("*").alias("size"), F.min("key").alias("pivot")).filter("size > 1")
        return self.keep(at.join(size, "node"))

    def roots(self) -> DataFrame:
        """Each class in the first node of each tree, with its path there."""
        paths = F.array(*[F.slice("tokens", 1 + t * LEVELS, LEVELS) for t in range(TREES)])
        at = self.sides.select("key", F.posexplode(paths).alias("tree", "path"))
        return self.members(at.select(F.xxhash64("tree", F.element_at("path", 1)).alias("node"), "key", "path"))

    def branches(self, members: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Candidate pairs (a < b) of different components in all nodes, and the leaves that are large at the last level.

        A node whose classes are all of one component already is dropped with all its branches.
        """
        found = []
        for level in range(1, LEVELS + 1):
            named = members.join(comp, "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
            mixed = named.groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by("c", "key").alias("pc")).filter("lo < hi").drop("lo", "hi")
            rows = self.keep(named.join(mixed, "node"))
            small = rows.filter(F.col("size") <= NODE).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "c"))).alias("all"))
            both = "flatten(transform(all, (x, i) -> transform(filter(slice(all, i + 2, size(all)), y -> y.c != x.c), y -> struct(x.key as a, y.key as b))))"
            found.append(small.select(F.explode(F.expr(both)).alias("p")).select("p.a", "p.b"))
            large = rows.filter(F.col("size") > NODE)
            found.append(large.filter("c != pc").select(F.col("pivot").alias("a"), F.col("key").alias("b")))
            if large.isEmpty():
                large = None
                break
            if level < LEVELS:
                members = self.members(large.select(F.xxhash64("node", F.element_at("path", level + 1)).alias("node"), "key", "path"))
        pairs = found[0]
        for x in found[1:]:
            pairs = pairs.unionByName(x)
        return pairs.filter("a < b").distinct(), None if large is None else large.select("node", "key")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Pairs with den * |x and y| >= num * |x or y|, counted on the full sets; a cheap exact size bound and a token count that such pairs miss with odds of about 1e-6 come first."""
        k, num, den = self.k, self.num, self.den
        need = int(TOKENS * num / den - 5 * (TOKENS * num / den * (1 - num / den)) ** 0.5)
        q = pairs.join(self.sides.toDF("a", "na", "ta", "fa", "ra"), "a").join(self.sides.toDF("b", "nb", "tb", "fb", "rb"), "b")
        alike = F.expr("aggregate(zip_with(ta, tb, (x, y) -> int(x = y)), 0, (s, x) -> s + x)") >= need
        q = self.keep(q.filter((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & alike).select("a", "b", "fa", "ra", "fb", "rb"))
        if q.isEmpty():
            return q.select("a", "b")
        both = q.join(self.texts.toDF("fa", "ra", "text_a"), ["fa", "ra"]).join(self.texts.toDF("fb", "rb", "text_b"), ["fb", "rb"])

        def check(batches):
            for batch in batches:
                a_col, b_col = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                good, last, x = [], None, None
                for i in range(batch.num_rows):  # two texts at a time, however long the batch
                    if a_col[i] != last:
                        last, x = a_col[i], shingle_sets(batch.column("text_a").slice(i, 1), k)[0]
                    y = shingle_sets(batch.column("text_b").slice(i, 1), k)[0]
                    both_n = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(den * both_n >= num * (len(x) + len(y) - both_n))
                yield pa.RecordBatch.from_arrays([pa.array(a_col[good]), pa.array(b_col[good])], names=["a", "b"])

        return self.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"))

    def rest(self, leaves: DataFrame, comp: DataFrame) -> DataFrame:
        """All pairs of different components that can be similar within leaves that stayed large, by an exact prefix join.

        Two sets of similarity num/den share one of their ``n - ceil(n * num / den) + 1`` rarest shingles, and a shingle that
        makes a leaf large (a passage in many documents) is rare in no set. Shingles of a single component make no pair.
        """
        k, num, den = self.k, self.num, self.den
        named = leaves.join(comp, "key", "left").select("node", "key", F.coalesce("component", "key").alias("c"))
        mixed = named.groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("node")
        keys = self.keep(named.join(mixed, "node").select("key", "c").distinct().join(self.sides.select("key", "f", "r"), "key"))

        def explode(batches):
            for part in (x for batch in batches for x in pieces(batch, "text")):
                sets = shingle_sets(part.column("text"), k)
                n = np.array([len(x) for x in sets])
                row = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([part.column("key").take(row), part.column("c").take(row), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["key", "c", "n", "s"])

        rows = self.texts.toDF("f", "r", "text").join(keys, ["f", "r"]).select("key", "c", "text").mapInArrow(explode, "key long, c long, n long, s long")
        rows = self.keep(rows)
        spread = rows.groupBy("s").agg(F.count("*").alias("docs"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        own = Window.partitionBy("key").orderBy("docs", "s")
        first = rows.join(spread, "s").withColumn("at", F.row_number().over(own)).filter((F.col("at") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1) & (F.col("lo") < F.col("hi")))
        first = self.keep(first.select("key", "c", "n", "s", "at"))
        pairs = first.toDF("a", "ca", "na", "s", "ia").join(first.toDF("b", "cb", "nb", "s", "ib"), "s").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
        # what can still be common from their first common shingle on
        enough = (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1) * (num + den) >= (F.col("na") + F.col("nb")) * num
        return pairs.filter(enough & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)).select("a", "b").distinct()

    def components(self) -> DataFrame:
        """(key, component) of each linked class."""
        roots = self.roots()
        links = self.confirm(roots.filter("key > pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct())
        comp = components(links, self.made)
        pairs, leaves = self.branches(roots, comp)
        more = self.confirm(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links, self.made)
        if leaves is not None:
            more = self.confirm(self.rest(leaves, comp))
            if not more.isEmpty():
                comp = components(links.unionByName(more), self.made)
        return comp

    def rows(self) -> DataFrame:
        """(__f, __r, id, n, first) of each row; ``first`` is the row of its component with the smallest id, null ids last."""
        named = self.classes.drop("tokens").join(self.components(), "key", "left").withColumn("c", F.coalesce("component", "key"))
        named = named.join(named.groupBy("c").agg(F.min("first").alias("head")), "c")
        named = durable(named.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), "head"))
        forget(self.spark, self.made)
        rows = self.sets.drop("tokens").join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")), "left")
        return rows.select("__f", "__r", "id", "n", F.coalesce("head", F.struct(F.col("id").isNull().alias("none"), "id", "__f", "__r")).alias("first"))


def components(links: DataFrame, made: list[str]) -> DataFrame:
    """(key, component) of each linked key, the component being its smallest key: large-star and small-star rounds."""
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), made)
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(seen) == mark:
            ends = edges.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct()
            return durable(edges.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(ends), made)
        mark = tuple(seen)
        # large star: every larger neighbour of u points at u's smallest neighbour
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = around.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours point at the smallest of them
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        edges = durable(star.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), made)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select("__f", "__r", F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of ``df``: its id, n_shingles, component_id (smallest linked id) and kept. Links have Jaccard similarity of num/den or more."""
    rows = _Search(_rows(numbered(df.select(quoted(id_col), quoted(text_col))), id_col, text_col), k, num, den).rows()
    own = (F.col("__f") == F.col("first.__f")) & (F.col("__r") == F.col("first.__r"))
    kept = F.when(F.col("id").isNull(), own).otherwise(F.col("id") == F.col("first.id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), kept.alias("kept"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of ``df`` that are the first of their component, one for each, with their own columns; all rows without words stay."""
    names = df.columns
    df, back = aside(df, ["__f", "__r"])
    rows = numbered(df)
    ids = {old: new for new, old in back.items()}
    found = _Search(_rows(rows, ids.get(id_col, id_col), ids.get(text_col, text_col)), k, num, den).rows()
    gone = found.filter((F.col("__f") != F.col("first.__f")) | (F.col("__r") != F.col("first.__r"))).select("__f", "__r")
    return rows.join(gone, ["__f", "__r"], "left_anti").drop("__f", "__r").withColumnsRenamed(back).select(*map(quoted, names))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
         JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, t.doc_id = r.c AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = t.doc_id
"""
