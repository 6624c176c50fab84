"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: ranges of lengths, longest first, cut at quantiles of all lengths (``RANGES`` numbers reach
the driver). Every query first visits the longest range. Its k-th score there, with a range's longest vector, says which
other ranges can still hold a better one (length pruning), and it is sent to no others. A range is dealt into blocks by
hash, and a visit of a query block and a candidate block goes through buckets of falling length with each query's k best
so far: a bucket is skipped for a query whose threshold exceeds the product of its length and the bucket's longest;
otherwise the local cosine threshold (k-th score over that product) decides: a high one prunes candidates by their
products over the query's largest coordinates plus a Cauchy-Schwarz bound on the others, a low one only by length. What
remains is verified by integer products. A visit gives at most k rows per query; their top k are the result.

Products are exact: float64 holds all sums while the product of the lengths is below 2^53, above that integer products
are used, and a block whose products may not fit a long fails with ``OverflowError`` (as does a component that does not).

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; only vectors of a query's
own dimension are its candidates; ties go to the smaller id; a query is not its own candidate (nor are other rows of its
id); queries of repeated ids are answered as one; other columns are dropped; empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget

SCALE, BLOCK, QUERIES, BUCKET, RANGES = 64, 32768, 8192, 512, 16


def _matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    return table.column("id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row and their ids, ties by id; only what reaches the k-th score is sorted."""
    n, width = scores.shape
    reach = np.partition(scores, width - k, axis=1)[:, width - k][:, None] if width > k else np.full((n, 1), -np.inf)
    r, c = np.nonzero(scores >= reach)
    s, i = scores[r, c], ids[r, c]
    order = np.lexsort((i, -s, r))
    r, s, i = r[order], s[order], i[order]
    at = np.arange(len(r)) - np.searchsorted(r, r)
    use = at < k
    out_s, out_i = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    out_s[r[use], at[use]], out_i[r[use], at[use]] = s[use], i[use]
    return out_s, out_i


def search_block(q_ids, q, c_ids, c, k: int, floor: np.ndarray | None = None, bucket: int = BUCKET, focus: int = 8):
    """Top k of candidates ``c`` for each query row: (query row, candidate id, score).

    ``floor``: a score that each query is known to reach k times elsewhere; lower scores may be left out.
    """
    exact = c
    q, c = q.astype(np.float64), c.astype(np.float64)
    length, q_length = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
    limit = length.max(initial=0) * q_length.max(initial=0)
    if limit >= 2.0**63:
        raise OverflowError("inner products of these vectors do not fit a long")
    order = np.argsort(-length, kind="stable")
    c_ids, c, length = c_ids[order], c[order], length[order]
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    top = np.argsort(-np.abs(q), axis=1)[:, :focus] if q.shape[1] > focus else None
    for a in range(0, len(c), bucket):
        part, ids, long = c[a : a + bucket], c_ids[a : a + bucket], length[a : a + bucket]
        least = np.maximum(best_s[:, -1], floor)
        bound = q_length * long[0]
        live = np.flatnonzero(~(bound * (1 + 1e-12) < least))  # a tie can still win by id
        if not len(live):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound[live] > 0, least[live] / bound[live], -np.inf)
        scores = np.full((len(live), len(part)), -np.inf)
        sharp = cosine > 0.95
        plain = np.flatnonzero(~sharp)
        if len(plain):  # length pruning: the bucket's prefix that is long enough for some query
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(q_length[live[plain]] > 0, least[live[plain]] / q_length[live[plain]], -np.inf)
            n = int((long * (1 + 1e-12) >= need.min()).sum())
            scores[plain, :n] = q[live[plain]] @ part[:n].T
        for i in np.flatnonzero(sharp):  # coordinate pruning for the few queries with a high threshold
            row = q[live[i]]
            if top is None:
                scores[i] = part @ row
                continue
            f = top[live[i]]
            near = part[:, f] @ row[f]
            rest = np.sqrt(np.maximum(long**2 - (part[:, f] ** 2).sum(1), 0) * max(q_length[live[i]] ** 2 - (row[f] ** 2).sum(), 0))
            keep = np.flatnonzero(near + rest * (1 + 1e-9) + 1e-6 >= least[live[i]])
            scores[i, keep] = part[keep] @ row
        scores[q_ids[live][:, None] == ids[None, :]] = -np.inf
        best_s[live], best_i[live] = _best(np.hstack([best_s[live], scores]), np.hstack([best_i[live], np.broadcast_to(ids, scores.shape)]), k)
    r, j = np.nonzero(np.isfinite(best_s))
    if limit < 2.0**53:
        return r, best_i[r, j], best_s[r, j].astype(np.int64)
    return _long_products(q_ids, q, c_ids, exact[order], k)


def _long_products(q_ids, q, c_ids, c, k: int):
    """The same by 64-bit products, without pruning: for lengths whose products float64 cannot hold."""
    r, i, s = [], [], []
    for row, (own, v) in enumerate(zip(q_ids, q.astype(np.int64), strict=True)):
        scores = c @ v
        order = np.lexsort((c_ids, -scores))
        order = order[c_ids[order] != own][:k]
        r.append(np.full(len(order), row))
        i.append(c_ids[order])
        s.append(scores[order])
    return np.concatenate([np.zeros(0, np.int64), *r]), np.concatenate([np.zeros(0, np.int64), *i]), np.concatenate([np.zeros(0, np.int64), *s])


def _visit(k: int):
    def visit(key, left: pa.Table, right: pa.Table) -> pa.Table:
        r = i = s = qi = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            qi, q = _matrix(left, dim)
            floor = left.column("floor").to_numpy()
            r, i, s = search_block(qi, q, *_matrix(right, dim), k, np.where(np.isnan(floor), -np.inf, floor))
        return pa.table({"query_id": pa.array(qi[r], pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    return visit


def dealt(rows: DataFrame, stats: DataFrame, asked: DataFrame) -> DataFrame:
    """Candidates by range, block and query block, one copy for each query block that asks for the range; no other range is sent.

    ``asked``: (dim, rng, asking), the query blocks by range, at most as many rows as there are ranges.
    """
    wanted = stats.join(asked, ["dim", "rng"]).select("dim", "rng", "blocks", "asking")
    return rows.join(wanted, ["dim", "rng"]).select("dim", "rng", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("b"), F.explode("asking").alias("a"), "id", "v")


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES, ranges: int = RANGES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x) vectors for each query row."""
    spark = df.sparkSession
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    fits = lambda x: F.when(F.abs(x.cast("double")) * scale >= 2.0**62, F.raise_error(F.lit("a component does not fit a long")).cast("long")).otherwise(whole(x))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), fits).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    made: list[str] = []
    rows = durable(rows.withColumns({"dim": F.size("v"), "long": F.sqrt(squares)}), made)
    cuts = rows.agg(F.percentile_approx("long", [i / ranges for i in range(1, ranges)], 10000).alias("c")).first()["c"] or []
    rows = rows.withColumn("rng", F.lit(ranges) - F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>"), lambda c: c <= F.col("long"))))
    # blocks of about ``block`` candidates and 2^21 components at most, smaller where that leaves cores idle
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.lit(1 << 21) / F.col("dim")))
    n = F.greatest(F.ceil(F.count("*") / size), F.least(F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))), F.ceil(F.count("*") / 2048)))
    stats = durable(rows.groupBy("dim", "rng").agg(n.alias("blocks"), F.max("long").alias("most")), made)
    first = stats.groupBy("dim").agg(F.min("rng").alias("rng"))
    h, asking = F.xxhash64("id"), max(1, -(-rows.filter("asks").count() // queries))
    asks = rows.filter("asks").dropDuplicates(["id", "v"]).withColumn("a", F.pmod(h, F.lit(asking)).cast("int")).select("dim", "a", "id", "v", F.col("long").alias("q"))
    keys, out, blocks = ["dim", "rng", "b", "a"], "query_id long, vec_id long, score long", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def search(to: DataFrame) -> DataFrame:
        to = durable(to, made)
        asked = to.groupBy("dim", "rng").agg(F.collect_set("a").alias("asking"))  # numbers of query blocks
        candidates = dealt(rows, stats, asked)
        candidates = candidates.toDF(*candidates.columns)  # columns of its own, though both sides come from one table
        return durable(to.withColumn("b", blocks).select(*keys, "id", "v", "floor").groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_visit(k), out))

    early = search(asks.join(first, "dim").join(stats.select("dim", "rng", "blocks"), ["dim", "rng"]).withColumn("floor", F.lit(None).cast("double")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    told = early.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    others = stats.join(first.withColumnRenamed("rng", "lead"), "dim").filter(F.col("rng") > F.col("lead")).drop("lead")
    need = F.col("floor").isNull() | (F.col("q") * F.col("most") * (1 + 1e-12) >= F.col("floor"))
    late = search(asks.join(told, "id", "left").join(others, "dim").filter(need))
    forget(spark, made)
    found = early.unionByName(late)
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = r"""
WITH e AS (SELECT vec_id, i, CAST(floor(64.0::DOUBLE * x::DOUBLE) AS BIGINT) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.i = c.i WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
