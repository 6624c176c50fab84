"""Embedding whitening from an exact scatter matrix in residue numbers.

Vectors become integers x; the fit list holds each distinct one once. A first pass gives its number n, the sums S and the largest
entries, exactly. A second pass centres in residues: for each of several primes, a partition reduces y = n * x - S modulo the
prime, multiplies blocks of it with themselves in float64 (a block's sums stay below 2^53, so the products are exact) and
keeps one d x d matrix. Partitions' matrices are summed by entry, each entry's residues are put together by the Chinese
remainder theorem into the exact sum of y_i * y_j, and V = that / n^3 is rounded once. As many primes are used as the
largest possible sum needs. Only the d x d doubles of V reach the driver, for ``eigh``; a last pass projects every row.

Defined cases: vectors that are null, empty or hold null or non-finite entries (or ones whose x is no long) are dropped; so are vectors
of any other length than the most frequent one (of equally frequent ones the longest); rows that repeat ids or vectors stay,
vectors count once in the fit; null ids stay; a component without variance (eigenvalue at most d * 2^-52 of the largest) has null
``whitened``; ``explained`` is null if nothing varies; ``identity_error`` covers components with variance (0.0 if there is none);
``deviation`` is null where it does not fit a long; tied eigenvalues give any orthonormal basis, one for all rows; other columns are
dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, quoted

SCALE, COMPONENTS, BLOCK = 256, 4, 2048
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def primes(bound: int) -> list[int]:
    """The largest primes below 2^22 whose product exceeds 2 * bound, so that -bound ... bound are told apart.

    A centred residue is below 2^21, so 2048 products sum to less than 2^53.
    """
    out, product, p = [], 1, 1 << 22
    while product <= 2 * bound:
        p -= 1
        if all(p % q for q in range(2, 2048)):
            out.append(p)
            product *= p
    return out or [4194301]


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The number of least absolute value with these residues."""
    x, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return x if 2 * x < product else x - product


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _moments(d: int):
    """Per partition and dimension: rows, sums of high and low halves, smallest and largest entry."""

    def moments(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        least, most = np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, d)
                n += len(x)
                high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *(pa.array(v) for v in (np.full(d, n), high, low, least, most))], names=["i", "n", "high", "low", "least", "most"])

    return moments


def _scatter(n: int, sums: list[int], moduli: list[int]):
    """Per partition and prime: the upper triangle of the sum of y_i * y_j, modulo the prime."""
    d = len(sums)
    i, j = np.triu_indices(d)

    def scatter(batches):
        total = np.zeros((len(moduli), d, d), np.int64)
        for batch in batches:
            x = _matrix(batch, d)
            for m, p in enumerate(moduli):
                centre = np.array([s % p for s in sums], np.int64)
                for at in range(0, len(x), BLOCK):
                    y = ((n % p) * (x[at : at + BLOCK] % p) - centre) % p
                    y = np.where(2 * y > p, y - p, y).astype(np.float64)
                    total[m] = (total[m] + (y.T @ y).astype(np.int64)) % p
        for m in range(len(moduli)):
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), m, np.int32)), pa.array(total[m][i, j])], names=["i", "j", "m", "r"])

    return scatter


def _entries(n: int, moduli: list[int]):
    """Exact sums from their residues, over n^3, rounded once."""

    def entries(batches):
        for batch in batches:
            v = []
            for parts in batch.column("parts").to_pylist():
                r = {x["m"]: x["r"] for x in parts}
                v.append(remaindered([r[m] % p for m, p in enumerate(moduli)], moduli) / n**3)
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(v, pa.float64())], names=["i", "j", "v"])

    return entries


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * component) of every vector whose components are all finite."""
    v = F.transform(F.col(quoted(vector_col)), lambda c: c.cast("double") * F.lit(float(scale)))
    fits = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(2**63))))
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("id"), v.alias("v")).filter(F.coalesce(fits, F.lit(False)))
    return rows.select("id", F.transform("v", lambda c: F.floor(c)).alias("x"))


class Fit:
    """Count, sums, covariance and components of a fit list, all of them of the size of d x d at most."""

    def __init__(self, fit: DataFrame, d: int):
        kind = "i int, n long, high long, low long, least long, most long"
        wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
        rows = sorted(fit.mapInArrow(_moments(d), kind).groupBy("i").agg(*wide, F.min("least").alias("least"), F.max("most").alias("most")).collect())
        self.d, self.n = d, int(rows[0]["n"])
        self.sums = [(int(r["high"]) << 32) + int(r["low"]) for r in rows]
        self.reach = max(self.n * max(abs(r["least"]), abs(r["most"])) + abs(s) for r, s in zip(rows, self.sums, strict=True))
        self.primes = primes(self.n * self.reach**2)
        residues = fit.mapInArrow(_scatter(self.n, self.sums, self.primes), "i int, j int, m int, r long")
        residues = residues.groupBy("i", "j", "m").agg(F.sum("r").alias("r"))
        whole = residues.groupBy("i", "j").agg(F.collect_list(F.struct("m", "r")).alias("parts"))  # a list of one entry per prime
        v = whole.mapInArrow(_entries(self.n, self.primes), "i int, j int, v double").toPandas()
        self.covariance = np.zeros((d, d))
        self.covariance[v["i"], v["j"]] = v["v"]
        self.covariance[v["j"], v["i"]] = v["v"]
        e, vectors = np.linalg.eigh(self.covariance)
        self.values, self.vectors = e[::-1], vectors[:, ::-1]

    def usable(self, k: int) -> int:
        """How many of the first k components vary."""
        return int((self.values[:k] > max(self.values[0], 0.0) * self.d * 2.0**-52).sum())

    def projector(self, k: int):
        """A function from a matrix of x to its exact deviations and whitened components."""
        n, sums, k = self.n, self.sums, self.usable(k)
        turn = self.vectors[:, :k] / np.sqrt(self.values[:k])
        small = self.reach < 2**62
        centre = np.array(sums, np.int64 if small else object)

        def project(x: np.ndarray) -> tuple[list, np.ndarray]:
            y = (x if small else x.astype(object)) * n - centre
            rough = np.square(y.astype(np.float64)).sum(1)
            if small and rough.max(initial=0.0) < 2.0**62:
                deviation = np.square(y).sum(1).tolist()
            else:
                deviation = [t if t < 2**63 else None for t in (sum(int(c) ** 2 for c in row) for row in y)]
            return deviation, (y / n).astype(np.float64) @ turn

        return project


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``df`` and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark, made = df.sparkSession, []
    rows = durable(integer_vectors(df, id_col, vector_col, scale).withColumn("d", F.size("x")))
    usual = rows.groupBy("d").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], _OUT).withColumnRenamed("vec_id", id_col)
    d = usual["d"]
    rows = rows.filter(F.col("d") == d).select("id", "x")
    distinct = durable(rows.select("x").distinct(), made)
    fit = Fit(distinct, d)
    k, project = fit.usable(components), fit.projector(components)
    error = 0.0
    if k:
        names = [f"z{c}" for c in range(k)]

        def fitted(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in project(_matrix(batch, d))[1].T], names=names)

        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        found = distinct.mapInArrow(fitted, ", ".join(f"{c} double" for c in names)).agg(*[F.covar_pop(names[a], names[b]) for a, b in pairs]).first()
        error = max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs, strict=True))
    forget(spark, made)
    count, trace, values, all_k = fit.n, float(np.trace(fit.covariance)), fit.values, min(components, d)
    share = [float(e) / trace if trace > 0 else None for e in values[:all_k]]

    def apply(batches):
        for batch in batches:
            m = batch.num_rows
            if m:
                deviation, z = project(_matrix(batch, d))
                z = np.concatenate([z, np.full((m, all_k - k), np.nan)], axis=1)
                at = pa.array(np.repeat(np.arange(m), all_k))
                arrays = [batch.column("id").take(at), pa.array(np.tile(np.arange(1, all_k + 1, dtype=np.int32), m)), pa.array(np.full(m * all_k, count)), pa.array(deviation, pa.int64()).take(at)]
                arrays += [pa.array(z.reshape(-1), pa.float64(), mask=np.isnan(z.reshape(-1))), pa.array(share * m, pa.float64()), pa.array(np.full(m * all_k, error))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _OUT.split(", ")])

    return rows.mapInArrow(apply, _OUT).withColumnRenamed("vec_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
