"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned, not listed: whole words and word beginnings of several byte lengths that occur in far more
toxic than clean documents. Features of a text: densities and counts of strong and weak lexicon words, their weights, the
share of them near a second-person word, capitals, punctuation, obfuscation (letters mixed with digits or signs, runs of
one character) and length. Trees are fitted to features of documents that their lexicon has not seen (two halves), and
isotonic regression is fitted to scores of trees that have not seen the document.

Training takes a bounded sample: at most about ``most`` labelled documents of each class, drawn by a hash of the id, no
text over ``longest`` characters. Scoring reads every whole text where it lies, without a shuffle.

Defined cases: null or blank texts have all-zero word features and get a score like any other; null labels are not used,
and a document with labels of both kinds is toxic; without labels
of both classes the score is the share of toxic labels (0 without any); tied scores are one point of the calibration, so neither
it nor the model depends on the order of rows; rows that repeat an id or a text are scored alike; an empty table gives no rows; extra columns stay, and columns named like the
results, in any case, are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, give_back, hash_spans, lower, mix, pieces, quoted, stripped, text_bytes, without, words

MOST, LONGEST = 2500, 20_000
LENGTHS = (3, 4, 5, 6, 8, 10**9)
#: Second-person words of four languages (fixed values).
SECOND = ("you", "your", "yours", "yourself", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros", "os")
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 capital, 4 digit, 8 other ASCII sign
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 4
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 8
_KIND[128:] = 1


def _terms(data, starts, ends):
    """Hashes of each word's beginnings, one array for each length; words too short for a length have 0."""
    for j, n in enumerate(LENGTHS):
        cut = np.minimum(starts + n, ends)
        h = mix(hash_spans(data, starts, cut) + U64(j + 1))
        if n < 10**9:
            h[ends - starts < n] = 0
        yield h


def _word_spans(data, at):
    starts, ends, first = words(data, at)
    kind = _KIND[data]
    starts, ends = stripped(data, starts, ends, _KIND == 8)
    return starts, ends, first, kind


def learn_lexicon(column: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted term hashes and their weights (log ratio of document frequencies)."""
    data, at = text_bytes(column)
    starts, ends, first, _ = _word_spans(data, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    p, n = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    keys, weights = [], []
    for h in _terms(lower(data), starts, ends):
        order = np.lexsort((doc, h))
        hh, dd = h[order], doc[order]
        new = np.concatenate(([True], (hh[1:] != hh[:-1]) | (dd[1:] != dd[:-1]))) if len(hh) else np.zeros(0, bool)
        hh, dd = hh[new], dd[new]
        u, inverse = np.unique(hh, return_inverse=True)
        a = np.bincount(inverse, toxic[dd] == 1, len(u))
        b = np.bincount(inverse, toxic[dd] != 1, len(u))
        w = np.log((a + 0.5) / (p + 1)) - np.log((b + 0.5) / (n + 1))
        good = (a >= max(2, 0.01 * p)) & (w > 1.5) & (u != 0)
        keys.append(u[good])
        weights.append(w[good])
    keys, weights = map(np.concatenate, (keys, weights))
    order = np.argsort(keys)
    return keys[order], weights[order]


def features(column: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of features for each text; texts are taken in slices of about 1 MB."""
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    return np.concatenate([_features(part.column(0), lexicon) for part in pieces(batch, "text", 1 << 20)] or [np.zeros((0, 16))])


def _features(column: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    data, at = text_bytes(column)
    n_docs = len(at) - 1
    starts, ends, first, kind = _word_spans(data, at)
    doc, n = np.repeat(np.arange(n_docs), np.diff(first)), np.diff(first)
    low = lower(data)
    keys, weights = lexicon
    weight = np.zeros(len(starts))
    some = np.zeros(1 << 16, bool)
    some[keys >> U64(48)] = True
    whole = np.zeros(0, U64)
    for h in _terms(low, starts, ends):
        at_ = np.flatnonzero(some[h >> U64(48)]) if len(keys) else np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(keys, h[at_]), len(keys) - 1)
        hit = keys[i] == h[at_] if len(keys) else np.zeros(0, bool)
        weight[at_[hit]] = np.maximum(weight[at_[hit]], weights[i[hit]])
        whole = h
    second_bytes = text_bytes(pa.array(sorted(SECOND), pa.string()))
    second = np.sort(mix(hash_spans(second_bytes[0], second_bytes[1][:-1], second_bytes[1][1:]) + U64(len(LENGTHS))))
    i = np.minimum(np.searchsorted(second, whole), len(second) - 1)
    you = second[i] == whole
    strong, weak = weight > 3, (weight > 1.5) & (weight <= 3)
    seen = np.concatenate(([0], np.cumsum(you)))
    pos = np.arange(len(starts))
    lo, hi = np.maximum(first[doc], pos - 5), np.minimum(first[doc + 1], pos + 6)
    near = strong & (seen[hi] > seen[lo]) if len(pos) else strong
    # letters mixed with digits or signs inside a word; runs of one byte
    def inside(mask):
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[ends] - c[starts]

    letters, odd = inside((kind == 1) | (kind == 2)), inside((kind == 4) | (kind == 8))
    mixed = (letters > 1) & (odd > 0)
    run = np.zeros(len(data), bool)
    if len(data) > 2:
        run[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (kind[2:] == 1)
    stretched = inside(run) > 0
    caps_word = (inside(kind == 2) == letters) & (letters > 1)
    per = lambda x: np.bincount(doc, x, n_docs) if len(doc) else np.zeros(n_docs)
    d = np.maximum(n, 1)

    def share(mask):
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[at[1:]] - c[at[:-1]]) / np.maximum(np.diff(at), 1)

    top = np.zeros(n_docs)
    np.maximum.at(top, doc, weight)
    hits = per(strong)
    return np.stack([hits / d, np.log1p(hits), per(weak) / d, np.log1p(per(weak)), per(weight) / d, np.log1p(per(weight)), top, per(near) / np.maximum(hits, 1), per(you) / d, share(kind == 2), per(caps_word) / d, share((data == 33) | (data == 63)), share(kind == 8), per(mixed) / d, per(stretched) / d, np.log1p(n)], 1)


class Trees:
    """Boosted regression trees on the logistic loss, depth 3, over quantile bins."""

    def __init__(self, rounds: int = 80, rate: float = 0.15, depth: int = 3, bins: int = 32, least: float = 1.0):
        self.rounds, self.rate, self.depth, self.bins, self.least, self.trees = rounds, rate, depth, bins, least, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(len(y), np.int64), {}
            for level in range(self.depth):
                size = 1 << level
                gain, choice = np.full(size, 1e-9), [None] * size
                tg, th = np.bincount(node, g, size), np.bincount(node, h, size)
                for f in range(x.shape[1]):
                    k = len(self.cuts[f]) + 1
                    cell = node * k + b[:, f]
                    cg, ch = np.bincount(cell, g, size * k).reshape(size, k).cumsum(1), np.bincount(cell, h, size * k).reshape(size, k).cumsum(1)
                    lg, lh, rg, rh = cg[:, :-1], ch[:, :-1], tg[:, None] - cg[:, :-1], th[:, None] - ch[:, :-1]
                    if not lg.shape[1]:
                        continue
                    v = np.where((lh > 0.05) & (rh > 0.05), lg**2 / (lh + self.least) + rg**2 / (rh + self.least) - (tg**2 / (th + self.least))[:, None], 0)
                    best = v.argmax(1)
                    for i in np.flatnonzero(v[np.arange(size), best] > gain):
                        gain[i], choice[i] = v[i, best[i]], (f, int(best[i]))
                tree[level] = choice
                right = np.zeros(len(y), bool)
                for i, c in enumerate(choice):
                    if c:
                        m = node == i
                        right[m] = b[m, c[0]] > c[1]
                node = node * 2 + right
            size = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.least)
            score += leaf[node]
            self.trees.append((tree, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        score = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                f = np.array([c[0] if c else 0 for c in tree[level]])
                t = np.array([c[1] if c else 10**9 for c in tree[level]])
                node = node * 2 + (b[np.arange(len(x)), f[node]] > t[node])
            score += leaf[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: each block's mean ``x`` and its mean ``y``; values between blocks are interpolated.

    Equal ``x`` are one point from the start, so the result does not depend on their order.
    """
    points, place = np.unique(x, return_inverse=True)
    count = np.bincount(place, minlength=len(points))
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for xi, yi, n in zip(points.tolist(), np.bincount(place, y, len(points)).tolist(), count.tolist(), strict=True):
        blocks.append([yi, n, xi * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, texts: list[str], toxic: np.ndarray, seed: int = 7):
        self.rate = float(toxic.mean()) if len(toxic) else 0.0
        self.trees = None
        if not 0 < self.rate < 1 or min(toxic.sum(), (1 - toxic).sum()) < 4:
            return
        column = pa.array(texts, pa.string())
        half = np.zeros(len(toxic), np.int64)
        for c in (0, 1):  # halves of each class
            at = np.random.default_rng(seed).permutation(np.flatnonzero(toxic == c))
            half[at] = np.arange(len(at)) % 2
        x, out = None, np.zeros(len(toxic))
        for side in (0, 1):
            own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
            f = features(column.take(pa.array(own)), learn_lexicon(column.take(pa.array(other)), toxic[other]))
            x = np.zeros((len(toxic), f.shape[1])) if x is None else x
            x[own] = f
        for side in (0, 1):
            out[half == side] = Trees().fit(x[half != side], toxic[half != side]).raw(x[half == side])
        self.lexicon, self.trees = learn_lexicon(column, toxic), Trees().fit(x, toxic)
        self.steps, self.values = isotonic(out, toxic)

    def __call__(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.rate)
        return np.interp(self.trees.raw(features(column, self.lexicon)), self.steps, self.values)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, longest: int = LONGEST) -> Model:
    """Fit on labelled documents outside the held-out fold, at most about ``most`` of each class."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000))
    share = F.lit(0)
    for c, n in counts.items():
        share = F.when(F.col("toxic") == c, F.lit(int(1_000_000 * min(1.0, most / max(n, 1))))).otherwise(share)
    drawn = known.filter(draw < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # bounded by 2 * most, hence the broadcast
    rows = docs.select("doc_id", "text").filter((F.length("text") <= longest) & (F.length("text") > 0)).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text"])
    model = Model(rows["text"].tolist(), rows["toxic"].to_numpy().astype(np.float64))
    del rows
    give_back()  # the driver has more to do than to remember the sample
    return model


def scorer(spark, model: Model):
    """The model as a column function of texts."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        at, out, i = text_bytes(column)[1], [np.zeros(0)], 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + (4 << 20), "right")) - 1)
            out.append(shared.value(column.slice(i, j - i)))
            i = j
        return pa.array(np.concatenate(out))

    return score


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5)."""
    df = without(df, ("score", "predicted"))
    return df.withColumn("score", scorer(df.sparkSession, model)(F.col(quoted(text_col)))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the model does not reject, with their own columns."""
    return df.filter(scorer(df.sparkSession, model)(F.col(quoted(text_col))) < 0.5)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
