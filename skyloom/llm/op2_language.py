"""Language identification by a bidirectional gated recurrent network over bytes.

Two small gated recurrent layers read windows of bytes forwards and backwards; a softmax on both states labels every
position, and a text's probabilities are the mean over all its positions. It is trained in numpy by backpropagation
through time with Adam; gates use the piecewise linear sigmoid and the candidate the softsign, so that inference is
made of products, sums and clips. Every byte of every text is read, in windows of ``SPAN`` bytes, where the text lies.

Training takes a bounded sample: about ``most`` documents per language drawn by a hash of the id, ``spots`` excerpts of
each. Defined cases: null texts and texts without letters are ``und`` with score 0; without training rows all texts are
``und``; of tied languages the first by name wins; repeated rows are predicted alike; very long texts are read whole in spans; extra
columns stay, and columns named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_bytes

HIDDEN, SPAN, LEARN, BLOCK = 8, 128, 64, 4096
MOST, SPOTS = 500, 6


class Net:
    """Weights of one direction: x [256, 3H] for bytes, u [3H, H] recurrent; rows are update, reset, candidate."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 3):
        r = np.random.default_rng(seed)
        self.h, self.c = hidden, classes
        self.p = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.5, (256, 3 * hidden))
            self.p["u" + d] = r.normal(0, 0.6 / hidden**0.5, (3 * hidden, hidden))
        self.p["o"] = r.normal(0, 0.3, (classes, 2 * hidden))
        self.p["c"] = np.zeros((classes, 1))

    def _forward(self, b: np.ndarray, d: str):
        """b: bytes [T, N]; states [T + 1, H, N] and what the backward pass needs."""
        h, (steps, n) = self.h, b.shape
        x, u = self.p["x" + d], self.p["u" + d]
        state = np.zeros((steps + 1, h, n))
        saved = []
        for t in range(steps):
            a, s = x[b[t]].T, u @ state[t]
            z, r = np.clip(0.25 * (a[:h] + s[:h]) + 0.5, 0, 1), np.clip(0.25 * (a[h : 2 * h] + s[h : 2 * h]) + 0.5, 0, 1)
            z = z * (b[t] > 0)  # padding keeps the state
            m = a[2 * h :] + r * s[2 * h :]
            q = 1 / (1 + np.abs(m))
            state[t + 1] = state[t] + z * (m * q - state[t])
            saved.append((z, r, s[2 * h :], m * q, q))
        return state, saved

    def _backward(self, b, d, state, saved, up, grad):
        """up: gradient of each step's state [T, H, N]."""
        h = self.h
        u, gx, gu, carry = self.p["u" + d], grad["x" + d], grad["u" + d], np.zeros_like(state[0])
        for t in range(len(b) - 1, -1, -1):
            z, r, s, c, q = saved[t]
            g = carry + up[t]
            gm = g * z * q * q
            gz = g * (c - state[t]) * 0.25 * ((z > 0) & (z < 1))
            gr = gm * s * 0.25 * ((r > 0) & (r < 1))
            low = np.vstack([gz, gr, gm * r])
            np.add.at(gx, b[t], np.vstack([gz, gr, gm]).T)
            gu += low @ state[t].T
            carry = g * (1 - z) + u.T @ low

    def step(self, b: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Gradients and loss of bytes [N, T] with a class each, labelled at every position."""
        b = b.T
        back = b[::-1]
        (sf, kf), (sb, kb) = self._forward(b, "f"), self._forward(back, "b")
        both = np.concatenate([sf[1:], sb[1:][::-1]], 1)  # [T, 2H, N]
        logit = np.einsum("ch,thn->tcn", self.p["o"], both) + self.p["c"]
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        on = (b > 0) / max(1, (b > 0).sum())
        loss = -(np.log(p[:, y, np.arange(len(y))] + 1e-12) * on).sum()
        p[:, y, np.arange(len(y))] -= 1
        g = p * on[:, None, :]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"], grad["c"] = np.einsum("tcn,thn->ch", g, both), g.sum((0, 2))[:, None]
        up = np.einsum("ch,tcn->thn", self.p["o"], g)
        self._backward(b, "f", sf, kf, up[:, : self.h], grad)
        self._backward(back, "b", sb, kb, up[::-1, self.h :], grad)
        return grad, float(loss)

    def fit(self, b: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(y), min(batch, len(y)))
            grad, self.loss = self.step(b[pick], y[pick])
            now = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            norm = max(1.0, sum(float((g * g).sum()) for g in grad.values()) ** 0.5)
            for k, g in grad.items():
                g = g / norm
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return self.ready()

    def ready(self) -> Net:
        """Weights for inference: float32, gates scaled for a plain clip, padding keeps the state."""
        h = self.h
        scale = np.concatenate([np.full(2 * h, 0.25), np.ones(h)])
        shift = np.concatenate([np.full(2 * h, 0.5), np.zeros(h)])
        self.fast = {}
        for d in "fb":
            x = (self.p["x" + d] * scale + shift).T.copy()
            x[:h, 0] = -1e6
            self.fast[d] = (x.astype(np.float32), (self.p["u" + d] * scale[:, None]).astype(np.float32))
        self.fast["o"] = (self.p["o"].astype(np.float32), self.p["c"].astype(np.float32))
        return self

    def label(self, b: np.ndarray) -> np.ndarray:
        """Sum over positions of the class probabilities of windows [N, T] (0 is padding): [C, N]."""
        n, steps = b.shape
        h, by_time = self.h, np.ascontiguousarray(b.T)
        states = {}
        for d in "fb":
            x, u = self.fast[d]
            s, all_ = np.zeros((h, n), np.float32), np.empty((steps, h, n), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a, r = np.take(x, by_time[t], axis=1), u @ s
                a[: 2 * h] += r[: 2 * h]
                np.clip(a[: 2 * h], 0, 1, out=a[: 2 * h])
                c = r[2 * h :]
                c *= a[h : 2 * h]
                c += a[2 * h :]
                c /= np.abs(c) + np.float32(1)
                c -= s
                c *= a[:h]
                s = s + c
                all_[t] = s
            states[d] = all_
        o, c = self.fast["o"]
        total = np.zeros((self.c, n), np.float32)
        for t in range(steps):
            e = np.exp(o[:, :h] @ states["f"][t] + (o[:, h:] @ states["b"][t] + c))
            e *= (by_time[t] > 0) / e.sum(0)
            total += e
        return total


class Model:
    def __init__(self, excerpts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.net = None
        if not langs:
            return
        raw = [x.encode()[:LEARN] for x in excerpts]
        b = np.zeros((len(raw), LEARN), np.uint8)
        for i, x in enumerate(raw):
            b[i, : len(x)] = np.frombuffer(x, np.uint8)
        y = np.searchsorted(self.langs, langs)
        self.net = Net(len(self.langs)).fit(b, y)

    def __call__(self, column: pa.Array) -> tuple[list, np.ndarray]:
        """Language and score of each text."""
        told = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if self.net is None:
            return ["und"] * len(told), np.zeros(len(told))
        data, at = text_bytes(column)
        size = np.diff(at)
        n = -(-size // SPAN)
        owner = np.repeat(np.arange(len(size)), n)
        start = at[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * SPAN
        stop = np.minimum(start + SPAN, at[owner + 1])
        total = np.zeros((len(self.langs), len(size)))
        padded = np.concatenate([data, np.zeros(SPAN, np.uint8)])
        for i in range(0, len(owner), BLOCK):
            s, e = start[i : i + BLOCK], stop[i : i + BLOCK]
            b = padded[s[:, None] + np.arange(SPAN)]
            b[np.arange(SPAN) >= (e - s)[:, None]] = 0
            p = self.net.label(b)
            for c in range(len(p)):
                total[c] += np.bincount(owner[i : i + BLOCK], p[c], len(size))
        best = total.argmax(0)
        score = total.max(0) / np.maximum(total.sum(0), 1e-9)
        return [self.langs[i] if k else "und" for i, k in zip(best, told, strict=True)], np.where(told, np.clip(score, 0, 1), 0.0)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, most: int = MOST, spots: int = SPOTS) -> Model:
    """Fit on excerpts of about ``most`` documents per language outside the held-out fold; the driver holds languages times ``most`` of them."""
    known = docs.filter(~held_out()).filter("lang is not null and doc_id is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("__n"))  # a row for each language
    share = F.floor(F.lit(1_000_000) * F.least(F.lit(1.0), F.lit(most) / F.col("__n")))
    drawn = known.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share)
    spot = F.transform(F.sequence(F.lit(0), F.lit(spots - 1)), lambda i: F.substr("text", (1 + i * F.floor(F.length("text") / spots)).cast("int"), F.lit(LEARN)))
    rows = drawn.select("doc_id", "lang", F.explode(F.array_distinct(spot)).alias("x")).filter(F.length("x") > 3).toPandas().sort_values(["doc_id", "x"])
    return Model(rows["x"].tolist(), rows["lang"].tolist())


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        at, langs, scores, i = text_bytes(column)[1], [], [np.zeros(0)], 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + (4 << 20), "right")) - 1)
            a, b = shared.value(column.slice(i, j - i))
            langs += a
            scores.append(b)
            i = j
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    names = [quoted(c) for c in df.columns if c.lower() not in ("lang_pred", "score")]
    both = df.select(F.struct(*names).alias("own"), predict(F.col(quoted(text_col))).alias("told"))
    return both.select(*[F.col(f"own.{c}") for c in names], "told.lang_pred", "told.score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
