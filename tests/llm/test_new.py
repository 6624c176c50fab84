"""Exact dedup, whitening and alignment against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import op4_toxicity as op4
from skyloom.llm import op6_substring as op6
from skyloom.llm import op8_topk as op8
from skyloom.llm import op11_alignment as op11
from skyloom.llm import op12_whitening as op12
from skyloom.llm import op13_exact_dedup as op13

R = random.Random(33)
TEXTS = ["same", "same", None, "", " ", "same ", "Same", "x" * 300_000, "x" * 300_000, "ünï", "字字", None] + ["hot"] * 40
DOCS = [(i, t, "o", "p") for i, t in enumerate(TEXTS)] + [(None, "same", "o", "p"), (None, "null ids", "o", "p"), (None, "null ids", "o", "p"), (3, "", "o", "p"), (3, "", "o", "p")]
SCHEMA = "doc_id long, text string, h string, `a.b` string"


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bits", [128, 8])
def test_exact_groups(spark, keep, bits):
    rows = DOCS + [(1000 + i, f"t{i % 700}", "o", "p") for i in range(1000)]  # 8 bits: every hash collides
    got = op13.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), keep=keep, bits=bits).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert Counter((r.doc_id, by_hash[r.text_sha256]) for r in got) == Counter((i, t or "") for i, t, *_ in rows)
    for r in got:
        t = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(by_hash[r.text_sha256] for r in got if r.kept) == Counter(list(groups))  # one row of each text


def test_exact_dedup_rows(spark):
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(2)
    out = op13.exact_dedup(df)
    assert out.columns == df.columns
    assert Counter(r.text or "" for r in out.collect()) == Counter({t or "" for _, t, *_ in DOCS})
    lower = op13.exact_dedup(df, same=F.lower).collect()
    assert sorted(r.text for r in lower if r.text and r.text.lower() == "same") == ["same"]
    assert op13.exact_dedup(df.limit(0)).count() == op13.exact_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="keep"):
        op13.exact_groups(df, keep="any")


def test_primes_and_remainders():
    for bound in (0, 5, 2**40, 2**130):
        moduli = op12.primes(bound)
        assert len(set(moduli)) == len(moduli) and max(moduli) < 1 << 22
        for x in (0, bound, -bound, bound // 3, -(bound // 7)):
            assert op12.remaindered([x % p for p in moduli], moduli) == x


def _brute(vectors):
    """n, sums and the exact covariance of the distinct integer vectors."""
    fit = sorted({tuple(v) for v in vectors})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    y = [[n * v[j] - s[j] for j in range(d)] for v in fit]
    return n, s, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_whitening(spark, scale):
    g = np.random.default_rng(3)
    v = (g.normal(size=(300, 6)) * scale * [4, 3, 2, 1, 0.5, 0.1] + 7 * scale).astype(np.float32)
    rows = [(i, [float(c) for c in x], "own") for i, x in enumerate(v)] + [(0, [float(c) for c in v[0]], "own")] * 50
    odd = [(900, None, ""), (901, [], ""), (902, [None] + [1.0] * 5, ""), (903, [float("nan")] * 6, ""), (904, [float("inf")] * 6, ""), (905, [1.0] * 5, ""), (906, [1e300] * 6, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component string").repartition(4)
    got = op12.whiten(df).toPandas()
    x = [[int(np.floor(256.0 * c)) for c in r[1]] for r in rows]
    n, s, cov = _brute(x)
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n}
    e, w = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    trace = float(sum(cov[j][j] for j in range(6)))
    want = {i: sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for (i, *_), r in zip(rows, x, strict=True)}
    for k in range(4):
        part = got[got["component"] == k + 1]
        assert abs(part["explained"] - e[5 - k] / trace).max() < 1e-12
        z = {i: float((np.array(r) - np.array(s) / n) @ w[:, 5 - k] / np.sqrt(e[5 - k])) for (i, *_), r in zip(rows, x, strict=True)}
        sign = np.sign(z[1] * part[part["vec_id"] == 1]["whitened"].iloc[0])
        assert max(abs(a - sign * z[i]) for i, a in zip(part["vec_id"], part["whitened"], strict=True)) < 1e-8
        assert all((None if np.isnan(a) else int(a)) == (want[i] if want[i] < 2**63 else None) or a == want[i] for i, a in zip(part["vec_id"], part["deviation"], strict=True))
    assert 0 <= got["identity_error"].max() < 1e-8 and got["identity_error"].nunique() == 1


def test_exact_covariance(spark):
    g = np.random.default_rng(8)
    x = g.integers(-(2**40), 2**40, (500, 5))
    x[:, 0] += 2**50  # a large mean: centring in doubles would lose digits
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(3)
    fit = op12.Fit(df, 5)
    n, s, cov = _brute(x.tolist())
    assert (fit.n, fit.sums) == (n, s)
    assert fit.covariance.tolist() == [[float(c) for c in r] for r in cov]


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    one = op12.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error == 0.0 and r.deviation == 0 and r.n == 1 for r in one)
    flat = op12.whiten(spark.createDataFrame([(i, [float(i % 3), 0.5]) for i in range(6)], schema)).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    assert op12.whiten(spark.createDataFrame([], schema)).count() == 0
    assert op12.whiten(spark.createDataFrame([(1, None)], schema)).columns == op12.whiten(spark.createDataFrame([(1, [1.0])], schema)).columns


WORDS = ["the", "of", "Straße", "字", "naïve", "x1", "<|endoftext|>", "<s>", "  ", "\t", "\n\n", "don't", "🙂", "<0x41>", "2024", "..."]


def _align_brute(rows):
    """Alignment by bytes: which token of each side covers each byte."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op11.default_tokenizer())
    tok.encode_special_tokens = True
    a_side, b_side = op11.SideA(op11.default_tokenizer()), op11.SideB(op11.default_pieces())
    docs = []
    for i, t in rows:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.model.encode(t) if t else []
        text = (" " + t).encode() if t else b""
        if b"".join(a_side.bytes[x] for x in a) != text or b"".join(b_side.bytes[x] for x in b) != text:
            a, b = [], []
        over_a = [k for k, x in enumerate(a) for _ in a_side.bytes[x]]
        over_b = [k for k, x in enumerate(b) for _ in b_side.bytes[x]]
        links = Counter((a[p], b[q]) for p, q in dict.fromkeys(zip(over_a, over_b, strict=True)))
        ends = lambda over: {k + 1 for k in range(len(over)) if k + 1 == len(over) or over[k] != over[k + 1]}
        at, groups = 0, []
        for stop in sorted(ends(over_a) & ends(over_b)):
            groups.append(",".join(str(a[p]) for p in sorted(set(over_a[at:stop]))) + "|" + ",".join(str(b[q]) for q in sorted(set(over_b[at:stop]))))
            at = stop
        docs.append((i, len(a), len(b), groups, links))
    count = Counter(p for *_, links in docs for p in links)
    best = {}
    for (x, _), c in count.items():
        best[x] = max(best.get(x, 0), c)
    return sorted((i, n_a, n_b, len(g), sum(links.values()), sum(m for p, m in links.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in links.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, links in docs)


@pytest.mark.parametrize("block,part", [(1 << 20, 1 << 20), (200, 64)])
def test_alignment(spark, block, part):
    rows = [(0, None), (1, ""), (2, " "), (3, "   "), (4, "a "), (5, "▁x"), (6, "a▁b"), (7, "the of " * 5000), (8, "x" * 20_000), (9, "a\x00b"), (10, "  two  spaces  "), (11, "   nbsp"), (11, "repeated id"), (12, "ﬁ ﬀ Å")]
    rows += [(100 + i, R.choice(["", " "]).join(R.choice(WORDS) + R.choice(["", " ", "  "]) for _ in range(R.randint(1, 60)))) for i in range(120)] + [(500 + i, "the of the") for i in range(200)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, n_a string").repartition(5)
    got = sorted(tuple(r) for r in op11.align(df, block=block, part=part).collect())
    assert got == _align_brute(rows)


def test_alignment_of_nothing(spark):
    out = op11.align(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and out.count() == 0
    assert op11.align(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_isotonic_with_ties():
    y = np.array([0, 1, 1, 0, 1, 0, 1, 1], float)
    x = np.array([0, 0, 0, 1, 1, 2, 2, 2], float)
    want = op4.isotonic(x, y)
    for seed in range(20):
        at = np.random.default_rng(seed).permutation(len(x))
        got = op4.isotonic(x[at], y[at])
        assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert (np.diff(want[0]) > 0).all() and (np.diff(want[1]) > 0).all()
    assert np.interp(0, *want) == pytest.approx(0.6)  # the first two points, 3 of 5 toxic, are one block


def test_dealing_is_linear_and_whole():
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 3000, np.uint64))
    for parts in (1, 7, 2**31 - 1):
        t = op6._ask(5, keys, keys, parts)
        assert b"".join(t.column("keys").to_pylist()) == keys.tobytes() and t.num_rows <= min(parts, len(keys)) and set(t.column("grp").to_pylist()) == {5}
        assert [min(int(k) * parts >> 64 for k in np.frombuffer(x, np.uint64)) for x in t.column("keys").to_pylist()] == t.column("part").to_pylist() or parts > 2**20
    assert op6._ask(0, keys[:0], keys[:0], 9).num_rows == 0


def test_substring_with_dotted_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "x", "y"), (2, "lead " + text, "x", "y")], "doc_id long, text string, `a.b` string, `c``d` string")
    out = op6.without_repeats(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: text, 2: "lead "}


def test_topk_sends_only_what_is_asked(spark, monkeypatch):
    """Long vectors settle most queries, so their ranges alone are sent; results are those of brute force."""
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=(60, 8)) * 40, g.normal(size=(540, 8)) * 0.2])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    sent, plain = [], op8.dealt

    def counted(rows, stats, asked):
        out = plain(rows, stats, asked)
        sent.append((out.count(), rows.count()))
        return out

    monkeypatch.setattr(op8, "dealt", counted)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op8.top_k(df, F.col("vec_id") % 30 == 0, k=5, block=64, queries=8, ranges=8).collect())
    v = np.floor(64 * x).astype(np.int64)
    want = []
    for q in range(0, 600, 30):
        s = v @ v[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:5]
        want += [(q, n, i, int(s[i])) for n, i in enumerate(best, 1)]
    assert got == sorted(want)
    blocks = -(-20 // 8)
    assert len(sent) == 2 and sent[0][0] + sent[1][0] < blocks * sent[0][1] / 2  # all ranges to all query blocks would be blocks * rows
