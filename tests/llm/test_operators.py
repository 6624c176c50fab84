"""Each operator against brute force on small tables with nulls, blanks, repeats, ties and clashing columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import op1_packing, op2_language, op3_token_counts, op4_toxicity, op5_url_rules, op6_substring, op7_spotsigs, op8_topk, op9_chosen_path, op10_mixing, queries
from tests_data import DATA, views

R = random.Random(4)
VOCAB = ["".join(R.choice("abcdefg") for _ in range(R.randint(2, 6))) for _ in range(400)]


def text(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


LONG = text(9000)
BASE = text(60)
TEXTS = [text(30), BASE, BASE + " tail", BASE, None, "", "  \n", "one", "two words", LONG, text(40) + " " + " ".join(BASE.split()[10:40]), BASE.replace(VOCAB[3], "x"), "Ünï ode 字 字", text(8)]
DOCS = [(i, t, "en", "s%d" % (i % 3) if i % 4 else None, len(t or "")) for i, t in enumerate(TEXTS)] + [(1, BASE, "en", "s1", len(BASE))]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clash(docs):
    for c in ("size", "score", "n_words", "kept_text", "copies", "host", "predicted", "__grp"):
        docs = docs.withColumn(c, F.lit("own"))
    return docs


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    views(con)
    rows = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()))
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_packing_round_trip(spark, clash):
    out = op1_packing.pack(clash, capacity=64, cut=16, windows=4, with_ids=True).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op1_packing.default_tokenizer())
    pieces, seqs = {}, {}
    for r in out:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        got = [x for r in sorted(pieces[i], key=lambda r: r["start"]) for x in r["ids"]]
        assert got == want if i != 1 else sorted(got) == sorted(want * 2)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert op1_packing.pack(nothing(spark)).count() == 0


def test_differencing_balances():
    sizes = np.array([R.randint(1, 256) for _ in range(500)])
    window = op1_packing.fill(sizes, 1024)
    sums = np.bincount(window, sizes)
    assert sums.max() <= 1024 and len(sums) <= -(-sizes.sum() // 1024) + 1


def test_gradients():
    net = op2_language.Net(3, 4)
    b, y = np.random.default_rng(0).integers(1, 255, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    grad, _ = net.step(b, y)
    for k in ("uf", "ub", "o"):
        at = (1, 2)
        eps, old = 1e-5, net.p[k][at]
        net.p[k][at] = old + eps
        up = net.step(b, y)[1]
        net.p[k][at] = old - eps
        down = net.step(b, y)[1]
        net.p[k][at] = old
        assert abs((up - down) / (2 * eps) - grad[k][at]) < 1e-4


def test_language(spark, clash):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = op2_language.train(docs)
    seen = op2_language.identify(docs, model).filter(op2_language.held_out()).filter("n_chars > 100").toPandas()
    assert (seen.lang_pred == seen.lang).mean() > 0.95
    got = {r["doc_id"]: r for r in op2_language.identify(clash, model).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[4]["score"] == 0
    assert op2_language.identify(nothing(spark), op2_language.train(nothing(spark))).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(op2_language, "Model", lambda excerpts, langs: set(langs))
    docs = spark.createDataFrame([(i, text(6), f"l{i % 230}") for i in range(2300)], "doc_id long, text string, lang string")
    assert len(op2_language.train(docs)) == 230


def test_token_counts(spark, docs):
    lengths = sorted(r["length"] for r in op3_token_counts.token_lengths(docs).collect())
    got = op3_token_counts.limits(op3_token_counts.histogram(op3_token_counts.token_lengths(docs)), block=16).collect()
    for r in got:
        n = r["length"]
        assert r["docs_above"] == sum(x > n for x in lengths) and r["kept_tokens"] == sum(min(x, n) for x in lengths)
        assert r["kept_tokens"] + r["lost_tokens"] == sum(lengths)
    assert op3_token_counts.limits(op3_token_counts.histogram(op3_token_counts.token_lengths(nothing(spark)))).count() == 0


def test_toxicity(spark, clash):
    some = DATA.replace("0.001", "0.01")  # the smallest table has nine toxic labels
    docs, labels = spark.read.parquet(f"{some}/documents.parquet"), spark.read.parquet(f"{some}/labels.parquet")
    model = op4_toxicity.train(docs, labels)
    seen = op4_toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter(op4_toxicity.held_out()).toPandas()
    assert ((seen.predicted == seen.toxic).mean()) > 0.93
    assert seen.score[seen.toxic == 1].mean() > seen.score[seen.toxic == 0].mean() + 0.3 and seen.score.between(0, 1).all()
    assert op4_toxicity.score_toxicity(clash, model).filter("score is null").count() == 0
    assert op4_toxicity.without_toxic(clash, model).columns == clash.columns
    assert op4_toxicity.train(nothing(spark), labels.limit(0))(pa.array(["x"]))[0] == 0


def test_url_rules(spark):
    urls = ["http://A.example.COM/en/7x?q", "http://example.com/en/8", "https://com/en/", "https://xcom/en/", "x://a.net/de/8", "x://a.example.net/de/81#h", None, "nothing", "http://", "https://b.org/es/?", "http://a.org/ES/"]
    rows = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)] + [(0, urls[0], "own")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op5_url_rules.url_verdicts(rows, ranges=3).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2][2:] == ("com/en/", "block") and got[3][2] is None and got[4][2:] == ("net/de/", "block") and got[5][2:] == ("example.net/de/8", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[9][2] == "org/es/" and got[10][2] is None
    assert op5_url_rules.url_verdicts(rows.limit(0)).count() == 0


def brute_substring(docs, n=13):
    words = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t, *_ in docs]
    low = {}
    for i, w in words:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            low[k] = min(low.get(k, i), i)
    out = []
    for i, w in words:
        gone = {p for s in range(len(w) - n + 1) if low[tuple(w[s : s + n])] < i for p in range(s, s + n)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_substring(spark, docs, clash):
    got = op6_substring.substring_dedup(docs, group_bytes=1000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_substring(DOCS)
    assert op6_substring.without_repeats(clash).columns == clash.columns
    assert op6_substring.substring_dedup(nothing(spark)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fingerprints(spark, clash, parts):
    rows = sorted(((-i, t or "") for i, t, *_ in DOCS))
    got = op7_spotsigs.neighbours(clash, parts=parts).collect()
    texts = [t for _, t in rows]
    want = []
    for k, (i, t) in enumerate(rows):
        u = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        own = brute_signatures(t)
        want.append((-i, len(t), hashlib.sha256(edited.encode()).hexdigest(), len(own), jaccard(own, brute_signatures(edited)), jaccard(own, brute_signatures(u))))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], int(r["fingerprint"].split(":")[0]), r["near_edited"], r["near_next"]) for r in got) == sorted(want)
    prints = {}
    for r in got:
        prints.setdefault(TEXTS[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert op7_spotsigs.neighbours(nothing(spark)).count() == 0


def test_similar_fingerprints(spark, clash):
    sets = {}
    for i, t, *_ in DOCS:
        s = frozenset(brute_signatures(t or ""))
        if s:
            sets[s] = min(i, sets.get(s, i))
    want = {(min(a, b), max(a, b)): jaccard(x, y) for x, a in sets.items() for y, b in sets.items() if a != b and jaccard(x, y) >= 0.5}
    assert {(r["a"], r["b"]): r["likeness"] for r in op7_spotsigs.similar(clash, 0.5).collect()} == want and want


def brute_signatures(t):
    """Signatures of a text, as strings."""
    signs = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"
    w = [x.strip(signs) or x[-1] for x in "".join(c.lower() if c.isascii() else c for c in t).encode().decode().translate(dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")).split(" ") if x]
    spots = [i for i, x in enumerate(w) if x in op7_spotsigs.COMMON]
    content = [i for i in range(len(w)) if i not in set(spots)]
    out = {(w[i], w[i + 1] if i + 1 < len(w) else None) for i in range(len(w)) if not any(max(0, i - 9) <= s <= i for s in spots)}
    return out | {(w[s], "chain", *([w[c] for c in content if c > s][:2] + [None, None])[:2]) for s in spots}


def test_likeness_of_long_texts(spark):
    common = [*op7_spotsigs.COMMON[:12]]
    long = [" ".join(R.choice(common if R.random() < 0.2 else VOCAB) for _ in range(n)) for n in (900, 2500, 700, 60)]
    w = long[1].split()
    w[1200] = "edited"
    texts = [*long[:2], " ".join(w), *long[2:]]
    got = op7_spotsigs.neighbours(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), parts=2).collect()
    for r in got:
        t, u = texts[r["doc_id"]], texts[r["doc_id"] - 1]
        own, edited = brute_signatures(t), brute_signatures(t[: len(t) - len(t) // 3] + u[: len(t) // 3])
        assert r["near_next"] == jaccard(own, brute_signatures(u)) and r["near_edited"] == jaccard(own, edited)
        for column, want in (("fingerprint", own), ("edited_fingerprint", edited)):
            n, hashes = r[column].split(":")
            assert int(n) == len(want) and len({hashes[k : k + 16] for k in range(0, len(hashes), 16)}) == len(want)
    assert 0.98 < {r["doc_id"]: r["near_next"] for r in got}[2] < 1


def test_top_k(spark):
    r = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in np.float32(r.normal(size=6) * (5 if i % 7 == 0 else 1))]) for i in range(120)] + [(200, None), (201, [1.0, None] * 3), (202, [float("nan")] * 6), (203, [1.0]), (204, [])]
    vecs += [(300 + i, vecs[0][1]) for i in range(30)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = {}
    for x in op8_topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    ints = {i: np.floor(64 * np.array(v, np.float64)) for i, v in vecs if v and len(v) == 6 and None not in v and np.isfinite(v).all()}
    for q, found in got.items():
        want = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:5]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert set(got) == {i for i in ints if i % 20 == 0}
    assert op8_topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_links(docs, num=85, den=100):
    sets = {}
    for i, t, *_ in docs:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split()
        sets[i] = {tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_corpus():
    out, base = [], text(90).split()
    for i in range(70):  # more than one node of near copies, and a chain
        w = list(base)
        for _ in range(R.randint(0, 3)):
            w[R.randrange(len(w))] = R.choice(VOCAB)
        out.append((100 + i, " ".join(w)))
    passage = text(30)
    out += [(300 + i, passage + " " + text(R.randint(1, 12))) for i in range(60)]
    return out


def test_near_duplicates_at_the_pipelines_threshold(spark):
    many = near_corpus()
    got = op9_chosen_path.near_duplicates(spark.createDataFrame(many, "doc_id long, text string"), num=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(many, num=80)


def test_near_duplicates(spark, clash):
    many = near_corpus() + [(i, t) for i, t, *_ in DOCS if i != 9]
    df = spark.createDataFrame(many, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op9_chosen_path.near_duplicates(df).collect()}
    assert got == brute_links(many)
    assert op9_chosen_path.keep_first(clash).columns == clash.columns
    assert op9_chosen_path.near_duplicates(nothing(spark)).count() == 0


def test_mixing(spark, docs, clash):
    got = op10_mixing.mix_sources(docs).collect()
    total = sum(r["size"] for r in got)
    targets = {r["source"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, op10_mixing.mix_sources(docs).collect()))
    mixed = op10_mixing.mixed_rows(clash)
    assert mixed.columns == clash.columns and mixed.count() == sum(r["copies"] for r in got)
    assert op10_mixing.mix_sources(nothing(spark)).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, BASE, "en", None, 1), (3, BASE, "en", None, 1), (None, None, None, None, None)], SCHEMA)
    assert op1_packing.pack(rows).count() >= 3
    assert op6_substring.substring_dedup(rows).filter("n_removed > 0").count() == 0
    assert op7_spotsigs.neighbours(rows).count() == 3
    assert op9_chosen_path.near_duplicates(rows).filter("kept").count() == 2 and op9_chosen_path.keep_first(rows).count() == 2
    assert op10_mixing.mix_sources(rows).count() == 3
