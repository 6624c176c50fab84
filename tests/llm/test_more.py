"""Corpus operators where the first tests did not reach: clashing names, repeats, overflow, pruning, models by brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import op2_language, op3_token_counts, op4_toxicity, op5_url_rules, op8_topk, op9_chosen_path, op10_mixing
from skyloom.llm.common import durable, forget, numbered
from tests_data import DATA

R = random.Random(12)


def test_url_rules_with_clashing_names_ties_and_long_urls(spark):
    urls = ["http://a.example.com/en/7", "http://com/en/" + "x" * 200_000, "http://" + "a." * 60 + "com/en/1", "http://deep.a.example.com/en/8", "http://b.net/de/1", "http://b.net/de/1"]
    df = spark.createDataFrame([(i, u, "own", "own", "own", "own") for i, u in enumerate(urls)], "page_id long, url string, HOST string, __key string, key string, Rule string")
    rules = [("block", "com/en/"), ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "net/de/"), ("block", "net/d"), ("allow", "a.example.com/en/8"), ("block", "a.example.com/en/9")]
    for given in (rules, spark.createDataFrame(rules, "verdict string, rule string")):
        for ranges in (1, 3):
            out = op5_url_rules.url_verdicts(df, given, ranges=ranges)
            assert out.columns == ["page_id", "url", "__key", "key", "host", "path", "rule", "verdict"]
            got = {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()}
            assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("com/en/", "block"), 3: ("a.example.com/en/8", "allow"), 4: ("net/de/", "block"), 5: ("net/de/", "block")}
    assert {r["verdict"] for r in op5_url_rules.url_verdicts(df, [("block", "org/")]).collect()} == {"allow"}


def test_url_rules_against_brute_force(spark):
    hosts = [".".join(R.choice("abc") for _ in range(R.randint(1, 4))) for _ in range(60)]
    rules = [(R.choice(("block", "allow")), R.choice(hosts) + "/" + R.choice(("", "x", "x/y"))) for _ in range(80)]
    urls = [(i, "http://" + R.choice(hosts) + "/" + R.choice(("", "x", "x/y/z", "y"))) for i in range(300)]

    def judge(url):
        host, _, path = url[7:].partition("/")
        fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and ("/" + path).startswith("/" + r.split("/", 1)[1])]
        return max(fit)[1:] if fit else (None, "allow")

    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op5_url_rules.url_verdicts(spark.createDataFrame(urls, "page_id long, url string"), rules, ranges=5).collect()}
    assert got == {i: judge(u) for i, u in urls}


def test_url_rules_reach_subdomains_of_the_highest_code_point(spark):
    hosts = [first + str(i) + ".net" for i in range(40) for first in ("\U0010ffff", "\U0010fffe", "a")]
    df = spark.createDataFrame([(i, f"http://{h}/de/{i}") for i, h in enumerate(hosts)] + [(900, "http:///x")], "page_id long, url string")
    for ranges in (1, 7, 40):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op5_url_rules.url_verdicts(df, [("block", "net/de/"), ("block", "/x")], ranges=ranges).collect()}
        assert got == {i: ("net/de/", "block") for i in range(len(hosts))} | {900: ("/x", "block")}


def brute_top(q_ids, q, c_ids, c, k):
    return {i: sorted((-int(a @ b), j) for j, b in zip(c_ids.tolist(), c.astype(object), strict=True) if j != i)[:k] for i, a in zip(q_ids.tolist(), q.astype(object), strict=True)}


@pytest.mark.parametrize("scale", [1, 40])
def test_search_prunes_by_length_and_coordinates(scale):
    r = np.random.default_rng(3)
    for dim in (4, 64):
        c = np.floor(r.normal(size=(3000, dim)) * r.pareto(1.5, size=(3000, 1)) * 20).astype(np.int64) * scale
        q = np.vstack([c[:20], np.eye(dim, dtype=np.int64)[:3] * 900])
        ids, qids = r.permutation(3000), np.concatenate([np.zeros(20, np.int64), [-1, -2, -3]])
        qids[:20] = ids[:20]
        want = brute_top(qids, q, ids, c, 5)
        for floor in (None, np.array([float(-want[i][-1][0]) for i in qids.tolist()])):
            row, found, score = op8_topk.search_block(qids, q, ids, c, 5, floor, bucket=128)
            for n, i in enumerate(qids.tolist()):
                assert sorted(zip((-score[row == n]).tolist(), found[row == n].tolist(), strict=True))[:5] == want[i]


def test_products_beyond_float_and_beyond_long(spark):
    big = [(i, [float(2**22 + i), 1.0, float(-i)]) for i in range(45)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    ints = {i: [64 * int(x) for x in v] for i, v in big}
    got = {}
    for x in op8_topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect():
        got.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
    assert {q: sorted(s) for q, s in got.items()} == {q: sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:3] for q in (0, 20, 40)}
    for huge in (3e8, 1e18):
        with pytest.raises(Exception, match="fit a long"):
            op8_topk.top_k(spark.createDataFrame([(0, [huge] * 8), (1, [huge] * 8)], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_top_k_over_many_ranges_and_blocks(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(400, 8)) * r.pareto(1.0, size=(400, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for x in op8_topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=30, queries=6, ranges=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], -x["score"], x["vec_id"]))
    ints, ids = np.floor(64 * v).astype(np.int64), np.arange(400)
    want = brute_top(ids[::20], ints[::20], ids, ints, 7)
    assert {q: [x[1:] for x in sorted(s)] for q, s in got.items()} == want


def test_near_duplicates_of_repeated_ids(spark):
    b, c = (" ".join(R.choice("klmnop") * 3 + str(R.randint(0, 99)) for _ in range(40)) for _ in range(2))
    rows = [(5, b), (5, c), (1, b), (2, c), (None, b), (7, "alone"), (7, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in op9_chosen_path.near_duplicates(df).collect())
    assert got == sorted([("5", 1, False), ("5", 2, False), ("1", 1, True), ("2", 2, True), ("None", 1, False), ("7", 7, True), ("7", 7, True)])
    assert sorted(r["doc_id"] for r in op9_chosen_path.keep_first(df).collect()) == [1, 2, 7]


def test_mixing_repeats_nulls_and_names(spark):
    rows = [(None, "a b c", None, "own", "own"), (None, "a b c", None, "own", "own"), (1, "a", "x", "own", "own"), (1, "a", "x", "own", "own"), (1, None, "y", "own", "own")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __s string, Size string")
    out = op10_mixing.mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "__s", *op10_mixing.NEW] and out.count() == len(rows)
    assert sorted(map(str, out.collect())) == sorted(map(str, op10_mixing.mix_sources(df.repartition(5)).collect()))
    assert op10_mixing.mixed_rows(df).columns == df.columns


def test_token_counts_against_the_tokenizer(spark):
    texts = ["", None, "one two", "one two", "x " * 500, "Ünï 字"]
    from tokenizers import Tokenizer

    from skyloom.llm.op1_packing import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    lengths = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts)
    got = op3_token_counts.limits(op3_token_counts.histogram(op3_token_counts.token_lengths(spark.createDataFrame([(t,) for t in texts], "text string"))), block=4).collect()
    assert sorted(r["length"] for r in got) == sorted(set(lengths))
    for r in got:
        upto = [x for x in lengths if x <= r["length"]]
        assert r["docs"] == lengths.count(r["length"]) and r["docs_upto"] == len(upto) and r["tokens_upto"] == sum(upto) and r["docs_above"] == len(lengths) - len(upto)
        assert r["quantile"] == len(upto) / len(lengths) and r["kept_tokens"] == sum(min(x, r["length"]) for x in lengths) and r["lost_tokens"] == sum(lengths) - r["kept_tokens"]


def test_inference_agrees_with_the_trained_network(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = op2_language.train(docs)
    kept = docs.filter(op2_language.held_out()).filter("text IS NOT NULL").select("text", "lang").toPandas()
    assert len(kept) > 20
    langs, scores = model(pa.array(kept.text.tolist(), pa.string()))
    for text, lang, score in zip(kept.text, langs, scores, strict=True):
        raw, total = text.encode(), np.zeros(len(model.langs))
        for a in range(0, len(raw), op2_language.SPAN):
            b = np.frombuffer(raw[a : a + op2_language.SPAN], np.uint8)[:, None]
            f, g = model.net._forward(b, "f")[0][1:], model.net._forward(b[::-1], "b")[0][1:][::-1]
            logit = np.einsum("ch,thn->tcn", model.net.p["o"], np.concatenate([f, g], 1)) + model.net.p["c"]
            e = np.exp(logit - logit.max(1, keepdims=True))
            total += (e / e.sum(1, keepdims=True)).sum((0, 2))
        if lang != "und":
            assert model.langs[total.argmax()] == lang and abs(total.max() / total.sum() - score) < 1e-3
    told = kept[kept.lang.notna()]
    assert (np.array(langs)[kept.lang.notna()] == told.lang.to_numpy()).mean() > 0.9


def brute_isotonic(x, y):
    """Least squares under order, by the smallest maximum of means."""
    order = np.argsort(x, kind="stable")
    y = y[order]
    n = len(y)
    return order, np.array([max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_isotonic_and_trees_against_brute_force():
    r = np.random.default_rng(4)
    x, y = r.normal(size=40), (r.random(40) < 0.4).astype(float)
    ends, values = op4_toxicity.isotonic(x, y)
    order, want = brute_isotonic(x, y)
    blocks = [x[order][want == v].mean() for v in dict.fromkeys(want.tolist())]
    assert np.allclose(ends, blocks) and np.allclose(values, list(dict.fromkeys(want.tolist())))
    data = r.normal(size=(200, 3))
    label = (data[:, 1] > 0.3).astype(float)
    trees = op4_toxicity.Trees(rounds=1, depth=1).fit(data, label)
    (tree, leaf) = trees.trees[0]
    f, cut = tree[0][0]
    best = None
    for j in range(3):  # the best single split by the second-order gain
        for t in np.unique(np.quantile(data[:, j], np.linspace(0, 1, 33)[1:-1])):
            left, p = data[:, j] <= t, label.mean()
            g, h = label - p, np.full(200, p * (1 - p))
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
            best = max(best or (-1,), (gain, j, t))
    assert (f, trees.cuts[f][cut]) == best[1:]
    side = data[:, f] > best[2]
    p = label.mean()
    for s in (0, 1):
        g = (label - p)[side == s].sum() / (p * (1 - p) * (side == s).sum() + 1)
        assert np.allclose(leaf[s], 0.15 * g)
    assert np.allclose(trees.raw(data), np.log(p / (1 - p)) + leaf[side.astype(int)])


def test_features_by_hand():
    lexicon = op4_toxicity.learn_lexicon(pa.array(["you vile", "so vile", "vile thing", "good day", "fine day", "nice day"]), np.array([1, 1, 1, 0, 0, 0]))
    f = op4_toxicity.features(pa.array(["you VILE !!!vile!!! x", "", None, "good day"]), lexicon)
    assert f.shape == (4, 16) and f[1:3, :15].sum() == 0 and f[3, 0] == 0
    strong = 2 if lexicon[1].max() > 3 else 0
    assert f[0, 0] == strong / 4 and f[0, 8] == 1 / 4 and f[0, 10] == 1 / 4 and f[0, 15] == np.log1p(4)
    long = pa.array([("vile " * 400_000), "vile"])
    assert op4_toxicity.features(long, lexicon)[0, 8] == 0


def test_toxicity_recall_on_held_out_documents(spark):
    some = DATA.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{some}/documents.parquet"), spark.read.parquet(f"{some}/labels.parquet")
    model = op4_toxicity.train(docs, labels)
    seen = op4_toxicity.score_toxicity(docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(op4_toxicity.held_out()), model).toPandas()
    hit = seen[seen.toxic == 1].predicted
    assert hit.mean() >= 0.9 and seen[seen.predicted == 1].toxic.mean() >= 0.9


def test_conflicting_labels_are_toxic(spark, monkeypatch):
    monkeypatch.setattr(op4_toxicity, "Model", lambda texts, toxic: dict(zip(texts, toxic.tolist(), strict=True)))
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i in range(1, 9) for t in (0, 1)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    assert set(op4_toxicity.train(docs, labels).values()) == {1.0}


def test_row_numbers_and_deleted_tables(spark):
    df = spark.createDataFrame([(i, "x") for i in range(20)], "a long, b string").repartition(3)
    made: list[str] = []
    rows = numbered(df, made)
    one, two = ({(r["__f"], r["__r"]): r["a"] for r in rows.collect()} for _ in range(2))
    assert one == two and len(one) == 20 and len(made) == 1
    other = durable(df, made)
    assert other.count() == 20
    forget(spark, made)
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        other.count()
