"""Feeds, batches, sinks, result rows, reports, texts and scripts on small tables."""

import difflib
import hashlib
import json
import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skyloom import report_catalog
from skyloom.functions import assessments, records, text
from skyloom.functions.urls import normalize_url, reject_reason
from skyloom.operators import reports, results
from skyloom.plans import results as fixture
from skyloom.sinks import writers
from skyloom.sources import batches, feeds

DATA = "/root/testdata/sf0.001"

URLS = {
    "http://a.example/?": ("http://a.example/", None), "http://a.example/x#": ("http://a.example/x", None), "http://münchen.de/": ("http://xn--mnchen-3ya.de/", None), "\thttps://A.example:443 \n": ("https://a.example/", None), "http://a.example:080/": ("http://a.example/", None),
    "http://a.example:0/": ("http://a.example/", None), "http://a.example:/": ("http://a.example/", None), "http://a.example:8080/x?b=1&a=2#f": ("http://a.example:8080/x?b=1&a=2#f", None), "http://[::1]:80/": ("http://[::1]/", None), "": (None, "invalid_url_characters"), " ": (None, "invalid_url_characters"),
    "http://a b/": (None, "invalid_url_characters"), "http://a\\b/": (None, "invalid_url_characters"), "ftp://a.example/": (None, "http_url_required"), "http:///x": (None, "http_url_required"), "a.example": (None, "http_url_required"), "http://u@a.example/": (None, "userinfo_not_allowed"),
    "http://a.example:99999/": (None, "invalid_port"), "http://a.example:x/": (None, "invalid_port"), "http://a..example/": (None, "invalid_host"),
}


def test_normalize_url(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = {r["u"]: (r["n"], r["r"]) for r in df.select("u", normalize_url(F.col("u"), international=True).alias("n"), reject_reason(F.col("u")).alias("r")).collect()}
    assert got == URLS


def test_feed(spark, tmp_path):
    f = tmp_path / "feed.txt"
    f.write_bytes("﻿# note\nhttp://a.example/x\nftp://b.example\n\nHTTP://A.example:80/x\x0bhttps://u@c.example/\r\nhttps://d.example\nhttp://münchen.de/\nhttp://ü..de/".encode())
    lines = feeds.classify(feeds.read_lines(spark, str(f)))
    assert {r["line"]: r["reason"] for r in lines.collect()} == {2: None, 3: "http_url_required", 5: "duplicate_normalized_url", 6: "userinfo_not_allowed", 7: None, 8: None, 9: "invalid_host"}
    assert lines.filter("line = 8").first()["normalized_url"] == "http://xn--mnchen-3ya.de/"
    assert [r["url"] for r in feeds.accepted(lines, limit=1, source="s").collect()] == ["http://a.example/x"] and feeds.rejected(lines).count() == 4
    with pytest.raises(ValueError):
        feeds.accepted(lines, limit=0)
    with pytest.raises(Exception, match="invalid_limit_or_feed_size"):
        feeds.read_lines(spark, str(f), most=10).collect()


def test_batch_integrity(spark, tmp_path):
    records_ = [{"url": "http://a.example/", "line": 1, "label": "phishing"}]
    (tmp_path / "records.json").write_text("\n".join(map(json.dumps, records_)))
    (tmp_path / "urls.txt").write_text("http://a.example/\n")
    hashes = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("records.json", "urls.txt")}
    (tmp_path / "manifest.json").write_text(json.dumps({"files_sha256": hashes}))
    assert batches.load_batch(spark, str(tmp_path)).first()["url"] == "http://a.example/"
    (tmp_path / "urls.txt").write_text("http://b.example/\n")
    with pytest.raises(ValueError, match="snapshot_integrity_failed:urls.txt"):
        batches.load_batch(spark, str(tmp_path))


def test_url_sources(spark):
    listed = spark.createDataFrame([(1, "# x"), (2, " http://a/ "), (3, "http://b/")], "line int, raw_url string")
    batch = spark.createDataFrame([(5, "http://c/")], "line long, url string")
    resolve = lambda **k: [r["url"] for r in batches.resolve_urls(spark, **k).orderBy("line").collect()]
    assert resolve(listed=listed) == ["http://a/", "http://b/"] and resolve(listed=listed, limit=1) == ["http://a/"] and resolve(listed=listed, batch=batch) == ["http://c/"] and resolve(url="http://d/", batch=batch) == ["http://d/"]
    assert batches.same_urls(batch, batch) and not batches.same_urls(batch, batch.withColumn("url", F.lit("x")))
    with pytest.raises(ValueError):
        batches.resolve_urls(spark)
    with_source = {r["url"]: r for r in batches.with_source(batches.resolve_urls(spark, listed=listed), spark.createDataFrame([("http://a/", "l", "sl", "s", "b", "f")], "url string, label string, source_label string, source string, batch_id string, fetched_at string")).collect()}
    assert with_source["http://a/"]["source_label"] == "sl" and with_source["http://b/"]["source_label"] == "unlabeled"


def test_labels_of_rows(spark):
    own = spark.createDataFrame([("a", "phishing"), ("b", None)], "url string, label string")
    other = spark.createDataFrame([("a", "benign"), ("b", "benign")], "url string, label string")
    assert {r["url"]: r["label"] for r in batches.with_labels(own, other).collect()} == {"a": "phishing", "b": None}
    assert {r["url"]: r["label"] for r in batches.with_labels(own.select("url"), other).collect()} == {"a": "benign", "b": "benign"}
    assert {r["label"] for r in batches.with_labels(own.select("url")).collect()} == {None}


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y', None)], "a int, b string, extra string")
    writers.write_csv(df, str(tmp_path / "t"), ("b", "a", "missing"))
    got = batches.read_table(spark, str(tmp_path / "t"))
    assert got.columns == ["b", "a", "missing"] and tuple(got.first())[:2] == ('say "x", y', "1")
    with pytest.raises(AnalysisException):
        writers.write_csv(df, str(tmp_path / "t"), ("a",))
    for _ in range(2):
        writers.append_csv(df, str(tmp_path / "more"), ("a",))
    assert batches.read_table(spark, str(tmp_path / "more")).count() == 2
    (tmp_path / "bom.csv").write_bytes("﻿a,b\n1,2\n".encode())
    assert batches.read_table(spark, str(tmp_path / "bom.csv")).first()["a"] == "1"


def test_audit_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("k", None, [2, 1])], "id string, b string, a array<int>")
    where = writers.write_audit(df, str(tmp_path / "audit"), "id").first()
    written = spark.read.json(str(tmp_path / "audit")).first()
    assert written["audit"] == '{"a":[2,1],"b":null}' and where["sha256"] == hashlib.sha256(written["audit"].encode()).hexdigest()
    urls = spark.createDataFrame([(2, "http://b/"), (1, "http://a/")], "line int, url string")
    m = writers.write_manifest(urls, str(tmp_path / "run"), {"b": 1, "a": "ü"}, run_id="r")
    assert m["url_list_sha256"] == hashlib.sha256(b"http://a/\nhttp://b/").hexdigest() and m["run_config_sha256"] == hashlib.sha256(json.dumps({"b": 1, "a": "ü"}, sort_keys=True).encode()).hexdigest() and m["n_urls"] == 2
    writers.write_artifacts(df.withColumnRenamed("id", "record_id"), str(tmp_path / "art"))
    with pytest.raises(AnalysisException):
        writers.write_artifacts(df.withColumnRenamed("id", "record_id"), str(tmp_path / "art"))


def test_long_lists_and_shards(spark, tmp_path):
    lines = [(i, f"http://h/{i}") for i in range(1, 26)]
    urls = spark.createDataFrame(lines, "line int, url string").repartition(4)
    whole = lambda rows: hashlib.sha256("\n".join(u for _, u in rows).encode()).hexdigest()
    assert writers.list_hash(urls) == (whole(lines), 25) and writers.list_hash(urls, 25) == (whole(lines), 25)
    assert writers.list_hash(urls, 10) == (hashlib.sha256("\n".join(whole(lines[a : a + 10]) for a in (0, 10, 20)).encode()).hexdigest(), 25)
    assert writers.list_hash(urls.limit(0))[1] == 0
    writers.write_artifacts(spark.createDataFrame([(str(i), f"body {i}") for i in range(2000)], "record_id string, body string"), str(tmp_path / "art"))
    assert len([x for x in (tmp_path / "art").iterdir() if x.is_dir()]) <= 256
    one = writers.read_artifact(spark, str(tmp_path / "art"), "77")
    assert [tuple(r) for r in one.collect()] == [("77", "body 77")] and "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().executedPlan().toString()


def test_pairs_hold_no_verdict(spark, tmp_path):
    judged = report_catalog._judged(spark, DATA).filter("page_id < 3")
    pairs = results.blind_pairs(judged).withColumns({"bot_html": F.lit("<p>a</p>"), "human_html": F.lit("<p>b</p>"), "verdict": F.lit("phishing")})
    writers.write_pairs(pairs, str(tmp_path / "pairs"))
    got = spark.read.json(str(tmp_path / "pairs"))
    assert set(got.columns) == {*results.BLIND, "bot_html", "human_html", "url_hash", "shard"} and got.count() == 3
    sheets = writers.annotation_sheets(pairs.withColumn("place", F.lit(1)), "bot_html", "human_html").first()
    assert "phishing" not in sheets["sheet"] and "&lt;p&gt;a" in sheets["sheet"] and sheets["sheet"].count("<iframe sandbox") == 2
    meta = tmp_path / "old" / "x"
    meta.mkdir(parents=True)
    (meta / "meta.json").write_text('{"url": "http://a/"}')
    (tmp_path / "old" / "y").mkdir()
    (tmp_path / "old" / "y" / "meta.json").write_text("{broken")
    assert [r["url"] for r in batches.read_pairs(spark, str(tmp_path / "old")).collect()] == ["http://a/"]


def test_result_rows_have_one_shape(spark, tmp_path):
    good = results.result_rows(report_catalog._judged(spark, DATA).filter("page_id < 4"))
    urls = spark.createDataFrame([("http://a b/",), ("http://ok/",)], "url string")
    bad = results.failure_rows(urls, "error")
    assert good.columns == bad.columns == list(results.BATCH) and results.summary(good).columns[:4] == list(results.LEGACY)
    assert {f.dataType.simpleString() for f in good.schema.fields} == {"string"} and {r["cloaking"] for r in bad.collect()} == {"N/A"}
    kept, failed = results.split_by_liveness(urls, reject_reason(F.col("url")))
    assert [r["url"] for r in kept.collect()] == ["http://ok/"] and [(r["url"], r["alive"], r["phishing_verdict"]) for r in failed.collect()] == [("http://a b/", "False", "unknown")]
    both = good.unionByName(failed)
    assert both.select(results.report_text().alias("t")).filter(F.size(F.split("t", "\n")) == 10).count() == 5
    writers.write_reports(both, str(tmp_path / "reports"))
    written = spark.read.json(str(tmp_path / "reports"))
    assert written.count() == both.count() and written.select("name").distinct().filter("length(name) <= 60").count() >= 4
    assert all(len(r["report"].split("\n")) == 10 and r["shard"] == hashlib.sha256(r["name"].encode()).hexdigest()[:2] for r in written.withColumn("shard", F.col("shard").cast("string")).collect() if not r["shard"].isdigit())
    writers.write_projections(spark.createDataFrame([(2, "http://b/", "x"), (1, "http://a/", "y")], "line int, url string, label string"), str(tmp_path))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "urls.txt")).collect()) == ["http://a/", "http://b/"]


def test_mixed_versions_are_refused(spark):
    r = fixture.results(spark, DATA)
    assert reports.check_versions(r) is r
    for other in ("m2", ""):
        with pytest.raises(ValueError):
            reports.check_versions(r.withColumn("measurement_version", F.when(F.col("page_id") == 1, other).otherwise("m1")))


def test_two_groups(spark):
    df = spark.createDataFrame([("m", "benign", 5, 100), ("m", "phishing", 90, 100), ("same", "benign", 5, 10), ("same", "phishing", 5, 10), ("none", "benign", 0, 10), ("none", "phishing", 0, 10), ("empty", "benign", 0, 0), ("empty", "phishing", 1, 2)], "measure string, grp string, k long, n long")
    got = {r["measure"]: r for r in reports.compare(df).collect()}
    se = math.sqrt(0.475 * 0.525 * 2 / 100)
    assert got["m"]["p"] == pytest.approx(math.erfc(abs(0.85 / se) / math.sqrt(2))) and got["m"]["p"] < 1e-6 and got["m"]["higher"] and got["same"]["p"] > 0.99 and got["none"]["p"] == 1 and "empty" not in got
    lo, hi = got["m"]["lo_a"], got["m"]["hi_a"]
    assert lo < 0.05 < hi


def test_sample_is_the_same_for_a_seed(spark):
    r = fixture.results(spark, DATA)
    one, two, other = (reports.stratified_sample(r, 6, 4, s).collect() for s in ("a", "a", "b"))
    assert one == two != other and len(one) == 10 and sum(x["cloaking"] == "True" for x in one) == 6
    pairs = r.filter("page_id < 10").select("url")
    assert reports.stratified_sample(r, 100, 100, "a", pairs).count() <= 10


def test_similarity_against_python(spark):
    def simhash(t):
        votes = [0] * 64
        for i in range(len(t) - 3):
            h = int(hashlib.md5(t[i : i + 4].encode()).hexdigest(), 16)
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        return sum(1 << b for b in range(64) if votes[b] > 0)

    texts = ["", "abc", "the quick brown fox", "the quick brown cat", "größe 字字字 and more", "a" * 6000]
    pairs = [(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    got = {r["k"]: r["similarity"] for r in text.similarity(spark.createDataFrame(pairs, "k int, a string, b string"), "k", "a", "b").collect()}
    for k, a, b in pairs:
        want = 1.0 if not a and not b else 0.0 if not a or not b else 0.6 * (1 - (simhash(a) ^ simhash(b)).bit_count() / 64) + 0.4 * difflib.SequenceMatcher(None, a[:5000], b[:5000]).ratio()
        assert got[k] == pytest.approx(want), (a[:20], b[:20])
    assert text.similarity(spark.createDataFrame([(1, None, None)], "k int, a string, b string"), "k", "a", "b").first()["similarity"] == 1.0


def test_matching_blocks_are_those_of_difflib(spark):
    import difflib
    import random

    from skyloom import report_catalog

    r, letters = random.Random(7), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789é\U0001f600"
    for _ in range(600):
        known = letters[: r.choice((1, 3, 12, 64))]
        a = "".join(r.choices(known, k=r.choice((0, 1, 30, 199, 200, 201, 700))))
        b = "".join(r.choice(known) if r.random() < 0.1 else c for c in a)[r.randint(0, 9) :] if r.random() < 0.5 else "".join(r.choices(known, k=r.choice((0, 1, 30, 199, 200, 201, 700))))
        assert text.matched(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)
    pairs = report_catalog.QUERIES["text_similarity"](spark, DATA)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # however few bytes they are


def test_decode_body(spark):
    bodies = [
        (b"\xef\xbb\xbf\xc3\xa4", None, "ä", "utf-8:bom"), ("﻿ä".encode("utf-16-le"), None, "ä", "utf-16:bom"), (b"\xe4", "text/html; charset=ISO-8859-1", "ä", "iso-8859-1:header"), (b'<meta charset="windows-1252">\x80', "", '<meta charset="windows-1252">€', "windows-1252:meta"),
        (b"\xc3\xa4\xff", "text/html; charset=nonsense", "ä�", "utf-8:default"), (None, None, "", "utf-8:default"),
    ]
    df = spark.createDataFrame([(i, b, c) for i, (b, c, _, _) in enumerate(bodies)], "i int, body binary, kind string")
    got = {r["i"]: (r["d"]["text"], r["d"]["charset"]) for r in df.select("i", records.decode_body("body", "kind").alias("d")).collect()}
    assert got == {i: (t, c) for i, (_, _, t, c) in enumerate(bodies)}


def test_scripts_and_links(spark):
    html = "<script src='/a.js'></script><script src=\"//cdn.example/b.js\"></script><script src='c.js'></script><script>x()</script><script></script><noscript>enable it</noscript><title> T\n</title><p>Hi <b>you</b></p>"
    row = spark.createDataFrame([(html, "https://s.example/d/p?q=1")], "h string, u string").select(records.external_scripts(F.col("h"), F.col("u")), records.inline_scripts(F.col("h")), records.title(F.col("h")), records.visible_text(F.col("h"))).first()
    assert list(row) == [["https://s.example/a.js", "https://cdn.example/b.js", "https://s.example/d/c.js"], ["x()"], "T", "T Hi you"]


def test_model_answers(spark):
    good = '{"assessment":"phishing","key_indicators":["x"],"explanation":"y"}'
    bad = ['{"assessment":"maybe","key_indicators":[],"explanation":""}', '{"assessment":"phishing","key_indicators":"x","explanation":""}', '{"assessment":"phishing","key_indicators":[],"explanation":NaN}', good[:-1] + ',"extra":1}', good[:-1] + ',"assessment":"phishing"}', "```" + good + "```", '{"assessment":"phishing"}', "", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate([good, *bad])], "i int, a string")
    got = {r["i"]: r["v"] for r in df.select("i", assessments.validated("phishing")("a").alias("v")).collect()}
    assert tuple(got[0]) == ("valid", None, "phishing") and {got[i]["status"] for i in range(1, len(bad) + 1)} == {"invalid_or_unavailable"}
    said = spark.createDataFrame([(None, None), ("valid", "x"), ("invalid_or_unavailable", None)], "s string, v string").select(records.assessment(F.col("s"), F.col("v")).alias("a"))
    assert [r["a"] for r in said.collect()] == ["not_run", "x", "unavailable"]


def test_audit_script_view(spark):
    view = results.script_view(spark.createDataFrame([("abc", "x" * 30_000)], "script string, deobfuscated string")).first()
    assert view["script_sha256"] == hashlib.sha256(b"abc").hexdigest() and view["deobfuscated_length"] == 30_000 and len(view["deobfuscated_excerpt"]) == 20_000
