"""Rule tables as rows, facts kept between runs, long URL lists, rollups, first records."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from skyloom.functions import catalogue as C
from skyloom.functions import memory
from skyloom.functions import rules as U
from skyloom.functions.pages import evaluate
from skyloom.operators import reports as R
from skyloom.sources import batches, lists

PAGES = [(1, "https://a.example/", "<p>plain</p>"), (2, "https://a.example/", "<p>Unusual Phrase 77 and password</p>"), (3, "https://a.example/", None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def table(spark):
    return U.rule_table(spark).cache()


def test_round_trip(table):
    got = U.read_rules(table.orderBy(F.rand(3)))
    assert (got.categories, got.combos, got.decisive) == (U.BUILT_IN.categories, U.BUILT_IN.combos, U.BUILT_IN.decisive) and got.digest == U.BUILT_IN.digest


def test_a_changed_table_changes_results(spark, pages, table):
    more = spark.createDataFrame([("pattern", "own.0", 99_000, "own", 0.9, None, "html", "unusual phrase [0-9]{2}"), ("decisive", "D9", 99_000, "own", None, None, None, None)], U.TABLE)
    rules = U.read_rules(table.unionByName(more))
    before = {r.page_id: r for r in evaluate(pages).collect()}
    after = {r.page_id: r for r in evaluate(pages, rules=rules).collect()}
    assert not before[2].is_phishing and after[2].is_phishing and after[2].decisive == ["D9"] and after[2].hits["own"] == 1
    assert after[1].score == before[1].score and not after[3].is_phishing
    light = U.read_rules(table.withColumn("weight", F.when((F.col("name") == "credential_harvesting") & (F.col("kind") == "pattern"), 0.01).otherwise(F.col("weight"))))
    assert {r.page_id: r.score for r in evaluate(pages, rules=light).collect()}[2] < before[2].score and light.digest != U.BUILT_IN.digest


BROKEN = {
    "duplicate_rule_id": lambda t: t.unionByName(t.filter("id = 'webhook_exfiltration.0'")), "unknown_kind": lambda t: t.withColumn("kind", F.when(F.col("id") == "D1", "other").otherwise(F.col("kind"))),
    "unknown_category": lambda t: t.withColumn("name", F.when((F.col("kind") == "combo") & (F.col("name") == "anti_analysis"), "nothing").otherwise(F.col("name"))),
    "unknown_flag": lambda t: t.withColumn("name", F.when(F.col("id") == "D2", F.concat("name", F.lit("x"))).otherwise(F.col("name"))),
    "unknown_scope": lambda t: t.withColumn("scope", F.when(F.col("name") == "anti_analysis", "dom").otherwise(F.col("scope"))), "invalid_weight": lambda t: t.withColumn("weight", F.when((F.col("name") == "anti_analysis") & (F.col("kind") == "pattern"), 2.0).otherwise(F.col("weight"))),
    "conflicting_weight": lambda t: t.withColumn("weight", F.when(F.col("id") == "anti_analysis.0", 0.5).otherwise(F.col("weight"))), "invalid_pattern": lambda t: t.withColumn("pattern", F.when(F.col("id") == "anti_analysis.0", "(").otherwise(F.col("pattern"))),
    "invalid_count": lambda t: t.withColumn("at_least", F.when(F.col("kind") == "combo", 0)), "missing_or_repeated_pattern": lambda t: t.withColumn("pattern", F.when(F.col("name") == "anti_analysis", "x").otherwise(F.col("pattern"))),
}


@pytest.mark.parametrize("fault", sorted(BROKEN))
def test_broken_tables_are_refused_by_name(table, fault):
    with pytest.raises(ValueError, match=fault):
        U.read_rules(BROKEN[fault](table))


def test_size_and_signatures(table):
    with pytest.raises(ValueError, match="too_many_rules:10"):
        U.read_rules(table, most=10)
    U.check_signatures(C.SIGNATURES, C.SIGNATURE_RULES)
    with pytest.raises(ValueError, match="unknown_signature:S1:nothing"):
        U.check_signatures(C.SIGNATURES, {"S1": (("nothing",),)})
    with pytest.raises(ValueError, match="unknown_category:combo1"):
        U.check(dataclasses.replace(U.BUILT_IN, combos=[(0.1, {"nothing": 1})]))


def test_facts_are_kept(spark, pages):
    spark.sql("DROP TABLE IF EXISTS page_facts_test")
    assert memory.learn(pages.unionByName(pages), "page_facts_test", buckets=4) == 3
    # what is kept is not judged again: a planted fact stays
    kept = memory.keyed(pages).filter("page_id = 1").first()["page_key"]
    rows = spark.table("page_facts_test").collect()
    planted = spark.createDataFrame([(r.page_key, r.facts) for r in rows], spark.table("page_facts_test").schema).withColumn("facts", F.when(F.col("page_key") == kept, F.col("facts").withField("title", F.lit("planted"))).otherwise(F.col("facts")))
    planted.write.bucketBy(4, "page_key").sortBy("page_key").mode("overwrite").saveAsTable("page_facts_test_2")
    more = spark.createDataFrame([(4, "https://b.example/", "<title>new</title>")], pages.schema)
    assert memory.learn(pages, "page_facts_test_2", buckets=4) == 0
    assert memory.learn(pages.unionByName(more), "page_facts_test_2", buckets=4) == 1
    got = {r.page_id: r.facts for r in memory.recall(pages.unionByName(more), "page_facts_test_2").collect()}
    assert got[1]["title"] == "planted" and got[4]["title"] == "new" and got[2]["score"] > 0
    plan = memory.recall(pages, "page_facts_test_2")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
    assert memory.keyed(pages, rules=dataclasses.replace(U.BUILT_IN, combos=[])).first()["page_key"] != memory.keyed(pages).first()["page_key"]


TEXT = "﻿https://a.example/1\r\nhttps://a.example/2\n\nhttps://a.example/3\rhttps://ä.example/4 x\x0by\n# comment\r\n" + "".join(f"https://a.example/{'long' * (i % 9)}{i}\n" for i in range(300)) + "last"


@pytest.mark.parametrize("split", ["17", "64", "1000", "128m"])
def test_numbered_lines(spark, tmp_path, split):
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_bytes(TEXT.encode())
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = lists.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = list(enumerate(TEXT.removeprefix("﻿").splitlines(), 1))
    for name in ("one.txt", "two.txt"):
        assert sorted((r.line, r.raw_url) for r in rows if r.file.endswith(name)) == want


def test_rollup_tells_null_groups_from_sums(spark):
    rows = spark.createDataFrame([("a", "x", "true", "true", "phishing"), (None, "x", "true", "unknown", None), (None, None, "false", "false", "unknown")], "source_label string, label string, rule_cloaking_label string, cloaking_label string, phishing_verdict string")
    got = {(r.level, r.cohort, r.label): (r.n, r.rule_true, r.cloaking, r.phishing) for r in R.rollup(rows).collect()}
    assert got == {("label", "a", "x"): (1, 1, 1, 1), ("label", None, "x"): (1, 1, 0, 0), ("label", None, None): (1, 0, 0, 0), ("cohort", "a", None): (1, 1, 1, 1), ("cohort", None, None): (2, 1, 0, 0), ("total", None, None): (3, 2, 1, 1)}


def test_versions(spark):
    kind = "measurement_version string, schema_version string"
    for rows in ([], [("1", None), ("1", "2")], [("1", "2"), ("1", "3")], [("", "2")]):
        with pytest.raises(ValueError, match="versions"):
            R.check_versions(spark.createDataFrame(rows, kind))
    assert R.check_versions(spark.createDataFrame([("1", "2")] * 2, kind)).count() == 2


def test_first_record_wins(spark):
    urls = spark.createDataFrame([(1, "u"), (2, "v")], "line long, url string")
    records = spark.createDataFrame([(9, "u", "late", "s", "f", "b", "t"), (3, "u", "early", "s", "f", "b", "t")], "line long, url string, label string, source_label string, source string, batch_id string, fetched_at string")
    assert {r.url: r.label for r in batches.with_source(urls, records.repartition(2)).collect()} == {"u": "early", "v": ""}
    assert batches.with_labels(urls, records).filter("url = 'u'").first()["label"] == "early"
    hosts = spark.createDataFrame([(i, f"https://h{i % 3}.example/{i}", f"h{i % 3}.example", "active" if i % 3 else "other", "phishing") for i in range(30)], "place long, url_normalized string, host string, reachability_class string, class_label string")
    assert {r.reachability_class: r.hosts for r in batches.bucket_sizes(hosts).collect()} == {"active": 2, "other": 1}
    plan = batches.bucket_sizes(hosts)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan
    assert [r.url for r in batches.candidates(hosts, 2).collect()] == ["https://h1.example/1", "https://h2.example/2"]
