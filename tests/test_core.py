import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from skyloom import catalog, detail_catalog, report_catalog
from skyloom.functions import catalogue as C
from skyloom.functions.pages import evaluate, signatures
from skyloom.plans import observations as O

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES | report_catalog.QUERIES | detail_catalog.QUERIES, catalog.SQL | report_catalog.SQL | detail_catalog.SQL


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.fixture(scope="module")
def scripted(spark, tmp_path_factory):
    """Pages of many own scripts and of a long one, and the same tables for their SQL."""
    many, long = "".join(f"<script>f({i})</script><script src='/x.js'>no</script><script></script>" for i in range(30)), f"<script>{'é' * 60_000}g()</script>"
    pages = [(i, f"https://h{i}.example/", (many, long * 2, many + long, "<p>plain</p>", None)[i // O.SCENARIOS]) for i in range(5 * O.SCENARIOS)]
    path = str(tmp_path_factory.mktemp("scripted"))
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/pages.parquet/*.parquet'")
    return path, con


def test_signals_carry_one_hash_of_own_scripts(spark):
    from skyloom.functions import records as R
    from skyloom.operators import pairs as P

    facts = P.seen(O.everything(spark, DATA), wanted=P.SIGNAL_FACTS).schema["html"].dataType
    assert "inline" not in facts.names and facts["inline_set"].dataType.simpleString() == "string"  # however many scripts a page has
    cases = [["a", "b"], ["b", "a", "b"], ["ab"], ["a,b"], ["a"], [], [""]]
    out = spark.createDataFrame(list(enumerate(cases)), "i int, s array<string>").select("i", R.script_set(F.col("s")).alias("h")).collect()
    told = {r.i: r.h for r in out}
    assert told[0] == told[1] and len(set(told.values())) == len(cases) - 1


def apart(name, row):
    """Whether a row says that the scripts of its page differ by client."""
    return row["id"] == "script_inventory_difference" and row["status"] == "observed" if "id" in row else "script_inventory_difference" in row["observed"].split("|")


@pytest.mark.parametrize("name", ["signal_details", "signal_table", "signals_summary"])
def test_all_own_scripts_count_as_in_sql(spark, scripted, name):
    path, con = scripted
    got = QUERIES[name](spark, path).toPandas()
    assert rows(got) == rows(con.execute(SQL[name]).df())
    told = {r["page_id"] for r in got.to_dict("records") if apart(name, r)}
    assert {1, 1 + 2 * O.SCENARIOS, 1 + 3 * O.SCENARIOS} <= told and not {11, 11 + O.SCENARIOS} & told  # the human's own script comes after 30 others
    bodies = ["é" * 60_000 + "g()", *(f"f({i})" for i in range(40))]
    html = "".join(f"<script>{s}</script>" for s in bodies)
    assert list(con.execute(f"SELECT {catalog._ALL_INLINE} FROM (SELECT ? AS html)", [html]).fetchone()[0]) == bodies
    assert catalog._INLINE not in SQL[name] and catalog._ALL_INLINE in SQL[name]


def test_page_archetypes(spark):
    pages = [("clean", "<h1>Back soon</h1>"), ("evil", O.EVIL), ("login", O.LOGIN), ("null", None), ("ip", '<form action="http://10.0.0.1/x"><input type="password"></form>')]
    got = {r["k"]: r for r in evaluate(spark.createDataFrame([(k, h, "https://shop.example.com/") for k, h in pages], "k string, html string, url string")).collect()}
    assert got["clean"]["mechanisms"] == [] and not got["null"]["is_phishing"]
    assert got["evil"]["decisive"] == ["D1", "D3"] and "devtools_blocking" in got["evil"]["mechanisms"]
    assert not got["login"]["is_phishing"] and got["login"]["mechanisms"] == ["cred_form", "credential_harvesting"]
    assert got["ip"]["decisive"] == ["D2"]


#: Text that each pattern's intent describes, and text next to it that is no hit: category, text, number of hits.
HITS = [
    ("timed_cloaking_redirect", "setInterval(function(){ location = 'x' }, 500)", 1), ("timed_cloaking_redirect", "setInterval(function(){ location.reload() }, 500)", 0), ("timed_cloaking_redirect", "setInterval(() => location.replace('http://a'), 90)", 1),
    ("timed_cloaking_redirect", "setInterval(t => {location='x'}, 5)", 1), ("timed_cloaking_redirect", "SETTIMEOUT(() => location='a', 10)", 1), ("timed_cloaking_redirect", "setTimeout(function(){ location='a' }, 5000)", 0),
    ("timed_cloaking_redirect", "setTimeout(function(){ document.title = 'a' }, 500)", 0), ("timed_cloaking_redirect", "setTimeout(go, 900, 'https://a.example/', 900)", 1), ("timed_cloaking_redirect", "delayed by a redirect", 1), ("timed_cloaking_redirect", "presettimeout(() => location='a', 10)", 0),
    ("timed_cloaking_redirect", "setInterval(function(){ location='x' }, 60000)", 0), ("ua_bot_detection", "navigator.plugins.length === 0", 1), ("ua_bot_detection", "plugins.length === 05", 0), ("ua_bot_detection", "window._phantom || callPhantom", 2), ("ua_bot_detection", "navigator.webdriver && go()", 1), ("ua_bot_detection", "the webdriver manual", 0),
    ("post_submit_deception", "alert('Wrong password')", 1), ("post_submit_deception", "password is incorrect, please try again", 1), ("post_submit_deception", "alert('saved')", 0), ("post_submit_deception", "location.href='https://paypal.example.org'", 1), ("post_submit_deception", "location.href='https://mypaypal.org'", 0),
    ("code_obfuscation_exec", "eval(function(p,a,c,k,e,d){", 1), ("code_obfuscation_exec", "eval(atob('eA=='))", 1), ("code_obfuscation_exec", "String.fromCharCode(" + "1," * 15, 1), ("code_obfuscation_exec", "String.fromCharCode(" + "1," * 14 + "1)", 0), ("code_obfuscation_exec", "\\x41" * 25, 1),
    ("webhook_exfiltration", "https://api.telegram.org/bot123456:" + "a" * 30 + "/sendMessage?chat_id=1", 3), ("mail_exfiltration", "'a@gmail.com'", 1), ("mail_exfiltration", "a@gmail.com", 0), ("devtools_blocking", "shiftKey && e.keyCode === 74", 1), ("devtools_blocking", "'contextmenu', e => e.preventDefault()", 1),
    ("post_submit_deception", "location.href='https://www.paypal.com'", 1), ("ua_bot_detection", "if (navigator.webdriver) { location", 1), ("form_credential_targeting", "[type=password]", 1), ("data_exfiltration", "navigator.sendBeacon('/x')", 2), ("malicious_redirect", "window.location = 'https://a'", 1),
    ("anti_analysis", "debugger;", 1), ("brand_impersonation", "secure customer login", 1),
]


def test_patterns_hit_what_they_are_for(spark):
    got = {r["k"]: r["hits"] for r in evaluate(spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(HITS)], "k int, html string").selectExpr("*", "'https://a.example/' AS url")).collect()}
    for k, (category, text, n) in enumerate(HITS):
        assert got[k][category] == n, (category, text)
        for name, (_, _, patterns) in C.CATEGORIES.items():
            assert got[k][name] == sum(bool(re.search(p, text, re.I)) for p in patterns), (text, name)


def test_no_page_exhausts_the_matcher(spark):
    n = 50_000
    loops = [
        "String.fromCharCode(" + "123, " * n, "\\x41" * n, "unescape('" + "%41" * n, "<form " * n, "<form>" + "<input type=password " * n + "</form>", "<script " * n, "<script>" * n, "<" * n, "on" * n, "onclick='" * n, "location" * n, "setInterval(function" + "{" * n, "setTimeout(" + "http://" * n,
        "navigator.webdriver" * n, "'" + "a" * n + "@gmail", "if(" * n, "<meta " * n, "shiftKey " * n, "delay" * n, "fetch(" * n, "a" * 20 * n, "&" * n, "<title>" * 5000, "<!--" * 5000, "<iframe src=" * 5000, " " * n + "x", "password" * n, "canvas " * n,
    ]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(loops)], "k int, html string").selectExpr("*", "'https://a.example/' AS url").repartition(4)
    from skyloom.functions.pages import facts

    assert facts(signatures(evaluate(pages)).select("k", "html", "url")).filter("facts.length > 0").count() == len(loops)


def test_literals_are_found_in_one_pass(spark):
    from skyloom.functions.pages import facts
    from skyloom.functions.records import gates

    assert C.needles(r"\b(?:crawler|spider)/i") == ("crawler", "spider") and C.needles("abcd|x") == () and C.needles("(?:abcd|efgh)?x") == ()
    assert set(C.needles(r"<title>just a moment|(?:one|two (?:three|four))")) == {"<title>just a moment", "one", "two "}
    assert all(C.needles(p) for _, _, p in C.GATES)
    texts = [t for _, t, _ in HITS] + [t.upper() for _, t, _ in HITS] + ["<FORM action='https://a.example/x'><INPUT type=Password><SCRIPT src='https://b.example/c.js'></SCRIPT>", "\u212a\u0130 PASSWORD", ""]
    pages = spark.createDataFrame([(i, t, "https://a.example/") for i, t in enumerate(texts)], "k int, html string, url string")
    got = {r["k"]: r for r in facts(pages).select("k", "facts.*").collect()}
    for i, t in enumerate(texts):
        assert got[i]["hits"].asDict() == {n: sum(bool(re.search(p, t, re.I | re.A)) for p in patterns) for n, (_, _, patterns) in C.CATEGORIES.items()}, t
        assert got[i]["techniques"] == sorted(n for n, patterns in C.SIGNATURES.items() if any(re.search(p, t, re.I | re.A) for p in patterns)), t
    last = got[len(texts) - 3]
    assert last["forms"] == 1 and last["form_hosts"] == ["a.example"] and last["script_hosts"] == ["b.example"] and last["input_types"] == ["password"] and last["external"] == ["https://b.example/c.js"]
    assert [r["g"] for r in pages.select("k", gates(F.col("html")).alias("g")).orderBy("k").collect()] == [got[i]["gates"] for i in range(len(texts))]
    plan = facts(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "find(" in plan and plan.count("ArrowEvalPython") == 1


def test_rules_of_every_observation(spark):
    got = QUERIES["observation_rules"](spark, DATA)
    pages = spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert {(r["slot"], r["replicate"]): r["count"] for r in got.groupBy("slot", "replicate").count().collect()} == {(s, i): pages for s in ("bot", "human") for i in (1, 2)}
    only_bot = got.filter(f"page_id % {O.SCENARIOS} = 7 AND is_phishing").select("slot", "replicate").distinct().collect()  # harmful to the first bot visit only
    assert [tuple(r) for r in only_bot] == [("bot", 1)]


def test_signature_rules(spark):
    texts = {"artifact and redirect": ("if(navigator.webdriver){window.location='https://a'}", ["S1"]), "artifact only": ("navigator.webdriver", []), "redirect only": ("window.location='https://a'", []), "fingerprint and redirect": ("canvas; if (a) b; location.href='http://x'", ["S2"]), "null": (None, [])}
    got = {r["k"]: r["static_rules"] for r in signatures(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "k string, html string")).collect()}
    assert got == {k: want for k, (_, want) in texts.items()}


def test_no_page_text_crosses_the_pairing(spark):
    plan = QUERIES["cloaking_label"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate [page_id" in line]
    assert aggregates and not any(re.search(r"\b(?:dom_|early_)?html#\d+", line.split("AS", 1)[0]) for line in aggregates)


def test_blind_pairs_read_no_page(spark):
    from skyloom import report_catalog

    plan = report_catalog.QUERIES["blind_pair"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: (\S+)", plan)
    assert read and not any("html" in r for r in read)


def test_queries_work_out_only_the_facts_they_read(spark):
    from skyloom import report_catalog
    from skyloom.operators import pairs as P

    every = QUERIES | report_catalog.QUERIES
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = lambda name: every[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    plans = {n: plan(n) for n in ("cloaking_label", "signal_table", "phishing_verdict")}  # the others read the same two steps
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    for name in set(plans) - {"phishing_verdict"}:  # no score: no entropy of the address, no excerpt
        assert "LOG2(" not in plans[name] and " AS excerpt" not in plans[name] and "struct(length" in plans[name], name
    for name in ("cloaking_label", "phishing_verdict"):  # no script inventory
        assert "inline" not in plans[name] and "struct(length" in plans[name], name
    assert "LOG2(" in plans["phishing_verdict"] and "form_hosts" not in plans["phishing_verdict"]
    assert set(P.VERDICT_FACTS) == {"length", "text_length", "gates", "score", "decisive", "obfuscated"}


def test_literals_are_found_as_by_a_plain_search(spark):
    from skyloom.functions import pages as G
    from skyloom.functions import records as R

    wanted = [*G._patterns(), *G._SIGNS, *R.GATE_PATTERNS]
    names = list(dict.fromkeys((*G.MARKS, *R.GATE_WORDS, *(n for p in wanted for n in C.needles(p)))))
    assert any(len(n) == 2 for n in names)
    texts = [None, "", "a", "ss", "SSN", "\u212aelvin " + "İ" * 9, *[f"x{n.upper()}y" for n in names], *[n[:-1] + "!" + n[-1:] for n in names], *["".join(n[1:] + n[:1] for n in names[i::9]) for i in range(9)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", G.held(F.col("t"), wanted, R.GATE_WORDS).alias("h")).collect()
    for r in rows:
        low = (texts[r.i] or "").encode().lower()
        assert r.h == [n for n in names if n.encode() in low], texts[r.i]


def test_label_queries_read_pages_once_and_take_no_whole_text(spark):
    from skyloom.operators import pairs as P

    plan = QUERIES["cloaking_label"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("html" in r for r in re.findall(r"ReadSchema: (\S+)", plan)) == 2  # distinct pages, and the keys of what was seen
    facts = P.seen(O.everything(spark, DATA), wanted=P.brief(P.LABEL_FACTS)).schema["html"].dataType.names
    assert "visible" in facts and "text_length" not in facts
    assert C.needles("[0-9]{6}:[a-z0-9_-]{30}") == tuple(f"{d}:" for d in range(10)) and C.needles(r"(?:\\x[0-9a-f]{2}){25}") == ("\\x",)
    assert C.needles("[0-9]{0,6}:[a-z]") == () and C.needles("[0-9]+:?x") == () and C.needles("(?:abcd){0,9}x") == ()


def test_whether_there_is_visible_text(spark):
    from skyloom.functions import records as R

    parts = ["", " ", "<", ">", "<b>", "<script>x</script>", "<script>", "</script >", "<!--", "-->", "<style a>y</STYLE>", "<div ", "\u00a0", "\n", "x"]
    texts = [None, *(a + b + c + d for a in parts for b in parts for c in parts for d in ("", ">", " <i>", "x")), "<b>" * 50_000, "<" * 50_000, "<!-- -->" * 50_000, "<a <!-- > -->" * 20_000 + ">"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", (F.length(R.visible_text(F.col("t"))) > 0).alias("whole"), R.has_text(F.col("t")).alias("quick"))
    assert [texts[r.i][:99] for r in rows.filter("whole != quick").collect()] == []
    assert rows.filter("quick").count() > 99 and rows.filter("NOT quick").count() > 99


def test_equal_views_are_one_page(spark):
    from skyloom.operators import pairs as P

    some, urls = (None, "", "a", "b"), (None, "", "u", "v")
    rows_ = [(h, d, e, u, p) for h in some for d in some for e in some for u in urls for p in urls]
    obs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "i int, html string, dom_html string, early_html string, url string, page_url string")
    one = P.page_rows(obs).select("o.i", F.explode("views").alias("view"), "body", "address")
    assert rows(one.toPandas()) == rows(P.view_rows(obs).select("o.i", "view", "body", "address").toPandas())
    assert P.page_rows(obs).groupBy("o.i", "body", "address").count().filter("count > 1").isEmpty()


def test_white_space_of_visible_text(spark):
    from skyloom.functions import records as R

    texts = ["a b", " a  b ", "a\tb", "a\t b", "a \nb", "\n", "<b> \t</b>\u00a0x\u000b\f\ry", "a<br>b <i>c</i>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.visible_text(F.col("t")).alias("v")).collect()
    for r in rows:
        assert r.v == re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("<[^>]*>", " ", texts[r.i])).strip(" "), texts[r.i]


def test_equal_pages_are_combined_before_their_shuffle(spark):
    from skyloom.functions.pages import facts_once

    pages = spark.createDataFrame([(i, f"<p>{i % 3}</p>", "https://a.example/") for i in range(300)], "k long, html string, url string").repartition(2)
    out = facts_once(pages)
    assert out.select("facts.html_sha256").distinct().count() == 3 and out.count() == 300
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(__key" in line and "html" in line)
    assert "HashAggregate(keys=[__key" in lines[at + 1]


def test_stream_keeps_first_sightings(spark, tmp_path):
    from skyloom.streaming.observations import first_seen

    rows_ = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:02:00")], "url string, at string").selectExpr("url", "to_timestamp(at) AS ts")
    rows_.write.parquet(str(tmp_path / "in"))
    query = first_seen(spark, str(tmp_path / "in"), rows_.schema).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("seen").groupBy("url").count().filter("count > 1").isEmpty() and spark.table("seen").count() == 2


def test_duplicate_observations_count_once(spark):
    from skyloom.operators.pairs import pair_table, seen

    some = [("p", "bot", 1, 3, "late", 500), ("p", "bot", 1, 1, "early", 200)]
    obs = spark.createDataFrame(some, "page_id string, slot string, replicate int, access_index int, html string, status int")
    filler = {"error": "string", "url": "string", "redirect_chain": "array<string>", "page_url": "string", "kind": "string", "observed_at": "timestamp", "client_navigations": "int", "blocked": "int", "failed": "int", "dialogs": "int", "downloads": "int", "popups": "int", "dom_html": "string", "early_html": "string", "truncated": "boolean", "dom_truncated": "boolean", "non_html": "boolean", "body_error": "string"}
    obs = obs.withColumns({k: F.lit(None).cast(t) for k, t in filler.items()})
    got = pair_table(seen(obs)).select("bot1_status", "bot1_html_length", "human1_issues").first()
    assert tuple(got) == (200, 5, ["missing_observation"])


#: What each gate is for and what it is not, with its scope: markup, text, or a script.
GATE_CASES = [
    ("<div class='h-captcha'></div>", ["captcha"]), ("<p>our captcha policy</p>", []), ("<title>Just a moment...</title>", ["challenge"]), ("<p>Just a moment</p>", []), ("<p>Verify that you are a human</p>", ["challenge"]), ("<p>verifying you are human now</p>", ["challenge"]),
    ("<p>humans verify that you are here</p>", []), ("<p>Access denied</p>", ["challenge"]), ("<script>// access denied</script>", []), ("<script>Notification . requestPermission()</script>", ["notification"]), ("<p>notification.requestPermission</p>", []),
    ("<script>prompt ('x')</script>", ["alert_gate"]), ("<p>prompt (x)</p>", []), ("<script>myprompt('x')</script>", []), ("<a onclick=\"x.style.display='block'\">a</a>", ["click_gate"]), ("<script>x.style.display='block'</script>", []), ("<p>Click here to continue</p>", ["click_gate"]), ("<p>click. Then go to continue</p>", []),
    ("<button onclick='x.removeAttribute(\"hidden\")'>a</button>", ["click_gate"]),
]


def test_gates_by_meaning(spark):
    from skyloom.functions import records

    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(GATE_CASES)], "i int, html string")
    for r in rows.select("i", records.gates(F.col("html")).alias("g")).collect():
        assert r["g"] == GATE_CASES[r["i"]][1], GATE_CASES[r["i"]]
    titles = {"404": True, "Error": True, "Room 4040": False, "Not found here": True, "Welcome": False, "1500 shoes": False}
    for title, odd in titles.items():
        assert bool(re.search(C.ERROR_TITLE, title, re.I)) == odd, title
