"""Signals in full on hand-made observations: each error kind alone, replicates, missing times, changed clients by rows, plans."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyloom.operators import details as D
from skyloom.operators import pairs as P
from skyloom.plans import observations as O

PAGE = "<title>Shop</title><body>plain words here</body>"
EVIL = PAGE + O.EVIL
SCHEMA = """page_id long, slot string, replicate int, variant string, kind string, access_index int, observed_at timestamp, status int, error string, error_kind string, html string, dom_html string, early_html string, url string, page_url string,
 redirect_chain array<string>, truncated boolean, dom_truncated boolean, non_html boolean, body_error string, blocked int, failed int, blocked_all int, failed_all int, dialogs int, downloads int, popups int, client_navigations int, console_errors int,
 page_errors array<string>, load_event string, user_agent string, referer string, profile string"""
START = datetime(2024, 5, 1)


def row(page, name, **more):
    slot, _, replicate = name.partition("#")
    variant = None if replicate else slot
    slot = {"referer": "bot", "mobile": "human", "tablet": "human"}.get(slot, slot)
    browser = slot == "human"
    index = more.pop("index", int(replicate or 9) * 2 + browser)
    base = {
        "page_id": page, "slot": slot, "replicate": int(replicate or 1), "variant": variant, "kind": "browser" if browser else "http_baseline", "access_index": index, "observed_at": START + timedelta(seconds=10 * index), "status": 200, "error": None, "error_kind": None, "html": PAGE,
        "dom_html": PAGE if browser else None, "early_html": PAGE if browser else None, "url": "https://a.example/", "page_url": "https://a.example/" if browser else None, "redirect_chain": ["https://a.example/"], "truncated": False, "dom_truncated": False, "non_html": False, "body_error": "",
        **dict.fromkeys(("blocked", "failed", "blocked_all", "failed_all", "dialogs", "downloads", "popups", "client_navigations", "console_errors"), 0), "page_errors": [], "load_event": "ok" if browser else "", "user_agent": "x", "referer": "", "profile": name,
    }
    return {**base, **more}


FOUR = ("bot#1", "bot#2", "human#1", "human#2")
ALONE = [
    {"console_errors": 1}, {"page_errors": ["a", "b", "c", "d"]}, {"failed_all": 1}, {"blocked_all": 1}, {"dialogs": 1}, {"downloads": 1}, {"popups": 1}, {"load_event": "timeout"}, {"body_error": "gone"}, {"error": "net::ERR_X"},
]


def page(number, names=FOUR, **by_name):
    return [row(number, n, **by_name.get(n.replace("#", ""), {})) for n in names]


ROWS = [r for i, fault in enumerate(ALONE) for r in page(100 + i, human1=fault)]
ROWS += page(1) + page(2, bot1={"console_errors": 5, "page_errors": ["x"]})  # a plain client has no console
ROWS += page(3, bot1={"error_kind": "dns"})
ROWS += page(4, names=("bot#1", "bot#2", "bot#3", "human#1", "human#2", "human#3"), human3={"html": EVIL}, bot2={"observed_at": None})
ROWS += page(5, human1={"index": 2, "html": EVIL, "status": 201}, bot1={"index": 2})  # equal access indexes: bot#1 is first by name
ROWS += page(6, human1={"html": EVIL}, human2={"html": EVIL})
ROWS += page(7, names=(*FOUR, "mobile", "referer", "tablet"), mobile={"dom_html": EVIL}, referer={"status": 302}, tablet={"html": ""})
ROWS += page(8, names=(*FOUR, "mobile"), mobile={"dom_html": EVIL}, human1={"dom_html": PAGE + "<title>x</title>", "page_url": "https://b.example/"})
ROWS += page(9, names=("bot#1", "human#1"), human1={"html": "", "status": 0, "error": "timeout"})
MANY, LONG = PAGE + "".join(f"<script>f({i})</script>" for i in range(30)), "x" * 60_000
ROWS += page(11, **{n: {"html": MANY + f"<script>{n[:3]}()</script>"} for n in ("bot1", "bot2", "human1", "human2")})  # apart in their 31st script
ROWS += page(12, **{n: {"html": f"{PAGE}<script>{LONG}{n[:3]}()</script>"} for n in ("bot1", "bot2", "human1", "human2")})  # apart after 60,000 characters
ROWS += page(13, **{n: {"html": f"{MANY}<script>{LONG}y</script>"} for n in ("bot1", "bot2", "human1", "human2")})
ROWS += page(10, bot1={"redirect_chain": ["https://a.example/", "https://a.example/b", "https://a.example/"]}, human2={"early_html": "", "client_navigations": 1})


@pytest.fixture(scope="module")
def told(spark):
    names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
    obs = spark.createDataFrame([tuple(r[n] for n in names) for r in ROWS], SCHEMA).repartition(3)
    variants = D.variant_table(spark, (*D.VARIANT_ROWS, ("tablet", "tablet_difference", "device", "human", "html")))
    wide = D.signal_details(P.seen(obs), variants)
    return {r["page_id"]: r.asDict(recursive=True) for r in wide.collect()}


def test_each_error_kind_alone(told):
    for i, fault in enumerate(ALONE):
        s = told[100 + i]["browser_errors"]
        assert s["status"] == "observed" and s["compared"] == list(FOUR), fault
        own = next(r for r in s["evidence"]["browsers"] if r["name"] == "human#1")
        key, value = next(iter(fault.items()))
        assert own[key] == (value[:3] if isinstance(value, list) else value)
    assert told[1]["browser_errors"]["status"] == told[2]["browser_errors"]["status"] == "not_observed"
    assert told[3]["browser_errors"]["status"] == "observed" and told[3]["browser_errors"]["evidence"]["others"][0]["error_kind"] == "dns"


def test_any_number_of_replicates(told):
    s = told[4]["repeat_instability"]
    assert s["compared"] == ["bot#1~bot#2", "bot#2~bot#3", "human#1~human#2", "human#2~human#3"] and s["status"] == "observed"
    assert [x["differences"] for x in s["evidence"]["within_side_differences"]][:3] == [[], [], []] and "mechanisms" in s["evidence"]["within_side_differences"][3]["differences"]
    assert s["evidence"]["gaps_sec"] == [10.0, 10.0, 10.0]  # no gap before or after the time that is missing
    assert told[4]["client_type_response_difference"]["compared"] == ["bot#1", "human#1", "bot#2", "human#2", "bot#3", "human#3"]
    assert told[4]["client_type_response_difference"]["evidence"]["systematic"] == []
    assert told[9]["repeat_instability"]["status"] == "unmeasurable"


def test_first_access(told):
    s = told[5]["first_access_only"]
    assert s["evidence"]["first"] == "bot#1" and s["status"] == "not_observed" and s["compared"][:2] == ["bot#1", "human#1"]
    assert told[9]["first_access_only"]["status"] == "unmeasurable" and told[9]["first_access_only"]["compared"] == []


def test_clients_that_differ(told):
    s = told[6]["client_type_response_difference"]
    assert s["status"] == "observed" and "mechanisms" in s["evidence"]["systematic"] and "status" not in s["evidence"]["systematic"]
    assert told[6]["decoy_candidate"]["evidence"][0]["benign_looking"] == "bot#1" and told[6]["decoy_candidate"]["compared"] == ["bot#1", "bot#2"]
    assert told[1]["client_type_response_difference"]["status"] == "not_observed" and told[9]["client_type_response_difference"]["status"] == "unmeasurable"
    assert told[10]["multi_hop_redirect"]["status"] == "observed" and told[10]["client_side_redirect"]["status"] == "observed" and told[10]["delayed_content"]["status"] == "observed"
    assert told[9]["blank_page"]["compared"] == ["bot#1"] and told[9]["http_status_difference"]["status"] == "unmeasurable"


def test_all_scripts_are_compared_whole(told):
    for i, n in ((11, 1), (12, 1), (13, 0)):
        s = told[i]["script_inventory_difference"]
        assert s["status"] == ("observed" if n else "not_observed")
        assert [(p["inline_only_bot"], p["inline_only_human"]) for p in s["evidence"]] == [(n, n)] * 2


def test_changed_clients(told):
    s = told[7]["desktop_mobile_difference"]
    assert s["status"] == "observed" and "mechanisms" in s["evidence"]["differs_from_all_controls"] and s["compared"] == ["variant:mobile", "human#1", "human#2"]
    assert told[7]["referer_presence_effect"]["evidence"]["differs_from_all_controls"] == ["status"]
    assert "tablet_difference" not in told[7]  # a signal of its own id needs a column of its own; the table of signals is fixed
    # controls that disagree in title and host explain nothing there, what they share still counts
    assert set(told[8]["desktop_mobile_difference"]["evidence"]["differs_from_all_controls"]) == {"mechanisms"}
    assert told[1]["desktop_mobile_difference"] == {"category": "device", "status": "not_tested", "compared": [], "evidence": None}


def test_plan_settings(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "human_human", "bot_first", 3, ["referer", "mobile", "mobile"])], "page_id long, asked string, pair_mode string, crawl_order string, replicates int, variants array<string>")
    rows = [(r.slot, r.replicate, r.variant, r.kind) for r in O.plan_table(pages).orderBy("access_index").collect()]
    assert rows == [(s, r, None, "browser") for r in (1, 2, 3) for s in ("bot", "human")] + [("human", 1, "mobile", "browser"), ("bot", 1, "referer", "http_baseline")]
    for column, bad, name in (("pair_mode", "bot", "PAIR_MODE"), ("crawl_order", "x", "CRAWL_ORDER"), ("replicates", 0, "replicates"), ("variants", ["tv"], "OBSERVATION_VARIANTS"), ("pair_mode", None, "PAIR_MODE")):
        broken = pages.withColumn(column, F.lit(bad).cast(pages.schema[column].dataType))
        with pytest.raises(PySparkException, match=f"invalid_{name}"):
            O.plan_table(broken).collect()
