"""HTML cleaning edge rows."""

import pytest

from curata.operators import clean

ROWS = [
    (1, "<html><head><title>T</title><style>p{}</style></head><body><header>H</header><p>Keep &amp; this</p><aside>A</aside></body></html>"),
    (2, '<div class="advertisement">AD</div><p>one</p><div class="x social-share y">S</div><p>two</p>'),
    (3, "<p>a<b>b</b>c</p><!-- hidden --><script>var t='</p>';</script><p>d</p>"),
    (4, "<p>start</p><nav><a href='/x'>menu"),  # unclosed nav: removed to the end
    (5, ""),
    (6, "   "),
    (7, "<p>" + " ".join(f"w{i}" for i in range(900)) + "</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, html string")


def _texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_clean_pages(pages):
    t = _texts(clean.clean_pages(pages))
    assert t[1] == "T Keep & this"
    assert t[2] == "one two"
    assert t[3] == "abc d"
    assert t[4] == "start"
    assert t[5] == "" and t[6] == ""
    assert t[7].split(" ") == [f"w{i}" for i in range(800)]


VARIANTS = [
    ('<div class="ad"><div>in</div> tail</div><p>body</p>', "body"),
    ("<p>a</p><div class='x ad'>q</div><p>b</p><div class=ad>q</div><p>c</p>", "a b c"),
    ('<p data-class="ad">keep</p>', "keep"),
    ('<h2 class="ad">x</h2><p>keep</p><custom-box class="social-share">y</custom-box>z', "keep z"),
    ('<p>one</p><ul><li class="ad">x<li>keep</ul><p>body</p>', "one keep body"),
    ('<ul><li class="ad">x<ul><li>in</ul>y</ul><p>body</p>', "body"),
    ('<p class="ad">x<p>keep<p class="ad">y<div>d</div>', "keep d"),
    ('<table><tr><td class="ad">x<td>y<tr class="ad"><td>z</table>w', "y w"),
    ('<nav><ul><li>menu</ul></nav><p>a</p><aside>b', "a"),
    ("a<script>if (x<y) '</p>'</script>b<!-- <nav> -->c<style>p{}</style>", "abc"),
    ("x &rsquo;&mdash;&#8217;&#x2019;&hellip; &amp;lt; &unknown; &copy 1 &#xD800; &amp", "x ’—’’… &lt; &unknown; © 1 � &"),
    ("a < b <p", "a < b"),
    ('<p>a <a title="x > y">b</a></p>', "a b"),
    ('<div data-x="1>2" class="ad">gone</div>keep', "keep"),
    ("<a title='<script>' rel=x>t</a>u<b title=\"<!--\">v</b>", "tuv"),
    ('one<p title="never ends>two', "one"),
    ("<script src='a>b'>x</script>y<STYLE media=\"p>q\">z</style >w", "yw"),
    ('a"b > c" d=\'e\'', 'a"b > c" d=\'e\''),
    ("<p>" + "<b>w</b> " * 3000 + "</p>", " ".join(["w"] * 800)),
]


def test_variants(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(VARIANTS)], "page_id long, html string")
    assert _texts(clean.clean_pages(df)) == {i: want for i, (_, want) in enumerate(VARIANTS)}


def test_descriptions_drop_scripts_and_cut_whole_units(spark):
    from pyspark.sql import functions as F

    from curata.functions import text

    df = spark.createDataFrame([("<script>alert(1)</script>x &mdash; <b>y</b>",), ("\U0001F600" * 300,), ("a" + "\U0001F600" * 300,), ("b" * 501,)], "s string")
    rows = df.select(text.strip_tags(F.col("s")).alias("a"), text.strip_truncate(F.col("s")).alias("b")).collect()
    assert rows[0].a == "x — y"
    assert rows[1].b == "\U0001F600" * 250 + "..." and rows[2].b == "a" + "\U0001F600" * 249 + "..." and rows[3].b == "b" * 500 + "..."


def test_class_marked_void_and_cell(spark):
    df = spark.createDataFrame(
        [(1, '<p>a</p><img class="ad" src="x.png"><p>b</p>'), (2, '<table><tr><td class="ad">x</td><td>y</td></tr></table><p>z</p>')],
        "page_id long, html string",
    )
    t = _texts(clean.clean_pages(df))
    assert t[1] == "a b" and t[2] == "y z"


def test_every_named_entity(spark):
    from html import unescape
    from html.entities import html5

    from pyspark.sql import functions as F

    from curata.functions import html

    rows = [f"&{n}" + ("" if n.endswith(";") else " .") for n in html5]
    rows += ["it&apos;s &colon;&lbrack;&dollar;&check;&rbrack; &NotEqualTilde; &AMP &apos x", "&amp;apos; &nosuchname; &Apos;"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", html.decode_entities(F.col("s")).alias("d")).collect()
    assert {r.s: r.d for r in got} == {r: unescape(r) for r in rows}
    page = spark.createDataFrame([(1, "<p>it&apos;s &lbrack;a&rbrack;</p>")], "page_id long, html string")
    assert _texts(clean.clean_pages(page)) == {1: "it's [a]"}


def test_descriptions_know_quoted_attributes(spark):
    from pyspark.sql import functions as F

    from curata.functions import text

    cases = {'a <i title="x > y">b</i>': "a b", "1 <b data='<c>'>2</b> < 3": "1 2 &lt; 3", '<img alt="a>b"/>c<a href="x': "c", "<script>a</script >b<!-- > -->c": "bc"}
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", text.strip_tags(F.col("h")).alias("t"))
    assert {r.h: r.t for r in df.collect()} == cases
