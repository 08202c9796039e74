"""Edge rows for the column functions (URL, trim, scores, tags, summaries)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from curata.functions import scoring, summary, text, urls


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://www.A.com:8080/X%20y/+z/?q=1#f", "https://www.a.com/x y/+z"),
        ("http://a_b.com/x/", "http://a_b.com/x"),  # no host -> fallback branch
        ("mailto:a@b.c", "mailto:a@b.c"),
        ("http://bad host/x?y=1", "http://bad host/x"),
        ("foo/bar", "foo/bar"),
        ("https://h.com", "https://h.com"),
        ("https://h.com//", "https://h.com/"),
        (None, ""),
        ("", ""),
        ("  https://h.com/a/  ", "https://h.com/a"),
        ("HTTP://h.com/é/?a", "http://h.com/é"),
        ("https://u:p@h.com:8443/a%2Fb/", "https://h.com/a/b"),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, urls.normalize_url, url) == expected


@pytest.mark.parametrize(
    "url,expected",
    [("https://h.com/x/?a=1", "https://h.com/x"), ("https://h.com/x#f", "https://h.com/x#f"), ("HTTP://H.com:81/", "http://h.com:81"), (None, "")],
)
def test_normalize_url_memory(spark, url, expected):
    assert one(spark, urls.normalize_url_memory, url) == expected


@pytest.mark.parametrize(
    "url,strict,feed",
    [
        ("https://www.Example.com:8080/x", "Example.com", "Example.com"),
        ("not a url", "", "not a url"),
        ("https://feeds.arstechnica.com/a", "feeds.arstechnica.com", "feeds.arstechnica.com"),
        ("mailto:a@b.c", "", "mailto:a@b.c"),
    ],
)
def test_url_domain(spark, url, strict, feed):
    assert one(spark, urls.url_domain, url) == strict
    assert one(spark, lambda c: urls.url_domain(c, fallback_to_url=True), url) == feed


def test_article_id_is_name_uuid_v3(spark):
    import hashlib
    import uuid

    for s in ["https://a.com/x", "https://h.com/é", ""]:
        expected = str(uuid.UUID(bytes=hashlib.md5(s.encode("utf-8")).digest(), version=3))
        assert one(spark, urls.article_id, s) == expected


def test_jtrim_and_blank(spark):
    assert one(spark, text.jtrim, "\t\n\x01 ab c \r\x0b") == "ab c"
    assert one(spark, text.is_blank, " \t ") is True
    assert one(spark, text.is_blank, " ") is False  # no-break space is not white space
    assert one(spark, text.is_blank, None) is True


def test_tokens(spark):
    assert one(spark, text.title_tokens, "State-of-the-art AI, 2024!  Café") == ["stateoftheart", "ai", "2024", "caf"]
    assert one(spark, text.title_tokens, None) == []
    assert one(spark, text.title_tokens, "¡¿!") == []


@pytest.mark.parametrize(
    "title,score",
    [
        ("a" * 19, 0.0), ("a" * 20, 2.0), ("a" * 29, 2.0), ("a" * 30, 4.0), ("a" * 100, 4.0), ("a" * 101, 2.0),
        ("x" * 28 + "\U0001F600", 4.0),  # the emoji counts as two UTF-16 units: 30
        ("Shocking news you won't believe, really!!", 1.0),  # two phrases, one penalty
        ("Version 2 released for everyone here", 4.5),
        ("Version\n2 released for everyone here", 4.0),  # digit on a second line: no bonus
        (None, 0.0),
    ],
)
def test_title_quality(spark, title, score):
    assert one(spark, scoring.title_quality_score, title) == score


@pytest.mark.parametrize("total,expected", [(-1, 3.0), (0, 3.0), (1, math.log1p(1) * 10 / math.log1p(10000)), (10000, 10.0), (100000, 10.0)])
def test_engagement(spark, total, expected):
    r = spark.createDataFrame([(total, 0)], "u int, c int").select(scoring.engagement_score(F.col("u"), F.col("c")).alias("r")).first()["r"]
    assert r == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize(
    "age,expected",
    [(-dt.timedelta(hours=3), 10.0), (dt.timedelta(minutes=59), 10.0), (dt.timedelta(hours=23, minutes=59), 10 - 23 * 10 / 24),
     (dt.timedelta(hours=24), 0.0), (None, 0.0)],
)
def test_recency(spark, age, expected):
    as_of = dt.datetime(2024, 1, 31)
    p = None if age is None else as_of - age
    df = spark.createDataFrame([(p,)], "p timestamp_ntz")
    r = df.select(scoring.recency_score(F.col("p"), F.lit(as_of).cast("timestamp_ntz")).alias("r")).first()["r"]
    assert r == pytest.approx(expected)


def test_keywords_and_tags(spark):
    df = spark.createDataFrame(
        [("He said JavaScript", None, "web"), ("AI Python Rust Docker Kubernetes news", "", "web"), ("AI Python Rust Go", None, "Go")],
        "t string, d string, s string",
    )
    rows = df.select(
        scoring.keyword_matches(F.col("t"), F.col("d")).alias("k"), scoring.derive_tags(F.col("t"), F.col("d"), F.col("s")).alias("tags")
    ).collect()
    assert rows[0]["k"] == 2  # 'ai' inside 'said', 'java' inside 'javascript'
    assert rows[0]["tags"] == ["AI", "JavaScript", "Java", "web"]
    assert rows[1]["tags"] == ["AI", "Python", "Rust", "Kubernetes", "Docker"]  # source dropped at five
    assert rows[2]["tags"] == ["AI", "Python", "Rust", "Go"]  # source equal to a tag is not repeated


@pytest.mark.parametrize(
    "raw,clean,valid",
    [
        ('  "one two three four five"  ', "one two three four five", True),
        ("one two three four", "one two three four", False),
        (" ".join(["w"] * 100), " ".join(["w"] * 100), True),
        (" ".join(["w"] * 101), " ".join(["w"] * 101), False),
        ('Summary: "x y z w v', '"x y z w v', True),
        ("", "", False),
    ],
)
def test_summary_cleanup(spark, raw, clean, valid):
    c = one(spark, summary.clean_summary, raw)
    assert c == clean
    assert one(spark, summary.is_valid_summary, c) is valid


def test_fallback_summary(spark):
    d80 = " ".join(f"w{i}" for i in range(80))
    d81 = d80 + " w80"
    df = spark.createDataFrame([("T", d80), ("T", d81), ("T", "  <b> </b> "), ("T", "<p>a &amp; b</p>")], "t string, d string")
    r = [x["r"] for x in df.select(summary.fallback_summary(F.col("t"), F.col("d")).alias("r")).collect()]
    assert r[0] == d80 and r[1] == d80 + "..." and r[2] == "T" and r[3] == "a &amp; b"


def test_response_text(spark):
    ok = '{"candidates":[{"content":{"parts":[{"text":"hi there"}]}}]}'
    assert one(spark, summary.response_text, ok) == "hi there"
    assert one(spark, summary.response_text, '{"candidates":[') == ""
    assert one(spark, summary.response_text, '{"candidates":[]}') == ""


def test_generate_with_provider_then_resolve(spark):
    from curata.operators import summarize

    arts = spark.createDataFrame(
        [("https://a.com/1", "Title one here", "<p>alpha beta gamma delta epsilon zeta</p>")], "url string, title string, description string"
    )

    def provider(prompts):  # echo six words of the prompt's title line, wrapped as a response
        import json

        out = []
        for p in prompts:
            line = [x for x in p.split("\n") if x.startswith(("Title:", "Headline:"))][0]
            words = (line.split(":", 1)[1].strip() + " one two three").split()
            out.append(json.dumps({"candidates": [{"content": {"parts": [{"text": " ".join(words)}]}}]}))
        return out

    resp = summarize.generate(summarize.prompts(arts), provider)
    assert resp.count() == 2
    r = summarize.resolve_summaries(arts, resp).first()
    assert r["summary_source"] == "attempt1" and r["summary"] == "Title one here one two three"
