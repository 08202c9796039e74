"""Parse-job edge rows: thresholds, coercion, missing fields, dates, media."""

import datetime as dt
import json

from pyspark.sql import functions as F

from curata.sources import feeds

def AS():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def test_hn_items_thresholds_and_coercion(spark):
    raw = spark.createDataFrame(
        [
            ('{"id":1,"type":"story","score":49,"url":"https://a.com/1","title":"t1"}',),
            ('{"id":2,"type":"story","score":50,"url":"https://a.com/2","title":" t2 ","time":60,"descendants":3}',),
            ('{"id":3,"type":"story","score":"70","url":"https://www.b.com/3","title":"t3"}',),
            ('{"id":4,"type":"job","score":99,"url":"https://a.com/4","title":"t4"}',),
            ('{"id":5,"type":"story","score":99,"url":"","title":"t5"}',),
            ('{"id":6,"type":"story","score":99,"url":"https://a.com/6","title":{"x":1}}',),
            ('{"id":7,"type":"story","score":null,"url":"https://a.com/7","title":"t7"}',),
            ("not json",),
        ],
        "payload string",
    )
    rows = {r["id"]: r for r in feeds.parse_hn_items(raw).collect()}
    assert sorted(rows) == [2, 3, 6]
    assert rows[2]["title"] == "t2" and rows[2]["comments"] == 3
    assert rows[2]["published_at"] == dt.datetime(1970, 1, 1, 0, 1)
    assert rows[3]["upvotes"] == 70 and rows[3]["source_domain"] == "b.com"
    rej = {r["reason"] for r in feeds.hn_rejects(raw.withColumn("k", F.lit(1))).collect()}
    assert rej == {"low_score", "not_story", "blank_url", "malformed"}


def test_reddit_filters(spark):
    def post(**kw):
        base = {"title": "T", "url": "https://x.com/a", "score": 100, "num_comments": 20, "is_self": False, "created_utc": 0}
        base.update(kw)
        return base

    import json

    posts = [post(), post(score=99), post(num_comments=19), post(is_self=None), post(url="https://www.reddit.com/r/a"),
             post(thumbnail="https://t/1.jpg", subreddit_name_prefixed="r/x")]
    for p in posts:
        if p.get("is_self", 0) is None:
            del p["is_self"]
    payload = json.dumps({"data": {"children": [{"data": p} for p in posts]}})
    raw = spark.createDataFrame([("r/programming/hot", payload)], "endpoint string, payload string")
    rows = feeds.parse_reddit(raw).collect()
    assert len(rows) == 2
    descr = sorted(r["description"] for r in rows)
    assert descr == ["r/programming/hot — 100 upvotes, 20 comments", "r/x — 100 upvotes, 20 comments"]
    assert sorted(r["image_url"] for r in rows) == ["", "https://t/1.jpg"]


def test_gnews_envelope(spark):
    ok = '{"articles":[{"title":" A ","url":"https://a.com/x","publishedAt":"2024-01-30T10:00:00Z","source":{"name":"n","url":""}},' \
         '{"title":"B","url":"https://b.com/y","publishedAt":"bad","source":{"url":"https://www.src.com"}},{"title":"","url":"u"}]}'
    raw = spark.createDataFrame([(ok,), ('{"articles":{"a":1}}',), ("{}",)], "payload string")
    rows = sorted(feeds.parse_gnews(raw, AS()).collect(), key=lambda r: r["title"])
    assert [r["title"] for r in rows] == ["A", "B"]
    assert rows[0]["published_at"] == dt.datetime(2024, 1, 30, 10) and rows[0]["source_domain"] == "a.com"
    assert rows[1]["published_at"] == dt.datetime(2024, 1, 31) and rows[1]["source_domain"] == "src.com"


def test_rss_age_and_media(spark):
    items = [
        ("https://feeds.x.com/f", "<item><title>old</title><link>u1</link><pubDate>Tue, 30 Jan 2024 11:59:59 +0000</pubDate></item>"),
        ("https://feeds.x.com/f", "<item><title>edge</title><link>u2</link><pubDate>Tue, 30 Jan 2024 13:00:00 +0100</pubDate></item>"),
        ("https://feeds.x.com/f", '<item><title>m</title><link>u3</link><media:thumbnail url="T"/><media:content url="C"/></item>'),
        ("https://feeds.x.com/f", "<item><title>upd</title><link>u4</link><updated>2024-01-30T20:00:00Z</updated><description>&lt;b&gt;x&lt;/b&gt; y</description></item>"),
        ("https://feeds.x.com/f", "<item><title> </title><link>u5</link></item>"),
    ]
    raw = spark.createDataFrame(items, "feed_url string, item_xml string")
    rows = {r["title"]: r for r in feeds.parse_rss(raw, AS()).collect()}
    assert sorted(rows) == ["edge", "m", "upd"]  # 12 h exactly is kept, older is dropped
    assert rows["edge"]["published_at"] == dt.datetime(2024, 1, 30, 12)
    assert rows["m"]["image_url"] == "T" and rows["m"]["published_at"] == dt.datetime(2024, 1, 31)
    assert rows["upd"]["description"] == "x y" and rows["upd"]["source_domain"] == "feeds.x.com"


def test_payload_rejects(spark):
    g = spark.createDataFrame([(1, '{"articles":[]}'), (2, "{oops"), (3, '{"articles":{"e":1}}')], "k int, payload string")
    assert sorted((r["k"], r["reason"]) for r in feeds.payload_rejects(g, "gnews").collect()) == [(2, "malformed"), (3, "no_articles")]
    r = spark.createDataFrame([(1, '{"data":{"children":[]}}'), (2, '{"data":{}}')], "k int, payload string")
    assert [(x["k"], x["reason"]) for x in feeds.payload_rejects(r, "reddit").collect()] == [(2, "no_children")]
    x = spark.createDataFrame([(1, "<item><title>a</title><link>b</link></item>"), (2, "<item><title>a</ti")], "k int, item_xml string")
    assert [(y["k"], y["reason"]) for y in feeds.payload_rejects(x, "rss").collect()] == [(2, "malformed")]


def test_feed_dates(spark):
    given = {
        "Mon, 01 Jan 2024 00:00:00 GMT": dt.datetime(2024, 1, 1), "1 Jan 24 01:02 EST": dt.datetime(2024, 1, 1, 6, 2),
        "Tue, 30 Jan 2024 10:00:00 +0100": dt.datetime(2024, 1, 30, 9), "2024-01-30T20:00:00-05:00": dt.datetime(2024, 1, 31, 1),
        "2024-01-30T20:00:00.750Z": dt.datetime(2024, 1, 30, 20, 0, 0, 750000), "2024-01-30T20:00Z": dt.datetime(2024, 1, 30, 20),
        "Tue, 30 Foo 2024 10:00:00 GMT": None, "2024-02-31T00:00:00Z": None, "yesterday": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in given] + [(None,)], "s string").select("s", feeds.parse_date(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == given | {None: None}


def test_reddit_numbers_as_the_service_sends_them(spark):
    post = '{"data":{"children":[{"data":{"title":"T","url":"https://a.com","score":"150","num_comments":20.0,"is_self":false,"created_utc":1700000000.0}}]}}'
    row = feeds.parse_reddit(spark.createDataFrame([("r/x", post)], "endpoint string, payload string")).first()
    assert row.upvotes == 150 and row.comments == 20 and row.published_at == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_first_media_and_atom_links(spark):
    item = ('<item xmlns:media="http://search.yahoo.com/mrss/"><title>t</title><link>https://a.com</link>'
            '<media:content url="https://m/1.jpg"/><media:content url="https://m/2.jpg"/></item>')
    raw = spark.createDataFrame([("https://f.com/feed", item)], "feed_url string, item_xml string")
    assert feeds.parse_rss(raw, AS()).first().image_url == "https://m/1.jpg"
    entry = ('<entry><title type="html">t</title><link rel="self" href="https://s"/><link href="https://page"/>'
             '<published>2024-01-30T23:00:00Z</published><summary>s &lt;b&gt;x&lt;/b&gt;</summary></entry>')
    raw = spark.createDataFrame([("https://f.com/feed", entry)], "feed_url string, item_xml string")
    got = feeds.parse_rss(raw, AS(), atom=True).first()
    assert (got.title, got.url, got.description, got.published_at) == ("t", "https://page", "s x", dt.datetime(2024, 1, 30, 23))


def test_order_is_that_of_source_file_and_place(spark):
    from curata.sources import landed

    base = ("t", "https://a.com", "reddit", "a.com", "r/x", "", dt.datetime(2024, 1, 1), 1, 1)
    rows = [(*base, ("b", 0, 0, 0)), (*base, ("a", 0, 9, 1)), (*base, ("a", 0, 9, 1)), (*base, ("a", 0, 9, 0)), (*base, ("a", 0, 2, 5)), (*base, ("a", 128, 0, 0)),
            ("first", "u", "hackernews", *base[3:], ("z", 0, 0, 0))]
    schema = ("title string, url string, source string, source_domain string, description string, image_url string, published_at timestamp_ntz, upvotes int, comments int, "
              "at struct<file:string,block:long,line:long,pos:int>")
    df = spark.createDataFrame(rows, schema)
    keyed = landed.order_key(df.withColumn("description", F.to_json("at"))).orderBy("seq").collect()
    assert len({r.seq for r in keyed}) == len(rows) and keyed[0].title == "first"
    places = [(x["file"], x["block"], x["line"], x["pos"]) for x in (json.loads(r.description) for r in keyed[1:])]
    assert places == sorted(places)


def test_foreign_images_in_document_order(spark):
    head = '<item xmlns:m="a" xmlns:yt="b"><title>t</title><link>u</link>'
    cases = {
        '<m:thumbnail url="T"/><m:content url="C"/>': "T", '<yt:thumbnail url=\'Y\' width="3"/>': "Y", '<m:content url="  "/><yt:content url="Z"></yt:content>': "Z",
        '<m:group><m:content url="in"/></m:group><m:thumbnail url="own"/>': "own", '<m:content url="a&amp;b" note="1 > 0"><m:title>x</m:title></m:content>': "a&b",
        '<content url="plain"/>': "", '<m:contents url="no"/><m:thumbnail href="no"/>': "", "<!-- <m:content url='c'/> --><description><![CDATA[<m:content url='d'/>]]></description>": "",
    }
    raw = spark.createDataFrame([("https://f.com", f"{head}<guid>{k}</guid>{x}</item>") for k, x in enumerate(cases)], "feed_url string, item_xml string")
    got = feeds.read_items(raw.withColumn("k", F.monotonically_increasing_id())).orderBy("k").select(F.coalesce(F.get(F.filter("images", lambda u: F.trim(u) != ""), F.lit(0)), F.lit(""))).collect()
    assert [r[0] for r in got] == list(cases.values())


