"""Landed files round trip: payloads written as files, read with the file sources, parsed."""

import uuid

from pyspark.sql import functions as F

from curata.session import checkpoint_dir
from curata.sources import feeds, landing
from curata.sources import fixtures as FX
from curata.sources.landed import land_fixture

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _base(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"


def _rows(df):
    return sorted(map(tuple, df.select(*feeds.ARTICLE_COLUMNS).collect()), key=repr)


def test_json_lines_items(spark):
    base = _base(spark)
    raw = landing.hn_item_payloads(spark, SF)
    raw.select("payload").write.text(f"{base}/hn")
    from_files = feeds.parse_hn_items(feeds.read_landed(spark, f"{base}/hn"))
    assert _rows(from_files) == _rows(feeds.parse_hn_items(raw))


def test_listing_label_from_path(spark):
    base = _base(spark)
    raw = landing.reddit_listings(spark, SF)
    for r in raw.select("endpoint").distinct().collect():  # one folder per listing label
        label = r["endpoint"]
        raw.where(F.col("endpoint") == label).select("payload").write.text(f"{base}/endpoint={label.replace('/', '%2F')}")
    files = feeds.read_landed(spark, f"{base}/*").withColumn("endpoint", feeds.label_from_path(F.col("file")))
    assert _rows(feeds.parse_reddit(files)) == _rows(feeds.parse_reddit(raw))


def test_feed_documents(spark, tmp_path):
    raw = landing.rss_items(spark, SF)
    feed = feeds.RSS_FEEDS[0]
    items = raw.where(F.col("feed_url") == feed)
    doc = '<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>f</title>' + "".join(
        r["item_xml"].replace(' xmlns:media="http://search.yahoo.com/mrss/"', "") for r in items.orderBy("seq").collect()
    ) + "</channel></rss>"
    path = tmp_path / "feed.xml"
    path.write_text(doc, encoding="utf-8")
    parsed = feeds.parse_rss_rows(feeds.read_feed_files(spark, str(path), feed), FX.as_of())
    assert _rows(parsed) == _rows(feeds.parse_rss(items, FX.as_of()))


def test_feed_documents_land_in_files_of_their_own(spark):
    # a feed file is read whole by one task, so it must not grow with the number of documents
    base = _base(spark)
    land_fixture(spark, MID, base)
    docs = feeds.read_landed(spark, f"{base}/rss/*", whole=True)
    each = docs.select((F.size(F.split("payload", "</channel></rss>")) - 1).alias("n")).collect()
    assert [r["n"] for r in each] == [1] * 5  # 250 pages, 50 to a document
    items = landing.rss_items(spark, MID)
    landed = feeds.read_items(feeds.feed_items(docs.withColumn("feed_url", feeds.label_from_path(F.col("file"), "feed"))))
    assert _rows(feeds.parse_rss_rows(landed, FX.as_of())) == _rows(feeds.parse_rss(items, FX.as_of()))
