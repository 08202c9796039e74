"""Raw source payloads derived from the pages fixture, as they would land from each source.

These encode the ``articles_pages`` view into the four payload shapes (JSON item, JSON id list,
JSON headline envelope, JSON listing, XML feed item) with deliberate irregularities (numbers as
strings, missing fields, blank urls, self posts, unparsable dates, malformed documents), so the
parse jobs are exercised on data that grows with the tables. Grouped payloads (id lists,
envelopes, listings) hold a fixed number of consecutive rows, so no group is unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.sources import fixtures as FX
from curata.sources.feeds import EPOCH_NTZ, REDDIT_ENDPOINTS, RSS_FEEDS

LIST_SIZE = 150
CHUNK = 50


def _secs(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), ts)


def hn_item_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, payload)``: one story document per page. Score = 2 x upvotes, written as a JSON
    string for every fourth page; every tenth is a job; some urls blank; some documents broken."""
    a = FX.articles_pages(spark, sf_dir)
    seq = F.col("seq")
    base = F.to_json(
        F.struct(
            seq.alias("id"),
            F.when(seq % 10 == 9, F.lit("job")).otherwise(F.lit("story")).alias("type"),
            F.when(seq % 17 == 0, F.lit("")).otherwise(F.col("url")).alias("url"),
            F.col("title"),
            _secs(F.col("published_at")).alias("time"),
            F.col("comments").alias("descendants"),
        )
    )
    score = (F.col("upvotes") * 2).cast("string")
    score_json = F.when(seq % 4 == 0, F.concat(F.lit('"'), score, F.lit('"'))).otherwise(score)
    payload = F.concat(F.regexp_replace(base, "}$", ""), F.lit(',"score":'), score_json, F.lit("}"))
    return a.select("seq", F.when(seq % 23 == 0, F.lit("{not json")).otherwise(payload).alias("payload"))


def hn_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(list_id, payload)``: JSON arrays of ids, ``LIST_SIZE`` consecutive pages each, ordered
    by score descending (then id)."""
    a = FX.articles_pages(spark, sf_dir).select("seq", (F.col("upvotes") * 2).alias("score"))
    grouped = a.groupBy(F.floor(F.col("seq") / LIST_SIZE).cast("long").alias("list_id")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), F.col("seq").alias("id")))).alias("ids")
    )
    return grouped.select("list_id", F.to_json(F.transform("ids", lambda x: x["id"])).alias("payload"))


def gnews_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk, payload)``: headline envelopes of ``CHUNK`` pages; every seventh envelope has a
    non-array ``articles``; some titles padded, some dates unparsable, some source urls blank."""
    a = FX.articles_pages(spark, sf_dir)
    seq = F.col("seq")
    art = F.struct(
        F.when(seq % 9 == 0, F.concat(F.lit("  "), F.col("title"), F.lit(" "))).otherwise(F.col("title")).alias("title"),
        F.col("url"),
        F.col("description"),
        F.when(seq % 2 == 0, F.concat(F.lit("https://img.example.com/"), seq.cast("string"), F.lit(".jpg"))).alias("image"),
        F.when(seq % 13 == 0, F.lit("yesterday"))
        .when(seq % 5 == 1, F.date_format(F.timestamp_add("HOUR", F.lit(-5), F.col("published_at")), "yyyy-MM-dd'T'HH:mm:ss'-05:00'"))
        .when(seq % 5 == 2, F.date_format(F.col("published_at"), "yyyy-MM-dd'T'HH:mm:ss'.250Z'"))
        .otherwise(F.date_format(F.col("published_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("publishedAt"),
        F.struct(
            F.lit("GNews").alias("name"),
            F.when(seq % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("https://www."), F.col("source_domain"), F.lit("/"))).alias("url"),
        ).alias("source"),
    )
    chunk = F.floor(seq / CHUNK).cast("long")
    env = a.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("totalArticles"), F.collect_list(art).alias("articles"))
    payload = F.when(F.col("chunk") % 7 == 3, F.lit('{"totalArticles":0,"articles":{"error":"quota"}}')).otherwise(
        F.to_json(F.struct("totalArticles", "articles"))
    )
    return env.select("chunk", payload.alias("payload"))


def _quoted(when: Column, number: Column) -> Column:
    """A JSON number, as a string where ``when`` holds."""
    return F.when(when, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)


def reddit_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(endpoint, payload)``: listings of ``CHUNK`` pages; scores 4 x upvotes, comments
    2 x purchases, some of them JSON strings, times with a fraction; self posts, missing ``is_self``, reddit-internal links and missing subreddit
    names included."""
    a = FX.articles_pages(spark, sf_dir)
    seq = F.col("seq")
    data = F.struct(
        F.col("title"),
        F.when(seq % 8 == 0, F.concat(F.lit("https://www.reddit.com/r/technology/comments/"), seq.cast("string"))).otherwise(F.col("url")).alias("url"),
        F.parse_json(_quoted(seq % 7 == 3, (F.col("upvotes") * 4).cast("string"))).alias("score"),
        F.parse_json(_quoted(seq % 7 == 5, (F.col("comments") * 2).cast("string"))).alias("num_comments"),
        F.when(seq % 6 == 0, F.lit(True)).when(seq % 6 == 1, F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("is_self"),
        F.parse_json(F.concat(_secs(F.col("published_at")).cast("string"), F.lit(".0"))).alias("created_utc"),
        F.when(seq % 2 == 0, F.concat(F.lit("https://thumbs.example.com/"), seq.cast("string"), F.lit(".jpg"))).otherwise(F.lit("self")).alias("thumbnail"),
        F.when(seq % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("r/technology")).alias("subreddit_name_prefixed"),
    )
    chunk = F.floor(seq / CHUNK).cast("long")
    lst = a.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct(F.lit("t3").alias("kind"), data.alias("data"))).alias("children"))
    labels = F.array(*[F.lit(e) for e in REDDIT_ENDPOINTS])
    return lst.select(
        F.element_at(labels, (F.col("chunk") % len(REDDIT_ENDPOINTS) + 1).cast("int")).alias("endpoint"),
        F.to_json(F.struct(F.lit("Listing").alias("kind"), F.struct("children").alias("data"))).alias("payload"),
    )


def _xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(feed_url, item_xml)``: one feed item per page. Dates as RFC-822 ``pubDate`` (UTC or
    +0100), ISO ``updated`` or absent; media content / thumbnail / both (thumbnail first) / another namespace / none."""
    a = FX.articles_pages(spark, sf_dir)
    seq = F.col("seq")
    p = F.col("published_at")
    rfc = F.when(
        seq % 2 == 0,
        F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(1), p), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0100")),
    ).when(seq % 9 == 3, F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(-5), p), "d MMM yy HH:mm:ss"), F.lit(" EST"))
    ).otherwise(F.concat(F.date_format(p, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    date_el = (
        F.when((seq % 3 == 0) & p.isNotNull(), F.concat(F.lit("<pubDate>"), rfc, F.lit("</pubDate>")))
        .when((seq % 3 == 1) & p.isNotNull(), F.concat(F.lit("<updated>"), F.date_format(p, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated>")))
        .otherwise(F.lit(""))
    )
    content = F.concat(F.lit('<media:content url="https://media.example.com/c'), seq.cast("string"), F.lit('.jpg"/>'))
    thumb = F.concat(F.lit('<media:thumbnail url="https://media.example.com/t'), seq.cast("string"), F.lit('.jpg"/>'))
    media = (
        F.when(seq % 4 == 0, F.concat(F.lit('<media:content url=" "/>'), content, F.replace(content, F.lit("/c"), F.lit("/later")))).when(seq % 4 == 1, thumb).when(seq % 4 == 2, F.concat(thumb, content))
        # another namespace, after a group whose content is not the item's own
        .when(seq % 8 == 3, F.concat(F.lit("<media:group>"), content, F.lit("</media:group>"), F.replace(F.replace(thumb, F.lit("media:"), F.lit("yt:")), F.lit("/t"), F.lit("/y"))))
        .otherwise(F.lit(""))
    )
    xml = F.concat(
        F.lit('<item xmlns:media="http://search.yahoo.com/mrss/" xmlns:yt="http://www.youtube.com/xml/schemas/2015"><title>'), _xml_escape(F.col("title")), F.lit("</title><link>"),
        _xml_escape(F.col("url")), F.lit("</link>"), date_el, F.lit("<description>"), _xml_escape(F.col("description")),
        F.lit("</description>"), media, F.lit("</item>"),
    )
    feeds = F.array(*[F.lit(f) for f in RSS_FEEDS])
    feed = F.element_at(feeds, (F.floor(seq / CHUNK) % len(RSS_FEEDS) + 1).cast("int"))
    return a.select("seq", feed.alias("feed_url"), xml.alias("item_xml"))


def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, feed_url, item_xml)``: one Atom entry per page. Links with and without ``rel``, dates as
    ``published`` with an offset, ``updated`` or absent, some titles blank."""
    a = FX.articles_pages(spark, sf_dir)
    seq, p, url = F.col("seq"), F.col("published_at"), _xml_escape(F.col("url"))
    shifted = F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(2), p), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    date_el = (
        F.when((seq % 3 == 0) & p.isNotNull(), F.concat(F.lit("<published>"), shifted, F.lit("</published>")))
        .when((seq % 3 == 1) & p.isNotNull(), F.concat(F.lit("<updated>"), F.date_format(p, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated>")))
        .otherwise(F.lit(""))
    )
    own = F.when(seq % 2 == 0, F.concat(F.lit('<link rel="self" href="https://feed.example.com/"/><link rel="alternate" href="'), url, F.lit('"/>'))).otherwise(
        F.concat(F.lit('<link href="'), url, F.lit('"/>')))
    title = F.when(seq % 11 == 0, F.lit("  ")).otherwise(_xml_escape(F.col("title")))
    xml = F.concat(F.lit("<entry><title>"), title, F.lit("</title>"), own, date_el, F.lit("<summary>"), _xml_escape(F.col("description")), F.lit("</summary></entry>"))
    return a.select("seq", F.lit(RSS_FEEDS[1]).alias("feed_url"), xml.alias("item_xml"))
