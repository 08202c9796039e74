"""Parse jobs for landed source payloads (JSON lines / XML items) into article rows.

Polling the remote APIs is outside the engine: payloads land as files (one payload per line or
per XML item) and each source becomes a scan plus a parse. ``read_landed`` reads a landing folder
of any size; the parsers are column expressions, so a bad payload yields NULLs (and a ``rejects``
row), never a failed job.

Output schema of every parser (``ARTICLE_COLUMNS``):
``title, url, source, source_domain, description, image_url, published_at, upvotes, comments``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import text, urls, vocab

ARTICLE_COLUMNS = ["title", "url", "source", "source_domain", "description", "image_url", "published_at", "upvotes", "comments"]
EPOCH_NTZ = "1970-01-01 00:00:00"

# FIXED VALUES: listing labels (in fetch order) and feed addresses; the feed host is the RSS domain.
REDDIT_ENDPOINTS = ["r/programming/hot", "r/programming/new", "r/technology/top", "r/technology/hot"]
RSS_FEEDS = [
    "https://techcrunch.com/feed/",
    "https://www.theverge.com/rss/index.xml",
    "https://feeds.arstechnica.com/arstechnica/index",
]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# FIXED VALUES: hours east of UTC of the zone names that feed dates may carry.
ZONES = {"UT": 0, "GMT": 0, "UTC": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}

RSS_ITEM_SCHEMA = "title string, link string, pubDate string, updated string, description string, _corrupt_record string"
ATOM_ENTRY_SCHEMA = "title string, link array<struct<_href:string,_rel:string>>, published string, updated string, summary string, _corrupt_record string"
_NAME, _VALUE = r"[A-Za-z_][\w.-]*", r"\s*=\s*(?:\"[^\"]*\"|'[^']*')"


def read_landed(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """Landed payloads, one document per line (or per file): ``(payload, file, at)``. Any number of files; the
    file path is kept so a label (e.g. the listing endpoint) can be derived from the layout. ``at`` is the
    payload's place, ordered by file and line: the start of its block of the file, and its turn in it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.lit(0).alias("pos"))
    return spark.read.option("wholetext", whole).text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"), place.alias("at"))


def _placed(at: Column, pos: Column) -> Column:
    """The place of element ``pos`` of the payload at ``at``."""
    return F.struct(at["file"].alias("file"), at["block"].alias("block"), at["line"].alias("line"), pos.cast("int").alias("pos"))


def feed_items(docs: DataFrame) -> DataFrame:
    """Feed documents (``payload``, one in each row) to their RSS items and Atom entries, in document order: the other
    columns, ``item_xml`` and ``atom``. Documents are a few MB at most; an end tag inside CDATA ends an item."""
    found = F.regexp_extract_all("payload", F.lit(r"(?s)<(item|entry)(?:\s[^>]*)?>.*?</\1\s*>"), F.lit(0))
    rows = docs.select(*[c for c in docs.columns if c != "payload"], F.posexplode(found).alias("_pos", "item_xml"))
    if "at" in rows.columns:
        rows = rows.withColumn("at", _placed(F.col("at"), F.col("_pos")))
    return rows.drop("_pos").withColumn("atom", F.col("item_xml").startswith("<entry"))


def read_feed_files(spark: SparkSession, path: str | list[str], feed_url: Column | str) -> DataFrame:
    """Landed feed documents as item columns (RSS items and Atom entries). ``feed_url`` is a value or a column over ``file``."""
    docs = read_landed(spark, path, whole=True).withColumn("feed_url", F.lit(feed_url) if isinstance(feed_url, str) else feed_url)
    return read_items(feed_items(docs))


def foreign_images(item_xml: Column) -> Column:
    """The ``url`` attributes of an item's own ``content`` and ``thumbnail`` elements of any foreign namespace, in document order."""
    name, attributes = rf"{_NAME}:{_NAME}", rf"(?:\s+[\w:.-]+{_VALUE})*"
    own = F.regexp_replace(item_xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    own = F.regexp_replace(own, rf"(?s)<(({name}){attributes})\s*>.*?</\2\s*>", "<$1/>")  # what foreign elements hold is not the item's
    tags = F.regexp_extract_all(own, F.lit(rf"<{_NAME}:(?:content|thumbnail){attributes}\s*/>"), F.lit(0))

    def url(tag: Column) -> Column:
        raw = F.regexp_extract(tag, r"\surl\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
        raw = F.substring(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0)))
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            raw = F.replace(raw, F.lit(entity), F.lit(char))
        return raw

    return F.transform(tags, url)


def atom_to_items(entries: DataFrame) -> DataFrame:
    """Atom entries in the columns of RSS items: the first link that is the page itself, ``published``
    (else ``updated``) as dates, the summary as description."""
    page = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    url = F.coalesce(F.get(page, F.lit(0))["_href"], F.get(F.col("link"), F.lit(0))["_href"])
    keep = [c for c in entries.columns if c not in ("title", "link", "published", "updated", "summary")]
    return entries.select(*keep, "title", url.alias("link"), F.col("published").alias("pubDate"), "updated", F.col("summary").alias("description"))


def label_from_path(file_col: Column, key: str = "endpoint") -> Column:
    """``.../<key>=<value>/...`` -> value, e.g. a listing label from the landing path.

    ``_metadata.file_path`` is a URI, so a directory name that is itself escaped (as
    ``partitionBy`` writes it) arrives encoded twice: both layers are decoded."""
    return F.try_url_decode(F.try_url_decode(F.regexp_extract(file_col, f"/{key}=([^/]+)/", 1)))


def epoch_seconds_to_ts(secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def _offset_minutes(sign: Column, hours: Column, minutes: Column) -> Column:
    return (hours.try_cast("int") * 60 + minutes.try_cast("int")) * F.when(sign == "-", -1).otherwise(1)


def _matched(s: Column, pattern: str, groups: int, made) -> Column:
    """``made(g)`` over the groups of a whole match, ``g(i)`` being '' for an unused group; NULL without a match.

    The match is done once: the groups are a value bound by a lambda, not repeated in every use."""
    cut = F.split(F.regexp_replace(s, pattern, "\x01".join(f"${i}" for i in range(1, groups + 1))), "\x01")
    one = F.transform(F.array(cut), lambda x: F.when(F.size(x) == groups, made(lambda i: F.get(x, F.lit(i - 1)))))
    return F.get(one, F.lit(0))


def parse_iso_instant(s: Column) -> Column:
    """ISO date and time with ``Z`` or an offset and an optional fraction -> timestamp_ntz in UTC; anything else -> NULL."""
    pat = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?(?:Z|([+-])(\d{2}):?(\d{2}))$"

    def made(g):
        sec = F.when(g(6) == "", F.lit("0")).otherwise(g(6)).try_cast("decimal(8,6)")
        local = F.try_make_timestamp_ntz(*[g(i).try_cast("int") for i in range(1, 6)], sec)
        offset = F.when(g(7) == "", F.lit(0)).otherwise(_offset_minutes(g(7), g(8), g(9)))
        return F.timestamp_add("MINUTE", -offset, local)

    return _matched(s, pat, 9, made)


def parse_rfc822(s: Column) -> Column:
    """``[EEE,] dd MMM yy[yy] HH:mm[:ss] zone`` with a numeric or named zone -> timestamp_ntz in UTC; anything else -> NULL."""
    pat = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s+(?:([+-])(\d{2})(\d{2})|([A-Z]{1,3}))$"

    def made(g):
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(g(2))).cast("int")
        year = g(3).try_cast("int")
        year = F.when(F.length(g(3)) == 2, year + F.when(year < 50, 2000).otherwise(1900)).otherwise(year)
        sec = F.when(g(6) == "", F.lit("0")).otherwise(g(6)).try_cast("int")
        local = F.try_make_timestamp_ntz(year, F.when(month > 0, month), g(1).try_cast("int"), g(4).try_cast("int"), g(5).try_cast("int"), sec)
        named = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), g(10)) * 60
        offset = F.when(g(10) != "", named).otherwise(_offset_minutes(g(7), g(8), g(9)))
        return F.timestamp_add("MINUTE", -offset, local)

    return _matched(text.jtrim(s), pat, 10, made)


def parse_date(s: Column) -> Column:
    """Either form of date that feeds use."""
    return F.coalesce(parse_rfc822(s), parse_iso_instant(s))


def _number(v: Column, path: str, kind: str) -> Column:
    """A JSON number or numeric string, cut to an integer; 0 when there is none."""
    return F.coalesce(F.try_variant_get(v, path, kind), F.try_variant_get(v, path, "double").try_cast(kind), F.lit(0).cast(kind))


def _text(v: Column, path: str) -> Column:
    """A JSON scalar as text; '' when there is none."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _rows(df: DataFrame, **cols: Column) -> DataFrame:
    """The article columns, with the place ``at`` of each where the payloads have one."""
    return df.select(*[cols[c].alias(c) for c in ARTICLE_COLUMNS], *[c for c in df.columns if c == "at"])


# ---------------------------------------------------------------- Hacker News style items


def hn_rejects(raw: DataFrame, min_score: int = vocab.HN_MIN_SCORE) -> DataFrame:
    """Item payloads that yield no story, with the first failing check as ``reason``
    (malformed, not_story, low_score, blank_url, blank_title); other raw columns are kept."""
    v = F.try_parse_json(F.col("payload"))
    typ = F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit(""))
    score = F.coalesce(F.try_variant_get(v, "$.score", "int"), F.lit(0))
    url = F.coalesce(F.try_variant_get(v, "$.url", "string"), F.lit(""))
    title = text.jtrim(F.coalesce(F.try_variant_get(v, "$.title", "string"), F.lit("")))
    reason = (
        F.when(v.isNull(), F.lit("malformed"))
        .when(typ != "story", F.lit("not_story"))
        .when(score < min_score, F.lit("low_score"))
        .when(text.is_blank(url), F.lit("blank_url"))
        .when(text.is_blank(title), F.lit("blank_title"))
    )
    keep = [c for c in raw.columns if c != "payload"]
    return raw.select(*keep, reason.alias("reason")).where(F.col("reason").isNotNull())


def parse_hn_items(raw: DataFrame, min_score: int = vocab.HN_MIN_SCORE) -> DataFrame:
    """Item payloads -> stories with score >= min_score and nonblank url and title.

    Values are read through VARIANT so that numbers written as strings still count ("7" -> 7),
    missing fields take defaults (score 0, time 0, comments 0). The url is not trimmed."""
    v = F.try_parse_json(F.col("payload"))
    items = raw.select(
        F.try_variant_get(v, "$.id", "bigint").alias("id"),
        F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("")).alias("type"),
        F.coalesce(F.try_variant_get(v, "$.score", "int"), F.lit(0)).alias("score"),
        F.coalesce(F.try_variant_get(v, "$.url", "string"), F.lit("")).alias("url"),
        text.jtrim(F.coalesce(F.try_variant_get(v, "$.title", "string"), F.lit(""))).alias("title"),
        F.coalesce(F.try_variant_get(v, "$.time", "bigint"), F.lit(0).cast("bigint")).alias("time"),
        F.coalesce(F.try_variant_get(v, "$.descendants", "int"), F.lit(0)).alias("comments"),
    )
    kept = items.where(
        (F.col("type") == "story") & (F.col("score") >= min_score) & text.not_blank(F.col("url")) & text.not_blank(F.col("title"))
    )
    return kept.select(
        "id",
        *[
            c.alias(n)
            for n, c in {
                "title": F.col("title"),
                "url": F.col("url"),
                "source": F.lit("hackernews"),
                "source_domain": urls.url_domain(F.col("url")),
                "description": F.lit(None).cast("string"),
                "image_url": F.lit(None).cast("string"),
                "published_at": epoch_seconds_to_ts(F.col("time")),
                "upvotes": F.col("score"),
                "comments": F.col("comments"),
            }.items()
        ],
    )


def hn_top_ids(lists: DataFrame, limit: int = vocab.HN_TOP_STORIES) -> DataFrame:
    """``(list_id, pos, id)``: the first ``limit`` ids of every id-list payload, by position."""
    ids = F.from_json(F.col("payload"), "array<bigint>")
    rows = lists.select("list_id", *[c for c in lists.columns if c == "at"], F.posexplode(ids).alias("pos", "id")).where(F.col("pos") < limit)
    return rows.withColumn("at", _placed(F.col("at"), F.col("pos"))) if "at" in lists.columns else rows


def hn_top_stories(lists: DataFrame, items: DataFrame, limit: int = vocab.HN_TOP_STORIES,
                   min_score: int = vocab.HN_MIN_SCORE) -> DataFrame:
    """Top-id lists joined to their parsed stories (ids whose story is missing or filtered drop out)."""
    return hn_top_ids(lists, limit).join(parse_hn_items(items, min_score), "id")


# ---------------------------------------------------------------- headline envelopes


def _elements(raw: DataFrame, path: str, name: str) -> DataFrame:
    """The elements of a payload's list as variants in column ``name``, each with its place; other columns are kept."""
    found = F.try_variant_get(F.try_parse_json("payload"), path, "array<variant>")
    rows = raw.select("*", F.posexplode(found).alias("_pos", name)).drop("payload")
    if "at" in raw.columns:
        rows = rows.withColumn("at", _placed(F.col("at"), F.col("_pos")))
    return rows.drop("_pos")


def _gnews_rows(raw: DataFrame, as_of: Column) -> DataFrame:
    """All articles of all envelopes with the first failing check as ``reason``."""
    a = _elements(raw, "$.articles", "a")
    v = F.col("a")
    a = a.select(
        *[c for c in a.columns if c != "a"], text.jtrim(_text(v, "$.title")).alias("title"), text.jtrim(_text(v, "$.url")).alias("url"),
        _text(v, "$.description").alias("description"), _text(v, "$.image").alias("image_url"),
        F.coalesce(parse_iso_instant(_text(v, "$.publishedAt")), as_of).alias("published_at"), _text(v, "$.source.url").alias("source_url"),
    )
    return a.withColumn("reason", F.when(text.is_blank(F.col("title")), "blank_title").when(text.is_blank(F.col("url")), "blank_url"))


def parse_gnews(raw: DataFrame, as_of: Column) -> DataFrame:
    """Envelope payloads -> one row per article with nonblank (trimmed) title and url.

    A missing or non-array ``articles`` yields no rows; an unparsable ``publishedAt`` becomes
    ``as_of``; the domain comes from ``source.url`` when nonblank, else from the article url."""
    a = _gnews_rows(raw, as_of).where("reason is null")
    dom_src = F.when(text.is_blank(F.col("source_url")), F.col("url")).otherwise(F.col("source_url"))
    return _rows(
        a, title=F.col("title"), url=F.col("url"), source=F.lit("gnews"), source_domain=urls.url_domain(dom_src),
        description=F.col("description"), image_url=F.col("image_url"), published_at=F.col("published_at"),
        upvotes=F.lit(0), comments=F.lit(0),
    )


# ---------------------------------------------------------------- listings


def _reddit_rows(raw: DataFrame, min_upvotes: int, min_comments: int) -> DataFrame:
    """All posts of all listings with the first failing check as ``reason``."""
    p = _elements(raw, "$.data.children", "c")
    v = F.col("c")
    p = p.select(
        *[c for c in p.columns if c != "c"],
        text.jtrim(_text(v, "$.data.title")).alias("title"), text.jtrim(_text(v, "$.data.url")).alias("url"),
        _number(v, "$.data.score", "int").alias("score"), _number(v, "$.data.num_comments", "int").alias("num_comments"),
        F.coalesce(F.try_variant_get(v, "$.data.is_self", "boolean"), F.lit(True)).alias("is_self"),
        _number(v, "$.data.created_utc", "bigint").alias("created_utc"), _text(v, "$.data.thumbnail").alias("thumbnail"),
        F.coalesce(F.try_variant_get(v, "$.data.subreddit_name_prefixed", "string"), F.col("endpoint")).alias("subreddit"),
    )
    reason = (
        F.when(F.col("is_self"), "self_post").when(F.col("url").contains("reddit.com"), "internal_link").when(F.col("score") < min_upvotes, "low_score")
        .when(F.col("num_comments") < min_comments, "few_comments").when(text.is_blank(F.col("title")), "blank_title").when(text.is_blank(F.col("url")), "blank_url")
    )
    return p.withColumn("reason", reason)


def parse_reddit(raw: DataFrame, min_upvotes: int = vocab.REDDIT_MIN_UPVOTES, min_comments: int = vocab.REDDIT_MIN_COMMENTS) -> DataFrame:
    """Listing payloads ``(endpoint, payload)`` -> link posts passing the thresholds.

    Numbers may be integers, fractions or strings. Self posts are dropped (a missing ``is_self``
    counts as true), as are urls containing 'reddit.com'. The description names the subreddit (else
    the endpoint label) and the counts."""
    p = _reddit_rows(raw, min_upvotes, min_comments).where("reason is null")
    descr = F.concat(F.col("subreddit"), F.lit(" — "), F.col("score").cast("string"), F.lit(" upvotes, "),
                     F.col("num_comments").cast("string"), F.lit(" comments"))
    return _rows(
        p, title=F.col("title"), url=F.col("url"), source=F.lit("reddit"), source_domain=urls.url_domain(F.col("url")),
        description=descr, image_url=F.when(F.col("thumbnail").startswith("http"), F.col("thumbnail")).otherwise(F.lit("")),
        published_at=epoch_seconds_to_ts(F.col("created_utc")), upvotes=F.col("score"), comments=F.col("num_comments"),
    )


# ---------------------------------------------------------------- feeds


def read_items(raw: DataFrame, atom: bool = False) -> DataFrame:
    """XML documents in column ``item_xml``, one item (or Atom entry) each, as item columns with the ``images`` of foreign
    elements and ``_corrupt_record`` (null unless malformed); other columns are kept. A column ``atom`` tells entries from items."""
    keep = [c for c in raw.columns if c not in ("item_xml", "atom")]

    def rows(some: DataFrame, schema: str) -> DataFrame:
        x = F.from_xml(F.col("item_xml"), schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
        return some.select(*keep, foreign_images(F.col("item_xml")).alias("images"), x.alias("x")).select(*keep, "images", "x.*")

    if "atom" not in raw.columns:
        return atom_to_items(rows(raw, ATOM_ENTRY_SCHEMA)) if atom else rows(raw, RSS_ITEM_SCHEMA)
    return rows(raw.where(~F.col("atom")), RSS_ITEM_SCHEMA).unionByName(atom_to_items(rows(raw.where("atom"), ATOM_ENTRY_SCHEMA)))


def parse_rss(raw: DataFrame, as_of: Column, max_age_hours: int = vocab.RSS_MAX_AGE_HOURS, atom: bool = False) -> DataFrame:
    """XML items ``(feed_url, item_xml)`` -> entries with nonblank title and link, published
    (else updated, else ``as_of``) no earlier than ``as_of - max_age_hours``.

    The domain is the feed's host (the feed url itself when it has none); the description is
    tag-stripped and cut to 500 units + '...'; the image is the first nonblank url of a foreign content or
    thumbnail element, in document order."""
    return parse_rss_rows(read_items(raw.select("feed_url", "item_xml"), atom), as_of, max_age_hours)


def _rss_rows(it: DataFrame, as_of: Column, max_age_hours: int) -> DataFrame:
    """All items with the first failing check as ``reason``."""
    pub = F.coalesce(parse_date(F.col("pubDate")), parse_date(F.col("updated")), as_of)
    it = it.select(
        *[c for c in it.columns if c not in ("title", "link", "pubDate", "updated", "description", "images", "_corrupt_record")],
        text.jtrim(F.coalesce("title", F.lit(""))).alias("title"), text.jtrim(F.coalesce("link", F.lit(""))).alias("url"), pub.alias("published_at"),
        F.when(F.col("description").isNull(), F.lit("")).otherwise(text.strip_truncate(F.col("description"), vocab.RSS_DESCRIPTION_MAX)).alias("description"),
        F.coalesce(F.get(F.filter("images", lambda u: text.not_blank(u)), F.lit(0)), F.lit("")).alias("image_url"),
        F.col("_corrupt_record").isNotNull().alias("malformed"),
    )
    cutoff = F.timestamp_add("HOUR", F.lit(-max_age_hours), as_of)
    return it.withColumn("reason", F.when(F.col("malformed"), "malformed").when(text.is_blank(F.col("title")), "blank_title").when(text.is_blank(F.col("url")), "blank_url")
                         .when(F.col("published_at") < cutoff, "too_old")).drop("malformed")


def parse_rss_rows(it: DataFrame, as_of: Column, max_age_hours: int = vocab.RSS_MAX_AGE_HOURS) -> DataFrame:
    """Same as ``parse_rss`` for items already read into columns (``read_feed_files``)."""
    it = _rss_rows(it, as_of, max_age_hours).where("reason is null")
    return _rows(
        it, title=F.col("title"), url=F.col("url"), source=F.lit("rss"),
        source_domain=urls.url_domain(F.col("feed_url"), fallback_to_url=True), description=F.col("description"),
        image_url=F.col("image_url"), published_at=F.col("published_at"), upvotes=F.lit(0), comments=F.lit(0),
    )


# ---------------------------------------------------------------- union and rejects


def gnews_rejects(raw: DataFrame, as_of: Column) -> DataFrame:
    """Articles that an envelope holds but that yield no row, with a reason; other raw columns are kept."""
    return _gnews_rows(raw, as_of).where("reason is not null").select(*[c for c in raw.columns if c != "payload"], "reason")


def reddit_rejects(raw: DataFrame, min_upvotes: int = vocab.REDDIT_MIN_UPVOTES, min_comments: int = vocab.REDDIT_MIN_COMMENTS) -> DataFrame:
    """Posts that a listing holds but that yield no row, with a reason; other raw columns are kept."""
    return _reddit_rows(raw, min_upvotes, min_comments).where("reason is not null").select(*[c for c in raw.columns if c != "payload"], "reason")


def rss_rejects(it: DataFrame, as_of: Column, max_age_hours: int = vocab.RSS_MAX_AGE_HOURS) -> DataFrame:
    """Items that yield no row, with a reason; other columns are kept."""
    rows = _rss_rows(it, as_of, max_age_hours).where("reason is not null")
    return rows.drop("title", "url", "published_at", "description", "image_url")


def payload_rejects(raw: DataFrame, kind: str) -> DataFrame:
    """Whole payloads that yield nothing, with a reason; other raw columns are kept.

    ``kind``: 'gnews' (malformed | no_articles), 'reddit' (malformed | no_children) or
    'rss' (malformed item XML, column ``item_xml``), 'list' (malformed id list) or 'feed' (a document without items)."""
    keep = [c for c in raw.columns if c not in ("payload", "item_xml")]
    if kind == "rss":
        x = F.from_xml(F.col("item_xml"), RSS_ITEM_SCHEMA)
        bad = F.col("item_xml").isNull() | x.isNull() | (x["title"].isNull() & x["link"].isNull())
        reason = F.when(bad, F.lit("malformed"))
    elif kind == "list":
        reason = F.when(F.from_json(F.col("payload"), "array<bigint>").isNull(), F.lit("malformed"))
    elif kind == "feed":
        reason = F.when(~F.coalesce(F.col("payload").rlike(r"(?s)<(item|entry)[\s>].*</\1\s*>"), F.lit(False)), F.lit("no_items"))
    else:
        v = F.try_parse_json(F.col("payload"))
        path, name = ("$.articles", "no_articles") if kind == "gnews" else ("$.data.children", "no_children")
        reason = F.when(v.isNull(), F.lit("malformed")).when(F.try_variant_get(v, path, "array<variant>").isNull(), F.lit(name))
    return raw.select(*keep, reason.alias("reason")).where(F.col("reason").isNotNull())


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Bag union of parsed sources, with their places where all have them; an absent source contributes nothing."""
    present = [d for d in dfs if d is not None]
    at = ["at"] if all("at" in d.columns for d in present) else []
    present = [d.select(*ARTICLE_COLUMNS, *at) for d in present]
    return reduce(lambda a, b: a.unionByName(b), present)
