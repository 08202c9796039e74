"""All sources read from one landing folder, as a batch job would.

Layout (any number of files per folder):

    <landing>/hn/items/        JSON lines, one item document per line
    <landing>/hn/lists/        JSON lines, one id array per line, in a folder for each list
    <landing>/gnews/           JSON lines, one headline envelope per line
    <landing>/reddit/endpoint=<label>/   JSON lines, one listing per line (label URL-encoded)
    <landing>/rss/feed=<feed url>/       feed documents (XML, <item> rows; feed url URL-encoded), one in each file

``read_sources`` parses everything into one article table with an ``seq`` order key. Payloads are written once to the
shared folder, so that a file which can't be read fails alone, and each has a place that stays the same.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.session import cut_lineage
from curata.sources import feeds, landing

SOURCE_RANK = {"hackernews": 0, "gnews": 1, "reddit": 2, "rss": 3}
REJECT_COLUMNS = ["source", "file", "reason"]


def present(read):
    """What ``read()`` returns, or None where its path does not exist (any other error is raised)."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


_UNREADABLE = re.compile(r"while reading file (.+?)\.\s+SQLSTATE")


def _isolated(spark: SparkSession, source: str, path: str, read) -> tuple[DataFrame | None, list[tuple]]:
    """``read(paths)`` written as a table, without the files that can't be read, and a reject for each of these.

    A file fails alone: when one stops the job, it is left out and the others are read again (one more pass for each such
    file). Any other failure ends its source, not the run. None where nothing is left or the path does not exist."""
    paths, rejects = path, []
    while True:
        try:
            return cut_lineage(read(paths)), rejects
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None, rejects
            return None, [*rejects, (source, path, f"failed: {str(e).splitlines()[0]}")]
        except Exception as e:  # noqa: BLE001 - whatever is wrong with one source must not end the run
            found = _UNREADABLE.search(str(e))
            if found is None:
                return None, [*rejects, (source, path, f"failed: {str(e).splitlines()[0]}")]
            if paths is path:
                paths = [unquote(f) for f in spark.read.text(path).inputFiles()]  # the list that the reader holds anyway
            bad = next((f for f in paths if _same_file(f, found[1])), None)
            if bad is None:
                return None, [*rejects, (source, path, f"failed: {found[0]}")]
            rejects.append((source, bad, "unreadable"))
            paths = [f for f in paths if f != bad]
            if not paths:
                return None, rejects


def _same_file(path: str, named: str) -> bool:
    """Whether an error names ``path``, as it is or as a URI."""
    plain = lambda x: re.sub("^[a-z0-9]+:/+", "/", x)
    return plain(path) in (plain(named), unquote(plain(named)))


def read_raw(spark: SparkSession, root: str) -> tuple[dict, list[tuple]]:
    """Landed payloads by source, written once (None for an absent source), and rejects of what can't be read."""
    rejects: list[tuple] = []

    def one(source: str, path: str, read):
        df, bad = _isolated(spark, source, path, read)
        rejects.extend(bad)
        return df

    lines = lambda p: feeds.read_landed(spark, p)
    listing = lambda p: lines(p).withColumn("endpoint", feeds.label_from_path(F.col("file")))
    feed = lambda p: feeds.read_landed(spark, p, whole=True).withColumn("feed_url", feeds.label_from_path(F.col("file"), "feed"))
    raw = {"lists": one("hackernews", f"{root}/hn/lists/*", lines), "items": one("hackernews", f"{root}/hn/items", lines),
           "gnews": one("gnews", f"{root}/gnews", lines), "reddit": one("reddit", f"{root}/reddit/*", listing), "rss": one("rss", f"{root}/rss/*", feed)}
    return raw, rejects


def order_key(arts: DataFrame) -> DataFrame:
    """``seq``, a number in the order of source, file, payload and place in the payload; equal rows stay apart.

    The sort is distributed (by ranges); the numbers grow with it and have gaps."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv]), F.col("source"))
    placed = arts.withColumn("_rank", rank).orderBy("_rank", "at", "url")
    return placed.withColumn("seq", F.monotonically_increasing_id()).drop("_rank", "at")


def articles_of(spark: SparkSession, raw: dict, as_of: Column) -> DataFrame:
    """Parsed articles of every present source with an order key ``seq``; without any source an empty table."""
    parts = []
    if raw["items"] is not None and raw["lists"] is not None:
        lists = raw["lists"].withColumnRenamed("file", "list_id")
        parts.append(feeds.hn_top_stories(lists, raw["items"]).drop("list_id", "pos", "id"))
    if raw["gnews"] is not None:
        parts.append(feeds.parse_gnews(raw["gnews"], as_of))
    if raw["reddit"] is not None:
        parts.append(feeds.parse_reddit(raw["reddit"]))
    if raw["rss"] is not None:
        parts.append(feeds.parse_rss_rows(feeds.read_items(feeds.feed_items(raw["rss"])), as_of))
    if not parts:
        kinds = {"published_at": "timestamp_ntz", "upvotes": "int", "comments": "int"}
        schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in feeds.ARTICLE_COLUMNS)
        return spark.createDataFrame([], f"{schema}, seq bigint")
    return order_key(feeds.union_sources(*parts))


def rejects_of(spark: SparkSession, raw: dict, as_of: Column, unread: list[tuple] = ()) -> DataFrame:
    """Columns source, file, reason: what the sources landed but no article came of: files, payloads and single records."""
    parts = [spark.createDataFrame(list(unread), "source string, file string, reason string")]

    def add(source: str, rows: DataFrame):
        parts.append(rows.select(F.lit(source).alias("source"), "file", "reason"))

    if raw["lists"] is not None:
        add("hackernews", feeds.payload_rejects(raw["lists"], "list"))
    if raw["items"] is not None:
        add("hackernews", feeds.hn_rejects(raw["items"]))
    if raw["gnews"] is not None:
        add("gnews", feeds.payload_rejects(raw["gnews"], "gnews"))
        add("gnews", feeds.gnews_rejects(raw["gnews"], as_of))
    if raw["reddit"] is not None:
        add("reddit", feeds.payload_rejects(raw["reddit"], "reddit"))
        add("reddit", feeds.reddit_rejects(raw["reddit"]))
    if raw["rss"] is not None:
        add("rss", feeds.payload_rejects(raw["rss"], "feed"))
        add("rss", feeds.rss_rejects(feeds.read_items(feeds.feed_items(raw["rss"])), as_of))
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_sources(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    """Parsed articles of a landing folder (see :func:`articles_of`)."""
    return articles_of(spark, read_raw(spark, root)[0], as_of)


def read_rejects(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    """Rejects of a landing folder (see :func:`rejects_of`)."""
    raw, unread = read_raw(spark, root)
    return rejects_of(spark, raw, as_of, unread)


def land_fixture(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Write the fixture payloads (``sources/landing.py``) into the landing layout (tests)."""
    landing.hn_item_payloads(spark, sf_dir).select("payload").write.text(f"{root}/hn/items")
    lists = landing.hn_id_lists(spark, sf_dir)
    lists.select("list_id", "payload").write.partitionBy("list_id").text(f"{root}/hn/lists")  # one folder per list
    landing.gnews_envelopes(spark, sf_dir).select("payload").write.text(f"{root}/gnews")
    rd = landing.reddit_listings(spark, sf_dir)
    rd.select("endpoint", "payload").write.partitionBy("endpoint").text(f"{root}/reddit")
    rss = landing.rss_items(spark, sf_dir)
    docs = rss.groupBy("feed_url", (F.col("seq") / 50).cast("long").alias("chunk")).agg(
        F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(F.col("item_xml")), ""), F.lit("</channel></rss>")).alias("value")
    )
    # a file is read whole by one task: a file for each document, however many documents a task writes
    docs.select(F.col("feed_url").alias("feed"), "value").write.option("maxRecordsPerFile", 1).partitionBy("feed").text(f"{root}/rss")
