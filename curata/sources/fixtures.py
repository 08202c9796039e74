"""Article-shaped views derived from the driver tables (see FIXTURES.md).

Every view is a lazy DataFrame over the parquet tables, so its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import text, urls, vocab

# Fixed clock used by every query, so results are deterministic.
AS_OF_TEXT = "2024-01-31 00:00:00"

# Domain assigned to page_id % 25: the twenty scored domains in vocabulary order, then five
# unscored cases (subdomain of a scored one, upper case, empty, unlisted, NULL).
FIXTURE_DOMAINS = [d for d, _ in vocab.SOURCE_SCORES] + [
    "feeds.arstechnica.com", "TechCrunch.com", "", "unlisted.example.com", None,
]


def as_of() -> F.Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user (= page): clicks + views, purchases and the latest event time.

    A plain aggregate: partial (map-side) aggregation happens before the shuffle, so a user with
    a third of all events still costs one row per partition.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return ev.groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0)).cast("int").alias("upvotes"),
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("int").alias("comments"),
        F.max("ts").alias("published_at"),
    )


def articles_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, title, url, source, source_domain, description (the whole article), published_at, upvotes, comments."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    eng = page_engagement(spark, sf_dir)
    domains = F.array(*[F.lit(d).cast("string") for d in FIXTURE_DOMAINS])
    joined = pages.join(eng, pages.page_id == eng.user_id, "left")
    return joined.select(
        F.col("page_id").alias("seq"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.col("url"),
        F.lit("web").alias("source"),
        F.element_at(domains, (F.col("page_id") % 25 + 1).cast("int")).alias("source_domain"),
        F.regexp_extract("html", "(?s)<article>(.*?)(?:</article>|$)", 1).alias("description"),
        F.col("published_at"),
        F.coalesce(F.col("upvotes"), F.lit(0)).alias("upvotes"),
        F.coalesce(F.col("comments"), F.lit(0)).alias("comments"),
    )


def articles_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, title: the first sentence of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.trim(F.regexp_extract("text", "^([^.!?\\n]*)", 1)).alias("title"),
    )


def texts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, title: every document's whole text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("title"))


def memory_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedup memory rows of all pages as the storage side writes them, aged 0..71 hours before AS_OF: a third within the window."""
    a = articles_pages(spark, sf_dir).select("seq", "url", "title")
    return a.select(
        urls.normalize_url_memory(F.col("url")).alias("normalized_url"),
        text.normalize_title(F.col("title")).alias("normalized_title"),
        F.timestamp_add("HOUR", -(F.col("seq") % 72), as_of()).alias("ts"),
    )


def runs_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-state history derived from the events table: one row per event day.

    Status cycles through running / success / failed by day; the latest row is the last day.
    """
    ev = table(spark, sf_dir, "events").select("ts", "event_type")
    day = F.date_trunc("DAY", F.col("ts")).cast("timestamp_ntz")
    daily = ev.groupBy(day.alias("day")).agg(
        F.max("ts").alias("last_fetched_at"),
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("int").alias("n"),
    )
    k = F.dayofmonth("day") % 3
    return daily.select(
        F.col("last_fetched_at"),
        F.when(k == 0, F.lit("success")).when(k == 1, F.lit("running")).otherwise(F.lit("failed: 0 articles saved")).alias(
            "last_run_status"
        ),
        F.when(k == 0, F.col("n")).otherwise(F.lit(0)).alias("last_article_count"),
    )


# Snapshot boundaries for the upsert fixture: the stored table holds pages published before
# CURRENT_BEFORE (or never), the incoming batch those published from INCOMING_FROM on; the
# overlap is overwritten.
CURRENT_BEFORE = "2024-01-30 18:00:00"
INCOMING_FROM = "2024-01-30 12:00:00"


def news_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published-record projection of every page (``seq`` kept for arrival order)."""
    from curata.functions import scoring

    a = articles_pages(spark, sf_dir)
    return a.select(
        "seq",
        urls.article_id(urls.normalize_url(F.col("url"))).alias("id"),
        "title",
        F.col("title").alias("summary"),
        "source",
        "source_domain",
        "url",
        F.lit(None).cast("string").alias("image_url"),
        "published_at",
        as_of().alias("created_at"),
        F.col("upvotes").cast("double").alias("score"),
        scoring.derive_tags(F.col("title"), F.col("description"), F.col("source")).alias("tags"),
    )


def news_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = news_rows(spark, sf_dir)
    n = n.where(F.col("published_at").isNull() | (F.col("published_at") < F.lit(CURRENT_BEFORE).cast("timestamp_ntz")))
    n = n.withColumn("created_at", F.timestamp_add("DAY", F.lit(-1), as_of()))
    # the stored table has one row per id already
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return n.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "seq")


def news_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = news_rows(spark, sf_dir).where(F.col("published_at") >= F.lit(INCOMING_FROM).cast("timestamp_ntz"))
    return n.withColumn("summary", F.concat(F.lit("v2: "), F.col("title")))


def responses_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, seq, attempt, try_no, payload)``: every assistant turn of ``conversations`` as a service answer.

    Page ``seq`` takes conversation ``seq``; its turns answer attempt 1 and 2 by turns, in the order of
    ``try_no``. The first answer of every fifth page is blank or malformed.
    """
    from curata.operators.summarize import response_payload

    a = articles_pages(spark, sf_dir).select("seq", "url")
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    j = a.join(conv, a.seq == conv.conv_id)
    attempt = F.when(F.floor(F.col("turn") / 2) % 2 == 0, 1).otherwise(2)
    first = F.col("turn") < 3
    payload = (
        F.when(first & (F.col("seq") % 10 == 0), response_payload(F.lit("")))
        .when(first & (F.col("seq") % 10 == 5), F.lit('{"candidates":['))
        .otherwise(response_payload(F.col("text")))
    )
    return j.select(urls.article_id(urls.normalize_url(F.col("url"))).alias("id"), "seq", attempt.alias("attempt"), F.col("turn").alias("try_no"), payload.alias("payload"))
