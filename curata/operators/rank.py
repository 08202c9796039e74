"""Scoring, per-domain diversity cap and global top-N.

Plan shape (checked with ``explain``): the per-domain cap compiles to a partial
``WindowGroupLimit`` before the shuffle, so a domain holding a third of all rows still ships at
most ``k`` rows per input partition; the global top-N is a ``TakeOrderedAndProject`` (top-k per
partition, then a merge of ``n`` rows per partition), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.functions import scoring, vocab
from curata.functions.text import is_blank

SCORE_COLUMNS = [
    "recency_score", "source_score", "engagement_score", "title_quality_score", "keyword_boost", "final_score",
]


def source_score_table(spark: SparkSession) -> DataFrame:
    """The fixed 20-row domain -> score dictionary."""
    return spark.createDataFrame(vocab.SOURCE_SCORES, "score_domain string, domain_score double")


def with_source_score(df: DataFrame, scores: DataFrame | None = None, default: float = vocab.DEFAULT_SOURCE_SCORE) -> DataFrame:
    """Exact lookup of lower(source_domain); blank or unknown domains score ``default``.

    The fixed dictionary has 20 rows, a proven bound, so it is broadcast explicitly. A caller's
    own table is joined without a hint: AQE turns it into a broadcast join only when its measured
    size is under ``spark.sql.autoBroadcastJoinThreshold`` and keeps a shuffle join otherwise.
    """
    if scores is None:
        scores = F.broadcast(source_score_table(df.sparkSession))
    key = F.lower(F.col("source_domain"))
    joined = df.join(scores, key == F.col("score_domain"), "left")
    score = F.when(is_blank(F.col("source_domain")), F.lit(default)).otherwise(F.coalesce(F.col("domain_score"), F.lit(default)))
    return joined.withColumn("source_score", score).drop("score_domain", "domain_score")


def score(df: DataFrame, as_of: Column, scores: DataFrame | None = None) -> DataFrame:
    """Add the five factor scores, the weighted final score (rounded to 9 decimals) and tags."""
    if "description" not in df.columns:
        df = df.withColumn("description", F.lit(None).cast("string"))
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(None).cast("string"))
    out = with_source_score(df, scores)
    out = (
        out.withColumn("recency_score", scoring.recency_score(F.col("published_at"), as_of))
        .withColumn("engagement_score", scoring.engagement_score(F.col("upvotes"), F.col("comments")))
        .withColumn("title_quality_score", scoring.title_quality_score(F.col("title")))
        .withColumn("keyword_boost", scoring.keyword_boost(F.col("title"), F.col("description")))
    )
    out = out.withColumn(
        "final_score",
        scoring.final_score(
            F.col("recency_score"), F.col("source_score"), F.col("engagement_score"),
            F.col("title_quality_score"), F.col("keyword_boost"),
        ),
    )
    for c in SCORE_COLUMNS:
        out = out.withColumn(c, scoring.rounded(F.col(c)))
    return out.withColumn("tags", scoring.derive_tags(F.col("title"), F.col("description"), F.col("source")))


def score_order() -> list[Column]:
    """Score descending; ties keep arrival order (``seq``)."""
    return [F.col("final_score").desc(), F.col("seq").asc()]


def cap_per_domain(df: DataFrame, k: int = vocab.MAX_PER_DOMAIN) -> DataFrame:
    """First ``k`` rows per domain in score order; NULL domain groups with the literal 'unknown'."""
    group = F.coalesce(F.col("source_domain"), F.lit("unknown"))
    w = Window.partitionBy(group).orderBy(*score_order())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def top_n(df: DataFrame, n: int = vocab.TOP_N) -> DataFrame:
    """Global top ``n`` in score order plus its 1-based ``rank``.

    ``limit`` after ``orderBy`` plans as TakeOrderedAndProject; the rank window then runs over
    at most ``n`` rows.
    """
    top = df.orderBy(*score_order()).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*score_order())))


def rank(df: DataFrame, as_of: Column, top: int = vocab.TOP_N, per_domain: int = vocab.MAX_PER_DOMAIN,
         scores: DataFrame | None = None) -> DataFrame:
    """Score -> diversity cap -> top N."""
    return top_n(cap_per_domain(score(df, as_of, scores), per_domain), top)
