"""One pipeline run as a lazy DataFrame DAG: dedup -> rank -> summaries -> news -> tables.

``run_batch`` returns every intermediate and output table; nothing is collected. The selected
top-N set is small (N rows) and feeds several sinks, so it is materialised once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import summary, vocab
from curata.operators import dedup, rank, store, summarize
from curata.session import cut_counted


def run_batch(articles: DataFrame, memory: DataFrame, responses: DataFrame | None, as_of: Column,
              current_news: DataFrame | None = None, top: int = vocab.TOP_N, per_domain: int = vocab.MAX_PER_DOMAIN,
              threshold: float = vocab.SIMILARITY_THRESHOLD, fetched: int | None = None, respond=None) -> dict:
    """Intermediate and output tables of a run; ``respond`` makes responses for the selected articles, ``fetched`` is
    the number of articles where it is known. Stage counts are observed in the passes that write the stages."""
    spark = articles.sparkSession
    # read by the ranking and by the tables: materialised once, not deduplicated again
    unique, n_unique = cut_counted(dedup.deduplicate(articles, memory, as_of, threshold))
    # at most ``top`` rows, feeding news, counts and memory: materialised once (checkpoint folder)
    selected, n_selected = cut_counted(rank.rank(unique, as_of, top, per_domain))
    if respond is not None:
        responses = respond(selected)
    if responses is not None:
        summarized = summarize.resolve_summaries(selected, responses)
    else:
        summarized = summarize.with_id(selected).withColumn(
            "summary", summary.fallback_summary(F.col("title"), F.col("description"))
        )
    news = summarize.to_news(summarized, as_of)
    if fetched is None:
        first = articles.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fetched").alias("stage"), "n")
    else:
        first = spark.createDataFrame([("fetched", fetched)], "stage string, n long")
    counts = (
        first.unionByName(spark.createDataFrame([("unique", n_unique), ("selected", n_selected)], "stage string, n long"))
        .unionByName(news.agg(F.countDistinct("id").alias("n")).select(F.lit("saved").alias("stage"), "n"))
    )
    out = {"unique": unique, "selected": selected, "news": news, "counts": counts,
           "memory_rows": store.remember(news, as_of)}
    if current_news is not None:
        out["store"] = store.trim(store.upsert(current_news, news, order_col=None))
    return out
