"""Bounded, idempotent output tables on immutable files: upsert, trim, memory, run state.

Every function returns a new DataFrame (the next snapshot); ``write_snapshot`` writes it to a new
path, because a parquet path cannot be overwritten while it is being read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.functions import text, urls, vocab

EPOCH_NTZ = "1970-01-01 00:00:00"


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id", order_col: str | None = "seq") -> DataFrame:
    """Set-by-key: the incoming row replaces the whole stored row; within ``incoming`` the last
    row (largest ``order_col``) wins. Plans as a partial WindowGroupLimit + anti join."""
    inc = incoming
    if order_col and order_col in incoming.columns:
        w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
        inc = incoming.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", order_col)
    keys = inc.select(F.col(key).alias("_k")).distinct()
    kept = current.join(keys, current[key] == keys["_k"], "left_anti")
    return kept.unionByName(inc.select(*current.columns))


def trim(df: DataFrame, cap: int = vocab.STORE_CAP, batch: int = vocab.STORE_TRIM_BATCH, key: str = "id") -> DataFrame:
    """If the table holds more than ``cap`` rows, delete exactly ``batch`` oldest by published_at
    (NULL counts as epoch 0; ties by key). The count is a scalar subquery, the oldest rows a
    TakeOrderedAndProject, then an anti join: nothing runs while the plan is built."""
    epoch = F.lit(EPOCH_NTZ).cast("timestamp_ntz")
    full = df.agg(F.count(F.lit(1)) > cap).scalar()
    oldest = df.orderBy(F.coalesce(F.col("published_at"), epoch).asc(), F.col(key).asc()).limit(batch).select(F.col(key).alias("_k"))
    return df.join(oldest.where(full), df[key] == F.col("_k"), "left_anti")


def remember(news: DataFrame, as_of: Column) -> DataFrame:
    """Memory rows for saved articles: storage-normalised URL, lower/trimmed title, time now."""
    return news.select(
        urls.normalize_url_memory(F.col("url")).alias("normalized_url"),
        text.normalize_title(F.col("title")).alias("normalized_title"),
        as_of.alias("ts"),
    )


def expire(mem: DataFrame, as_of: Column, hours: int = vocab.MEMORY_EXPIRE_HOURS) -> DataFrame:
    """Drop memory rows strictly older than ``as_of - hours``."""
    return mem.where(~(F.col("ts") < F.timestamp_add("HOUR", F.lit(-hours), as_of)))


def default_run(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "never", 0)], "t long, last_run_status string, last_article_count int").select(
        F.lit(EPOCH_NTZ).cast("timestamp_ntz").alias("last_fetched_at"), "last_run_status", "last_article_count"
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """Single row: the latest run state, or (epoch, 'never', 0) when there is none.

    NULL or non-positive times read as epoch, NULL status as 'never', NULL count as 0."""
    epoch = F.lit(EPOCH_NTZ).cast("timestamp_ntz")
    r = runs.select(
        F.when(F.col("last_fetched_at") > epoch, F.col("last_fetched_at")).otherwise(epoch).alias("last_fetched_at"),
        F.coalesce("last_run_status", F.lit("never")).alias("last_run_status"),
        F.coalesce("last_article_count", F.lit(0)).alias("last_article_count"),
    )
    allr = r.unionByName(default_run(runs.sparkSession))
    best = allr.agg(
        F.max_by(F.struct("last_fetched_at", "last_run_status", "last_article_count"),
                 F.struct("last_fetched_at", F.when(F.col("last_run_status") == "never", 0).otherwise(1))).alias("s")
    )
    return best.select("s.*")


def run_due(state: DataFrame, as_of: Column, interval_hours: int = vocab.RUN_INTERVAL_HOURS) -> DataFrame:
    """Whole hours since the last run and whether the next run is due."""
    micros = F.timestamp_diff("MICROSECOND", F.col("last_fetched_at"), as_of)
    hours = F.when(micros >= 0, F.floor(micros / F.lit(3_600_000_000))).otherwise(F.ceil(micros / F.lit(3_600_000_000))).cast("long")
    return state.select("last_fetched_at", "last_run_status", hours.alias("hours_elapsed"), (hours >= interval_hours).alias("due"))


def run_outcome(counts: DataFrame, as_of: Column) -> DataFrame:
    """State row written at the end of a run from the stage counts ``(stage, n)``."""
    c = counts.groupBy().pivot("stage", ["fetched", "unique", "selected", "saved"]).agg(F.first("n"))
    fetched = F.coalesce(F.col("fetched"), F.lit(0))
    saved = F.coalesce(F.col("saved"), F.lit(0))
    status = (
        F.when(fetched == 0, F.lit("failed: No articles fetched from any source"))
        .when(saved == 0, F.lit("failed: 0 articles saved"))
        .otherwise(F.lit("success"))
    )
    return c.select(
        as_of.alias("last_fetched_at"),
        status.alias("last_run_status"),
        F.when((fetched > 0) & (saved > 0), saved).otherwise(F.lit(0)).cast("int").alias("last_article_count"),
        F.when(fetched == 0, F.lit(-1)).when(saved == 0, F.lit(-1)).otherwise(saved).cast("int").alias("result"),
    )


def append_run(runs: DataFrame, row: DataFrame) -> DataFrame:
    """Run-state history with one more row (the latest row is the state)."""
    return runs.unionByName(row.select(*runs.columns))


def write_snapshot(df: DataFrame, base: str) -> str:
    """Write ``df`` to a fresh snapshot folder under ``base`` and return its path."""
    path = f"{base.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return path
