"""Registered streaming queries (rows-only checks: a run depends on the runs before it, which SQL can't state)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.plans.catalog import register
from curata.session import checkpoint_dir
from curata.sources import fixtures as FX
from curata.streaming import stream

#: The run of rows without a date: the last hour before the fixed clock.
LAST_RUN = 2024013023


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def daily_run(published_at: Column) -> Column:
    """Run id of the last hour of the publication day."""
    day = F.date_format(published_at, "yyyyMMdd")
    return F.coalesce(F.concat(day, F.lit("23")).cast("bigint"), F.lit(LAST_RUN).cast("bigint"))


@register("stream_pipeline")
def q_stream_pipeline(spark, sf):
    """Pages landed per publication day, replayed as one run a day; returns the resulting store."""
    base = _scratch(spark, "stream-pipeline")
    arts = FX.articles_pages(spark, sf)
    stream.land_runs(arts, f"{base}/landing", daily_run(F.col("published_at")))
    stream.stream_pipeline(spark, f"{base}/landing", f"{base}/tables", f"{base}/ckpt", arts.schema, seed_memory=FX.memory_fixture(spark, sf))
    return stream.current_store(spark, f"{base}/tables")


@register("stream_url_dedup")
def q_stream_url_dedup(spark, sf):
    base = _scratch(spark, "stream-url")
    arts = FX.articles_pages(spark, sf)
    arts.write.parquet(f"{base}/landing")
    out = stream.stream_url_dedup(spark, f"{base}/landing", f"{base}/sink", f"{base}/ckpt", arts.schema)
    return out.select("seq", "url", "normalized_url", "published_at", "status")


@register("job_landed_run")
def q_job_landed_run(spark, sf):
    """Source payloads landed as files, then one batch-job run; returns the current store."""
    from curata.plans.job import run_job
    from curata.sources.landed import land_fixture

    base = _scratch(spark, "job")
    land_fixture(spark, sf, f"{base}/landing")
    return run_job(spark, f"{base}/landing", f"{base}/tables", FX.as_of(), LAST_RUN)
