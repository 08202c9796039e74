"""The hourly run as a batch job over a landing folder.

    run_job(spark, "/landing/2024-01-31T00", "/tables", as_of=F.lit(...), run_id=2024013023)

The check comes first: the store is trimmed, and a run that is not yet due does nothing else
(``force`` runs anyway). A run reads every source, deduplicates against memory, ranks, summarises (with a text
``provider``, if one is given), and commits its tables together (see ``streaming.stream``). Returns the current store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from curata.sources.landed import articles_of, read_raw, rejects_of
from curata.streaming import stream


def run_job(spark: SparkSession, landing: str, tables: str, as_of: Column, run_id: int, force: bool = False, provider=None) -> DataFrame:
    def run() -> None:
        raw, unread = read_raw(spark, landing)
        stream.process_run(articles_of(spark, raw, as_of), run_id, tables, as_of, rejects=rejects_of(spark, raw, as_of, unread), provider=provider)

    if force:
        run()
    else:
        stream.check_and_run(spark, tables, run_id, as_of, run)
    return stream.current_store(spark, tables)
