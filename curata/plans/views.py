"""SQL entry point: the fixture views and the main operator outputs as temporary views.

    from curata.plans.views import register_views
    register_views(spark, "/root/testdata/sf0.01")
    spark.sql("SELECT source_domain, count(*) FROM ranked GROUP BY 1")

Views are lazy; each ``spark.sql`` over them is planned by Catalyst together with the operator
plan underneath.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from curata.operators import dedup, rank, summarize
from curata.sources import fixtures as FX


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    pages = FX.articles_pages(spark, sf_dir)
    mem = FX.memory_fixture(spark, sf_dir)
    views = {
        "articles_pages": pages,
        "articles_documents": FX.articles_documents(spark, sf_dir),
        "memory_fixture": mem,
        "responses_fixture": FX.responses_fixture(spark, sf_dir),
        "runs_fixture": FX.runs_fixture(spark, sf_dir),
        "url_deduped": dedup.dedup_url(pages),
        "scored": rank.score(dedup.dedup_url(pages), FX.as_of()),
        "ranked": rank.rank(dedup.dedup_url(pages), FX.as_of()),
        "prompts": summarize.prompts(pages),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
