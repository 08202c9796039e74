"""Physical plan shape: the operators compile to the plans the design relies on."""

from pyspark.sql import functions as F

from curata.operators import dedup, rank
from curata.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_domain_cap_uses_window_group_limit(spark):
    s = rank.score(FX.articles_pages(spark, SF), FX.as_of())
    p = rank.cap_per_domain(s)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in p


def test_top_n_is_take_ordered(spark):
    s = rank.score(FX.articles_pages(spark, SF), FX.as_of())
    p = s.orderBy(*rank.score_order()).limit(30)._jdf.queryExecution().sparkPlan().toString()
    assert "TakeOrderedAndProject" in p


def test_source_score_is_broadcast(spark):
    p = plan(rank.with_source_score(FX.articles_pages(spark, SF)))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_similarity_join_has_no_cartesian_product(spark):
    sim = dedup.similar_pairs(FX.articles_documents(spark, SF))
    p = sim["edges"]._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_memory_window_pushes_filter(spark, tmp_path):
    path = str(tmp_path / "mem")
    FX.memory_fixture(spark, SF).write.parquet(path)
    p = plan(dedup.memory_window(spark.read.parquet(path), FX.as_of()))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in p


def test_pages_scan_prunes_columns(spark):
    p = plan(FX.articles_pages(spark, SF).select("seq", "url"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p


def test_sql_views(spark):
    from curata.plans.views import register_views

    names = register_views(spark, SF)
    assert "ranked" in names
    n = spark.sql("SELECT count(*) AS n FROM ranked").first()["n"]
    assert 0 < n <= 30
