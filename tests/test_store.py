"""Table upkeep edges: trim at 150/151, ties, upsert order, memory expiry, run state."""

import datetime as dt

from pyspark.sql import functions as F

from curata.operators import store

def AS():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def _news(spark, n):
    rows = [(f"id{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, published_at timestamp_ntz")


def test_trim_boundaries(spark):
    assert store.trim(_news(spark, 150)).count() == 150
    t = store.trim(_news(spark, 151))
    assert t.count() == 101
    # equal published_at: ties broken by id, exactly 50 removed
    assert sorted(r["id"] for r in t.collect())[0] == "id050"


def test_upsert_last_write_wins(spark):
    cur = spark.createDataFrame([("a", "old"), ("b", "keep")], "id string, summary string")
    inc = spark.createDataFrame([("a", "first", 1), ("a", "second", 2), ("c", "new", 3)], "id string, summary string, seq long")
    out = {r["id"]: r["summary"] for r in store.upsert(cur, inc).collect()}
    assert out == {"a": "second", "b": "keep", "c": "new"}


def test_memory_expire_at_48h(spark):
    mem = spark.createDataFrame(
        [("u1", "t", dt.datetime(2024, 1, 29, 0, 0)), ("u2", "t", dt.datetime(2024, 1, 28, 23, 59, 59))],
        "normalized_url string, normalized_title string, ts timestamp_ntz",
    )
    assert [r["normalized_url"] for r in store.expire(mem, AS()).collect()] == ["u1"]


def test_latest_run_defaults_and_due(spark):
    empty = spark.createDataFrame([], "last_fetched_at timestamp_ntz, last_run_status string, last_article_count int")
    s = store.latest_run(empty).first()
    assert (s["last_fetched_at"], s["last_run_status"], s["last_article_count"]) == (dt.datetime(1970, 1, 1), "never", 0)
    runs = spark.createDataFrame(
        [(dt.datetime(2024, 1, 30, 23, 1), "success", 30), (dt.datetime(2024, 1, 30, 22, 0), "failed: x", 0)],
        "last_fetched_at timestamp_ntz, last_run_status string, last_article_count int",
    )
    d = store.run_due(store.latest_run(runs), AS()).first()
    assert d["last_run_status"] == "success" and d["hours_elapsed"] == 0 and d["due"] is False


def test_run_outcome(spark):
    counts = spark.createDataFrame([("fetched", 10), ("unique", 5), ("selected", 5), ("saved", 0)], "stage string, n long")
    o = store.run_outcome(counts, AS()).first()
    assert o["last_run_status"] == "failed: 0 articles saved" and o["result"] == -1
    counts = spark.createDataFrame([("fetched", 0)], "stage string, n long")
    assert store.run_outcome(counts, AS()).first()["last_run_status"] == "failed: No articles fetched from any source"


def test_snapshot_round_trip(spark, tmp_path):
    cur = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, summary string")
    inc = spark.createDataFrame([("a", "z", 1)], "id string, summary string, seq long")
    path = store.write_snapshot(store.upsert(cur, inc), str(tmp_path))
    back = {r["id"]: r["summary"] for r in spark.read.parquet(path).collect()}
    assert back == {"a": "z", "b": "y"}
    path2 = store.write_snapshot(store.upsert(spark.read.parquet(path), inc), str(tmp_path))  # read one, write another
    assert path2 != path and spark.read.parquet(path2).count() == 2
