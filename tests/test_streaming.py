"""Runs: equal tables however a run is landed, bounded tables, outcomes, replays; URL dedup without losses."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from curata.plans.q_runs import block_run
from curata.plans.q_stream import daily_run
from curata.session import checkpoint_dir
from curata.sources import fixtures as FX
from curata.streaming import stream

SF = "/root/testdata/sf0.001"


def _base(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def _tables(spark, base):
    return {n: _rows(stream.read_table(spark, base, n), *c) for n, c in
            {"news_log": ("run_id", "id", "title", "score"), "store": ("run_id", "id"), "memory": ("run_id", "normalized_url", "ts"),
             "runs": ("run_id", "last_run_status", "last_article_count")}.items()}


def test_files_do_not_decide_the_result(spark):
    arts = FX.articles_pages(spark, SF)
    got = []
    for files in (1, 3):
        base = _base(spark)
        stream.land_runs(arts, f"{base}/landing", daily_run(F.col("published_at")), files)
        stream.stream_pipeline(spark, f"{base}/landing", f"{base}/tables", f"{base}/ckpt", arts.schema)
        got.append(_tables(spark, f"{base}/tables"))
    assert got[0] == got[1] and len(got[0]["runs"]) > 1
    base = _base(spark)  # the same runs, one call each, in order
    landed = arts.withColumn("run", daily_run(F.col("published_at")))
    for run_id in sorted(r["run"] for r in landed.select("run").distinct().collect()):
        stream.process_run(landed.where(F.col("run") == run_id).drop("run"), run_id, base, stream.run_clock(run_id))
    assert _tables(spark, base) == got[0]


def test_late_rows_of_an_earlier_run_reach_all_later_tables(spark):
    arts = FX.articles_pages(spark, SF)
    keyed = arts.withColumn("run", block_run(F.col("published_at")))
    runs = sorted(r["run"] for r in keyed.select("run").distinct().collect())
    assert len(runs) > 2
    whole, parts = _base(spark), _base(spark)
    stream.land_runs(arts, f"{whole}/landing", block_run(F.col("published_at")))
    stream.stream_pipeline(spark, f"{whole}/landing", f"{whole}/tables", f"{whole}/ckpt", arts.schema)
    late = (F.col("run") == runs[0]) & (F.col("seq") % 2 == 0)
    for rows in (keyed.where(~late), keyed.where(late)):  # half of the first run's rows land when all others are done
        rows.write.mode("append").partitionBy("run").parquet(f"{parts}/landing")
        stream.stream_pipeline(spark, f"{parts}/landing", f"{parts}/tables", f"{parts}/ckpt", arts.schema)
    assert _tables(spark, f"{parts}/tables") == _tables(spark, f"{whole}/tables")
    commits = stream.manifest(spark, f"{parts}/tables").count()
    assert stream.refresh(spark, f"{parts}/landing", f"{parts}/tables", arts.schema, runs[0]) == []  # landed twice: nothing to do
    assert stream.manifest(spark, f"{parts}/tables").count() == commits


def test_later_runs_stay_when_an_earlier_one_leaves_what_it_left_before(spark):
    base = _base(spark)
    runs = [2024011010, 2024011011]
    for k, run_id in enumerate(runs):
        _articles(spark, 40, run_id, 40 * k).withColumn("run", F.lit(run_id)).write.mode("append").partitionBy("run").parquet(f"{base}/landing")
    schema = _articles(spark, 1, runs[0]).schema
    assert stream.refresh(spark, f"{base}/landing", f"{base}/tables", schema, 0) == runs
    # a copy of a row that was fetched already changes the input of the first run, not what it leaves
    _articles(spark, 1, runs[0]).withColumn("seq", F.lit(9999).cast("long")).withColumn("run", F.lit(runs[0])).write.mode("append").partitionBy("run").parquet(f"{base}/landing")
    assert stream.refresh(spark, f"{base}/landing", f"{base}/tables", schema, runs[0]) == runs[:1]


def test_an_error_between_any_two_writes_shows_whole_runs_only(spark, monkeypatch):
    first, second = 2024011010, 2024011011
    base = _base(spark)
    stream.process_run(_articles(spark, 40, first), first, base, stream.run_clock(first))
    before = {k: v for k, v in _tables(spark, base).items() if k != "runs"}
    write, commit = stream._write, stream._commit

    for n in range(6):
        left = [n]

        def fails(left=left):
            left[0] -= 1
            if left[0] == -1:
                raise OSError(f"disk full at write {n}")

        monkeypatch.setattr(stream, "_write", lambda *a, **k: (fails(), write(*a, **k))[1])
        monkeypatch.setattr(stream, "_commit", lambda *a, **k: (fails(), commit(*a, **k))[1])
        with pytest.raises(OSError, match="disk full"):
            stream.process_run(_articles(spark, 40, second, 20), second, base, stream.run_clock(second))
        monkeypatch.undo()
        assert {k: v for k, v in _tables(spark, base).items() if k != "runs"} == before
        assert stream.current_state(spark, base).first()["last_run_status"] == f"failed: disk full at write {n}"
    stream.process_run(_articles(spark, 40, second, 20), second, base, stream.run_clock(second))
    alone = _base(spark)
    for run_id, offset in ((first, 0), (second, 20)):
        stream.process_run(_articles(spark, 40, run_id, offset), run_id, alone, stream.run_clock(run_id))
    assert _tables(spark, base) == _tables(spark, alone)


def test_marks_that_cannot_be_written_or_read_end_nothing(spark, monkeypatch, tmp_path):
    base, run_id = str(tmp_path), 2024011010
    clock = stream.run_clock(run_id)
    (tmp_path / "tables" / "manifest" / "commit=1").mkdir(parents=True)
    (tmp_path / "tables" / "manifest" / "commit=1" / "part-0.parquet").write_bytes(b"no table")
    with pytest.warns(UserWarning, match="counts as due"):
        ran = []
        assert stream.check_and_run(spark, f"{base}/tables", run_id, clock, lambda: ran.append(1)) and ran == [1]
    base = _base(spark)
    stream.process_run(_articles(spark, 40, run_id), run_id, base, clock)
    monkeypatch.setattr(stream.store, "trim", lambda df: 1 / 0)
    with pytest.warns(UserWarning, match="could not be trimmed"):
        assert not stream.check_and_run(spark, base, run_id, clock, lambda: None)
    monkeypatch.undo()
    state = stream._state
    monkeypatch.setattr(stream, "_state", lambda spark, as_of, status, n: 1 / 0 if status == "running" else state(spark, as_of, status, n))
    with pytest.warns(UserWarning, match="marked as running"):
        stream.process_run(_articles(spark, 40, run_id), run_id, base, clock)
    assert stream.current_state(spark, base).first()["last_run_status"] == "success"


def test_a_run_that_never_ended_is_running(spark):
    base, first, second = _base(spark), 2024011010, 2024011011
    stream.process_run(_articles(spark, 40, first), first, base, stream.run_clock(first))
    stream._mark_running(spark, base, second, "dead", stream.run_clock(second))
    assert stream.current_state(spark, base).first()["last_run_status"] == "running"
    assert stream.current_store(spark, base).count() == 30
    stream.process_run(_articles(spark, 40, second, 40), second, base, stream.run_clock(second))
    assert stream.current_state(spark, base).first()["last_run_status"] == "success"


def _articles(spark, n, run, offset=0):
    a = spark.range(offset, offset + n).select(F.col("id").alias("seq"))
    words = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.substring(F.md5(F.concat(F.col("seq").cast("string"), F.lit("-"), k.cast("string"))), 1, 8))
    return a.select("seq", F.array_join(words, " ").alias("title"), F.concat(F.lit("https://h"), F.col("seq").cast("string"), F.lit(".com/a")).alias("url"),
                    F.lit("web").alias("source"), F.concat(F.lit("h"), F.col("seq").cast("string"), F.lit(".com")).alias("source_domain"),
                    F.lit("d").alias("description"), F.timestamp_add("MINUTE", -(F.col("seq") % 50).cast("int"), stream.run_clock(run)).alias("published_at"),
                    F.lit(1).alias("upvotes"), F.lit(1).alias("comments"))


def test_tables_stay_bounded_and_follow_a_sequential_model(spark):
    base, model, sizes = _base(spark), {}, []
    start = dt.datetime(2024, 1, 10)
    for k in range(8):
        run_id = int((start + dt.timedelta(hours=8 * k)).strftime("%Y%m%d%H"))
        stream.process_run(_articles(spark, 40, run_id, 40 * k), run_id, base, stream.run_clock(run_id))
        news = stream.read_table(spark, base, "news_log").where(F.col("run_id") == run_id).collect()
        assert len(news) == 30
        if len(model) > 150:
            for i in sorted(model, key=lambda i: (model[i], i))[:50]:
                del model[i]
        model |= {r.id: r.published_at for r in news}
        sizes.append(stream.current_store(spark, base).count())
        assert {r.id for r in stream.current_store(spark, base).collect()} == set(model)
    assert max(sizes) <= 180
    last = stream.snapshot_before(spark, base, "memory", 1 << 62)
    assert last.count() == 30 * 7  # rows exactly 48 hours old stay, older ones go
    assert stream.current_state(spark, base).first()["last_run_status"] == "success"


def test_replay_replaces_and_empty_runs_are_recorded(spark):
    base, run_id = _base(spark), 2024011010
    arts = _articles(spark, 40, run_id)
    for _ in range(2):
        stream.process_run(arts, run_id, base, stream.run_clock(run_id))
        assert stream.read_table(spark, base, "news_log").count() == 30
        assert stream.snapshot_before(spark, base, "memory", 1 << 62).count() == 30
        assert stream.read_table(spark, base, "runs").count() == 1
    later = run_id + 1
    stream.process_run(arts.limit(0), later, base, stream.run_clock(later))
    state = stream.current_state(spark, base).first()
    assert state["last_run_status"] == "failed: No articles fetched from any source"
    assert stream.current_store(spark, base).count() == 30
    stream.process_run(arts.limit(0), run_id, base, stream.run_clock(run_id))
    assert stream.read_table(spark, base, "news_log").count() == 0


def test_rerun_of_an_older_run_sees_earlier_memory_only(spark):
    base = _base(spark)
    first, second = 2024011010, 2024011011
    arts = _articles(spark, 40, first)
    stream.process_run(arts, second, base, stream.run_clock(second))
    stream.process_run(arts, first, base, stream.run_clock(first))
    assert stream.read_table(spark, base, "news_log").where(F.col("run_id") == first).count() == 30


def test_error_outcome(spark):
    base, run_id = _base(spark), 2024011010
    bad = _articles(spark, 5, run_id).withColumn("title", F.raise_error(F.lit("broken feed")).cast("string"))
    with pytest.raises(Exception, match="broken feed"):
        stream.process_run(bad, run_id, base, stream.run_clock(run_id))
    assert stream.current_state(spark, base).first()["last_run_status"].startswith("failed: ")


def test_check_trims_and_runs_only_when_due(spark):
    base, run_id = _base(spark), 2024011010
    stream.process_run(_articles(spark, 40, run_id), run_id, base, stream.run_clock(run_id))
    ran = []
    clock = stream.run_clock(run_id)
    assert not stream.check_and_run(spark, base, run_id, clock, lambda: ran.append(1))
    assert stream.check_and_run(spark, base, run_id + 5, F.timestamp_add("HOUR", F.lit(5), clock), lambda: ran.append(2))
    assert ran == [2]


def test_url_dedup_keeps_first_and_loses_nothing(spark):
    base = _base(spark)
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[(1, "https://a.com/x", t(0)), (2, "https://a.com/x", t(0)), (3, "https://b.com/y", t(200))], [(4, "https://c.com/late", t(1)), (5, "https://a.com/x", t(3))],
               [(6, "https://a.com/x", t(30)), (7, "https://d.com", None), (8, "https://d.com", None)]]
    schema = spark.createDataFrame([], "seq long, url string, published_at timestamp_ntz").schema
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        out = stream.stream_url_dedup(spark, f"{base}/landing", f"{base}/sink", f"{base}/ckpt", schema)
    got = {r.seq: r.status for r in out.collect()}
    assert got == {1: "first", 2: "repeat", 3: "first", 4: "first", 5: "repeat", 6: "first", 7: "first", 8: "repeat"}


def test_url_dedup_is_the_same_in_any_number_of_files(spark):
    schema = spark.createDataFrame([], "seq long, url string, published_at timestamp_ntz").schema
    start = dt.datetime(2024, 1, 1)
    rows = [(k, ("https://a.com/hot", "https://a.com/hot", f"https://b.com/{k % 4}")[k % 3], start + dt.timedelta(minutes=k // 2 * 97)) for k in range(120)]
    rows += [(200, "https://c.com", start + dt.timedelta(days=9)), (201, "https://c.com", start + dt.timedelta(days=10)), (202, "https://c.com", None), (203, "https://d.com", None), (204, "https://d.com", None)]
    want, last = {}, {}
    for seq, url, t in rows:  # in order of time
        old = last.get(url, "none")
        passes = old == "none" or (t is not None and old is not None and t - old >= dt.timedelta(hours=24))
        want[seq] = "first" if passes else "repeat"
        if passes:
            last[url] = t
    assert sum(x == "first" for x in want.values()) > 2 * len(last)
    for files in (1, 3, 8):
        base = _base(spark)
        size = -(-len(rows) // files)
        for k in range(files):
            spark.createDataFrame(rows[k * size:(k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{base}/landing")
            out = stream.stream_url_dedup(spark, f"{base}/landing", f"{base}/sink", f"{base}/ckpt", schema)
        assert {r.seq: r.status for r in out.collect()} == want and out.count() == len(rows), files
