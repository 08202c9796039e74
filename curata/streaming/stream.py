"""The hourly run over a landing folder, in batch or driven by Structured Streaming.

A run is a logical unit: the rows landed under ``run=<yyyyMMddHH>``, however many files hold them. Its
clock is the end of that hour, so the memory window and the expiry move with the runs.

Tables, all under one folder:

    news_log   the rows that a run published
    memory     the dedup memory after the run (rows up to 48 h old, so a snapshot stays small)
    store      the bounded output table after the run
    runs       the outcome of the run
    rejects    what the run's sources landed without an article coming of it
    answers    what the text provider answered, by digest of the prompt
    running    one row for each attempt that began
    manifest   one row for each commit: the tables that an attempt of a run wrote, and fingerprints

An attempt writes its tables under ``run_id=<id>/attempt=<id>``, which nobody reads until one manifest row makes
them current, all at once. So a crash between two writes leaves the tables of whole runs only, and a rerun
replaces a run without touching files that a reader may hold.

The manifest is also the ledger of inputs: each commit has the fingerprint of the run's rows (a sum of row
hashes, taken in the pass that writes them), of the store and memory it started from, and of those it left. Rows
that land late for an earlier run change its fingerprint; it and the runs after it are done again, in order, until one
starts from what it started from before. The tables then are those of all rows landed at once.

``stream_url_dedup`` is a separate, stateful variant: URL dedup by event time.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from curata.functions import urls
from curata.operators import store, summarize
from curata.plans import pipeline
from curata.session import cut_lineage, drop_path, new_path
from curata.sources.landed import present

MEMORY_SCHEMA = "normalized_url string, normalized_title string, ts timestamp_ntz"
NEWS_SCHEMA = ("id string, title string, summary string, source string, source_domain string, url string, image_url string, "
               "published_at timestamp_ntz, created_at timestamp_ntz, score double, tags array<string>")
RUNS_SCHEMA = "last_fetched_at timestamp_ntz, last_run_status string, last_article_count int"
REJECTS_SCHEMA = "source string, file string, reason string"
SCHEMAS = {"news_log": NEWS_SCHEMA, "memory": MEMORY_SCHEMA, "store": NEWS_SCHEMA, "runs": RUNS_SCHEMA, "rejects": REJECTS_SCHEMA}
MANIFEST_SCHEMA = "run_id bigint, attempt string, names array<string>, input string, upstream string, output string, commit bigint"
RUNNING_SCHEMA = f"{RUNS_SCHEMA}, run_id bigint, base bigint"
ANSWERS_SCHEMA = "prompt_key string, payload string"
NEVER = 1 << 62


def run_clock(run_id: int) -> Column:
    """End of the hour that a run id (yyyyMMddHH) names."""
    d = str(run_id)
    start = F.lit(f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:10]}:00:00").cast("timestamp_ntz")
    return F.timestamp_add("HOUR", F.lit(1), start)


# ---------------------------------------------------------------- manifest


def manifest(spark: SparkSession, tables: str) -> DataFrame:
    """All commits; empty before the first."""
    found = present(lambda: spark.read.schema(MANIFEST_SCHEMA).parquet(f"{tables}/manifest"))
    return spark.createDataFrame([], MANIFEST_SCHEMA) if found is None else found


def current(spark: SparkSession, tables: str, name: str) -> DataFrame:
    """Columns run_id, attempt and the commit's: for each run the last commit that holds table ``name``."""
    rows = manifest(spark, tables).where(F.array_contains("names", name))
    return rows.groupBy("run_id").agg(F.max_by(F.struct("attempt", "input", "upstream", "output", "commit"), "commit").alias("c")).select("run_id", "c.*")


def read_table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    """The current rows of a table with their ``run_id``; empty, with the declared schema, before the first run."""
    schema = f"{SCHEMAS[name]}, run_id bigint, attempt string"
    found = present(lambda: spark.read.schema(schema).parquet(f"{tables}/{name}"))
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.join(current(spark, tables, name).select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").select(*_columns(name), "run_id")


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def _head(spark: SparkSession, tables: str, name: str, before: int) -> Row | None:
    """The commit of the latest run before ``before`` that holds table ``name``."""
    return current(spark, tables, name).where(F.col("run_id") < before).orderBy(F.desc("run_id")).first()


def snapshot_before(spark: SparkSession, tables: str, name: str, run_id: int) -> DataFrame:
    """The snapshot that the latest run before ``run_id`` left (reads one attempt's folder)."""
    return _snapshot(spark, tables, name, _head(spark, tables, name, run_id))


def _snapshot(spark: SparkSession, tables: str, name: str, head: Row | None) -> DataFrame:
    if head is None:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{tables}/{name}/run_id={head['run_id']}/attempt={head['attempt']}")


def _write(df: DataFrame, tables: str, name: str, run_id: int, attempt: str) -> DataFrame:
    """Write one table of an attempt and return it as read; nobody sees it before its commit."""
    path = f"{tables}/{name}/run_id={run_id}/attempt={attempt}"
    df.select(*_columns(name)).coalesce(1).write.parquet(path)  # tables of one run are a few rows
    return df.sparkSession.read.schema(SCHEMAS[name]).parquet(path)


def _commit(spark: SparkSession, tables: str, run_id: int, attempt: str, names: list[str], input_: str = "", upstream: str = "", output: str = "") -> int:
    """Make the tables ``names`` of an attempt current: one row in one file, under the next free number."""
    number = (manifest(spark, tables).agg(F.max("commit")).first()[0] or 0) + 1
    row = spark.createDataFrame([(run_id, attempt, names, input_, upstream, output)], MANIFEST_SCHEMA.rpartition(",")[0])
    while True:
        try:
            row.coalesce(1).write.mode("error").parquet(f"{tables}/manifest/commit={number}")
            return number
        except AnalysisException as e:  # another writer has it, or one that died
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1


# ---------------------------------------------------------------- fingerprints


def _marks(df: DataFrame) -> list[Column]:
    """Aggregates that tell bags of rows apart: their number and two sums of row hashes."""
    wide = lambda salt: F.sum(F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n"), wide(1).alias("a"), wide(2).alias("b")]


def fingerprint(*dfs: DataFrame) -> str:
    """Equal for equal bags of rows, in any files and order."""
    return "|".join("{n}:{a}:{b}".format(**df.agg(*_marks(df)).first().asDict()) for df in dfs)


def _landed(articles: DataFrame) -> tuple[DataFrame, str, str, int]:
    """A run's articles written once, their path, their fingerprint and number, the last two observed in the pass that writes."""
    spark, seen = articles.sparkSession, Observation()
    path = new_path(spark)
    articles.observe(seen, *_marks(articles)).write.parquet(path)
    got = seen.get
    return spark.read.parquet(path), path, "{n}:{a}:{b}".format(**got), got["n"]


# ---------------------------------------------------------------- runs


def _state(spark: SparkSession, as_of: Column, status: str, n: int) -> DataFrame:
    return spark.range(1).select(as_of.alias("last_fetched_at"), F.lit(status).alias("last_run_status"), F.lit(n).alias("last_article_count"))


def _mark_running(spark: SparkSession, tables: str, run_id: int, attempt: str, as_of: Column) -> None:
    """Say that an attempt began; when that can't be written the run goes on."""
    try:
        base = manifest(spark, tables).agg(F.max("commit")).first()[0] or 0
        row = _state(spark, as_of, "running", 0).select("*", F.lit(run_id).cast("long").alias("run_id"), F.lit(base).cast("long").alias("base"))
        row.coalesce(1).write.parquet(f"{tables}/running/attempt={attempt}")
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"run {run_id} could not be marked as running: {e}", stacklevel=2)


def answers(spark: SparkSession, tables: str) -> DataFrame:
    """What the provider has answered so far (prompt_key, payload)."""
    found = present(lambda: spark.read.schema(ANSWERS_SCHEMA).parquet(f"{tables}/answers"))
    return spark.createDataFrame([], ANSWERS_SCHEMA) if found is None else found


def _asked(spark: SparkSession, tables: str, provider) -> Callable[[DataFrame], DataFrame]:
    """Selected articles to responses: both prompts' answers are kept by digest, and only new prompts are asked."""

    def respond(selected: DataFrame) -> DataFrame:
        def ask(wanted: DataFrame) -> DataFrame:
            keyed = cut_lineage(wanted.withColumn("prompt_key", F.sha2(F.col("prompt").cast("binary"), 256)))
            new = keyed.dropDuplicates(["prompt_key"]).join(answers(spark, tables), "prompt_key", "left_anti")
            # one partition for each task of a provider; an answer is on disk before anything uses it
            got = summarize.generate(new.select(F.col("prompt_key").alias("id"), "attempt", "prompt"), provider)
            got.select(F.col("id").alias("prompt_key"), "payload").write.mode("append").parquet(f"{tables}/answers")
            kept = answers(spark, tables).groupBy("prompt_key").agg(F.min("payload").alias("payload"))
            return keyed.join(kept, "prompt_key").select("id", "attempt", F.lit(1).cast("long").alias("try_no"), "payload")

        both = summarize.prompts(selected)
        first = cut_lineage(ask(both.where("attempt = 1")))
        second = ask(both.where("attempt = 2").join(summarize.unusable(first), "id", "left_semi"))
        return first.unionByName(second)

    return respond


def process_run(articles: DataFrame, run_id: int, tables: str, as_of: Column, seed_memory: DataFrame | None = None,
                rejects: DataFrame | None = None, provider=None, unless_done: bool = False) -> bool:
    """One run: mark it running, trim the store, dedup against memory, rank, summarise, and commit all tables together.

    With ``unless_done`` a run whose rows, clock and predecessor are those of its commit is left as it is;
    returns whether it ran. An error commits the outcome ``failed: <reason>`` alone and is raised again: the tables
    of the run stay those of its last whole attempt."""
    spark, attempt = articles.sparkSession, uuid.uuid4().hex
    # a manifest without rows, where there is none yet
    spark.createDataFrame([], MANIFEST_SCHEMA.rpartition(",")[0]).write.mode("ignore").parquet(f"{tables}/manifest/commit=0")
    if not unless_done:
        _mark_running(spark, tables, run_id, attempt, as_of)
    try:
        articles, path, mark, fetched = _landed(articles)
        mark = f"{mark}@{spark.range(1).select(as_of.cast('string')).first()[0]}"
        heads = {n: _head(spark, tables, n, run_id) for n in ("store", "memory")}
        upstream = "/".join(h["output"] if h else "" for h in heads.values())
        if unless_done:
            done = current(spark, tables, "memory").where(F.col("run_id") == run_id).first()
            if done is not None and (done["input"], done["upstream"]) == (mark, upstream):
                drop_path(spark, path)
                return False
            _mark_running(spark, tables, run_id, attempt, as_of)
        kept = store.trim(_snapshot(spark, tables, "store", heads["store"]))
        memory = _snapshot(spark, tables, "memory", heads["memory"])
        known = memory if seed_memory is None else memory.unionByName(seed_memory)
        respond = _asked(spark, tables, provider) if provider is not None else None
        run = pipeline.run_batch(articles, known, None, as_of, fetched=fetched, respond=respond)
        put = lambda df, name: _write(df, tables, name, run_id, attempt)
        news, seen = run["news"].dropDuplicates(["id"]), Observation()
        news = put(news.observe(seen, F.count(F.lit(1)).alias("n")), "news_log")
        saved = seen.get["n"]
        after = put(store.upsert(kept, news, order_col=None), "store")
        remembered = put(store.expire(memory.unionByName(store.remember(news, as_of)), as_of) if saved else memory, "memory")
        put(rejects if rejects is not None else spark.createDataFrame([], REJECTS_SCHEMA), "rejects")
        counts = run["counts"].where(F.col("stage") != "saved").unionByName(spark.createDataFrame([("saved", saved)], "stage string, n long"))
        put(store.run_outcome(counts, as_of), "runs")
        _commit(spark, tables, run_id, attempt, list(SCHEMAS), mark, upstream, fingerprint(after, remembered))
        drop_path(spark, path)
        return True
    except Exception as e:
        reason = str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__
        failed = uuid.uuid4().hex
        try:
            _write(_state(spark, as_of, f"failed: {reason}", 0), tables, "runs", run_id, failed)
            _commit(spark, tables, run_id, failed, ["runs"])
        except Exception as again:  # noqa: BLE001 - the first error is the one to report
            warnings.warn(f"run {run_id} could not be marked as failed: {again}", stacklevel=2)
        raise e


def current_state(spark: SparkSession, tables: str) -> DataFrame:
    """Latest run state: outcomes, and attempts that began after their run's last commit (defaults when there is none)."""
    began = present(lambda: spark.read.schema(RUNNING_SCHEMA).parquet(f"{tables}/running"))
    done = read_table(spark, tables, "runs")
    if began is None:
        return store.latest_run(done.drop("run_id"))
    last = manifest(spark, tables).where(F.array_contains("names", "runs")).groupBy(F.col("run_id").alias("_run")).agg(F.max("commit").alias("_last"))
    open_ = began.join(last, began["run_id"] == last["_run"], "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col("base")))
    done = done.join(open_.select("run_id"), "run_id", "left_anti")
    return store.latest_run(done.drop("run_id").unionByName(open_.select(*_columns("runs"))))


def current_store(spark: SparkSession, tables: str) -> DataFrame:
    """The store that the latest run left."""
    return snapshot_before(spark, tables, "store", NEVER)


def check_and_run(spark: SparkSession, tables: str, run_id: int, as_of: Column, run: Callable[[], None]) -> bool:
    """The periodic check: a run that is not due only trims the store, under its own run id; returns whether it ran.

    A state that can't be read counts as due, and a trim that fails ends nothing."""
    try:
        due = store.run_due(current_state(spark, tables), as_of).first()["due"]
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"the run state can't be read, the run counts as due: {e}", stacklevel=2)
        due = True
    if due:
        run()  # which trims first
        return True
    try:
        head = _head(spark, tables, "store", run_id + 1)
        if head is not None:
            attempt = uuid.uuid4().hex
            kept = _write(store.trim(_snapshot(spark, tables, "store", head)), tables, "store", run_id, attempt)
            _commit(spark, tables, run_id, attempt, ["store"], head["input"], head["upstream"], fingerprint(kept))
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"the store could not be trimmed: {e}", stacklevel=2)
    return False


def land_runs(articles: DataFrame, landing: str, run_id: Column, files: int | None = None, mode: str = "overwrite") -> None:
    """Land ``articles`` under ``run=<id>`` in one write; ``files`` splits each run over so many files."""
    keyed = articles.withColumn("run", run_id)
    if files:
        keyed = keyed.repartition(files)
    keyed.write.mode(mode).partitionBy("run").parquet(landing)


def refresh(spark: SparkSession, landing: str, tables: str, schema, first: int, seed_memory: DataFrame | None = None,
            clock: Callable[[int], Column] = run_clock, provider=None) -> list[int]:
    """Bring run ``first`` and all landed runs after it up to date, in order; returns the runs that were done.

    Runs depend on earlier ones, so the driver goes through their ids; each is a distributed job, and one whose rows and
    predecessor are unchanged costs a scan of its rows."""
    names = [f.name for f in schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", run bigint"
    rows = spark.read.schema(ddl).parquet(landing)
    ids = [r["run"] for r in rows.where(F.col("run") >= first).select("run").distinct().orderBy("run").toLocalIterator()]
    done = []
    for run_id in ids:
        whole = rows.where(F.col("run") == run_id).select(*names)
        if process_run(whole, run_id, tables, clock(run_id), seed_memory, provider=provider, unless_done=True):
            done.append(run_id)
    return done


def stream_pipeline(spark: SparkSession, landing: str, tables: str, checkpoint: str, schema, seed_memory: DataFrame | None = None,
                    clock: Callable[[int], Column] = run_clock, provider=None) -> None:
    """Bring all runs that new rows have landed for, and the runs after them, up to date, then stop (``availableNow``)."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", run bigint"

    def batch(df: DataFrame, _: int) -> None:
        first = df.agg(F.min("run")).first()[0]
        if first is not None:
            refresh(spark, landing, tables, schema, first, seed_memory, clock, provider)

    src = spark.readStream.schema(ddl).parquet(landing)
    src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def url_dedup_batch(batch: DataFrame, seen: DataFrame, delay_hours: int) -> DataFrame:
    """Rows of ``batch`` with ``status``: by URL in order of event time, then seq, a row is ``first`` when no row has
    passed before, in ``seen`` or in the batch, or the last one did ``delay_hours`` or more before it, else ``repeat``.

    Rows without an event time come last. A URL's different times are gathered by hour, then walked as one array."""
    keyed = cut_lineage(batch.withColumn("normalized_url", urls.normalize_url(F.col("url"))))  # used three times, parsed once
    last = seen.groupBy(F.col("normalized_url").alias("_url")).agg(F.max("event_time").alias("_last"))
    at = keyed.groupBy("normalized_url", "event_time").agg(F.min(F.struct("seq")).alias("_seq"))
    hours = at.groupBy("normalized_url", F.date_trunc("HOUR", "event_time").alias("_hour")).agg(F.collect_list("event_time").alias("_times"))
    each = hours.groupBy("normalized_url").agg(F.array_sort(F.flatten(F.collect_list("_times"))).alias("_times"))
    each = each.join(last, F.col("normalized_url") == F.col("_url"), "left")
    kind = keyed.schema["event_time"].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")

    def step(acc: Column, t: Column) -> Column:
        passes = acc["last"].isNull() | (t >= F.timestamp_add("HOUR", F.lit(delay_hours), acc["last"]))
        return F.struct(F.when(passes, t).otherwise(acc["last"]).alias("last"), F.when(passes, F.concat(acc["out"], F.array(t))).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate("_times", F.struct(F.col("_last").cast(kind).alias("last"), none.alias("out")), step, lambda acc: acc["out"])
    untimed = F.col("_url").isNotNull() & F.col("_last").isNull()  # only a row without a time has passed: it holds for all
    passed = F.when(untimed, none).when(F.col("_url").isNull() & (F.size("_times") == 0), F.array(F.lit(None).cast(kind))).otherwise(walked)
    passed = each.select(F.col("normalized_url").alias("_first"), F.explode(passed).alias("_at"))
    same = (F.col("normalized_url") == F.col("_first")) & F.col("event_time").eqNullSafe(F.col("_at"))
    first = at.join(passed, same).select("_first", "_at", "_seq")
    rows = keyed.join(first, same, "left")
    is_first = F.col("_first").isNotNull() & (F.struct("seq") == F.col("_seq"))
    return rows.withColumn("status", F.when(is_first, "first").otherwise("repeat")).drop("_first", "_at", "_seq")


def stream_url_dedup(spark: SparkSession, landing: str, sink: str, checkpoint: str, schema, delay_hours: int = 24) -> DataFrame:
    """Stateful URL dedup: every landed row gets a status, none is lost, and the state is the sink itself.

    Rows of a micro-batch are judged in order of event time, against the rows that passed before them in it
    and in earlier batches, so rows that land in that order get the same statuses in any number of batches.
    A row that lands after a later one of its URL has passed is judged against that one, and rows without an
    event time by their URL alone. A replayed batch replaces its own partition."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    sink_schema = f"{columns}, event_time timestamp_ntz, normalized_url string, status string, batch_id bigint"

    def batch(df: DataFrame, batch_id: int) -> None:
        found = present(lambda: spark.read.schema(sink_schema).parquet(sink))
        seen = spark.createDataFrame([], sink_schema) if found is None else found
        seen = seen.where((F.col("batch_id") < batch_id) & (F.col("status") == "first")).select("normalized_url", "event_time")
        rows = url_dedup_batch(df.withColumn("event_time", F.col("published_at")), seen, delay_hours)
        rows.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    src = spark.readStream.schema(schema).parquet(landing)
    src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sink_schema).parquet(sink)
