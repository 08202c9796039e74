"""Registered queries: output tables, dedup memory, run state and stage counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import dedup, rank, store, summarize
from curata.plans import oracle as O
from curata.plans.catalog import register
from curata.sources import fixtures as FX

NEWS = summarize.NEWS_COLUMNS
_NEWS_LIST = ", ".join(NEWS)

_UPSERT_SQL = f""",
nrows AS (
  SELECT seq, {O.article_id(O.normalize_url('url'))} AS id, title, title AS summary, source, source_domain, url,
         NULL::VARCHAR AS image_url, published_at, {O.AS_OF} AS created_at, upvotes::DOUBLE AS score,
         {O.derive_tags('title', 'description', 'source')} AS tags
  FROM articles_pages
),
cur AS (
  SELECT id, title, summary, source, source_domain, url, image_url, published_at,
         {O.AS_OF} - INTERVAL 1 DAY AS created_at, score, tags
  FROM nrows WHERE published_at IS NULL OR published_at < TIMESTAMP '{FX.CURRENT_BEFORE}'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1
),
inc AS (
  SELECT id, title, 'v2: ' || title AS summary, source, source_domain, url, image_url, published_at, created_at, score, tags
  FROM nrows WHERE published_at >= TIMESTAMP '{FX.INCOMING_FROM}'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1
),
up AS (
  SELECT {_NEWS_LIST} FROM cur WHERE id NOT IN (SELECT id FROM inc)
  UNION ALL SELECT {_NEWS_LIST} FROM inc
)"""


def _upserted(spark, sf):
    return store.upsert(FX.news_current(spark, sf), FX.news_incoming(spark, sf))


@register("store_upsert", O.with_fixtures(_UPSERT_SQL + f"\nSELECT {_NEWS_LIST} FROM up"))
def q_store_upsert(spark, sf):
    return _upserted(spark, sf).select(*NEWS)


@register(
    "store_trim",
    O.with_fixtures(
        _UPSERT_SQL
        + f""",
oldest AS (SELECT id FROM up ORDER BY coalesce(published_at, TIMESTAMP '1970-01-01 00:00:00'), id LIMIT 50)
SELECT {_NEWS_LIST} FROM up WHERE (SELECT count(*) FROM up) <= 150 OR id NOT IN (SELECT id FROM oldest)"""
    ),
)
def q_store_trim(spark, sf):
    return store.trim(_upserted(spark, sf)).select(*NEWS)


_RANKED_SQL = f""", d1_in AS (SELECT *, {O.normalize_url('url')} AS normalized_url FROM articles_pages),
d1 AS (SELECT * FROM d1_in QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY seq) = 1),
sc AS ({O.scored_select('d1')}),
capped AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY coalesce(source_domain, 'unknown') ORDER BY final_score DESC, seq) <= 5),
top30 AS (SELECT * FROM capped ORDER BY final_score DESC, seq LIMIT 30)"""


def _top30(spark, sf):
    return rank.rank(dedup.dedup_url(FX.articles_pages(spark, sf)), FX.as_of())


@register(
    "memory_append",
    O.with_fixtures(
        _RANKED_SQL
        + f"""
SELECT normalized_url, normalized_title, ts FROM memory_fixture
UNION ALL
SELECT {O.normalize_url_memory('url')} AS normalized_url, {O.normalize_title('title')} AS normalized_title, {O.AS_OF} AS ts FROM top30"""
    ),
)
def q_memory_append(spark, sf):
    mem = FX.memory_fixture(spark, sf)
    return mem.unionByName(store.remember(_top30(spark, sf), FX.as_of()))


@register(
    "memory_expire",
    O.with_fixtures(f"SELECT normalized_url, normalized_title, ts FROM memory_fixture WHERE NOT (ts < {O.AS_OF} - INTERVAL 48 HOUR)"),
)
def q_memory_expire(spark, sf):
    return store.expire(FX.memory_fixture(spark, sf), FX.as_of())


_RUNS_SQL = """,
runs_daily AS (
  SELECT date_trunc('day', ts) AS day, max(ts) AS last_fetched_at,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS n
  FROM events GROUP BY 1
),
runs AS (
  SELECT last_fetched_at,
         CASE dayofmonth(day) % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'running' ELSE 'failed: 0 articles saved' END AS last_run_status,
         CASE WHEN dayofmonth(day) % 3 = 0 THEN n ELSE 0 END AS last_article_count
  FROM runs_daily
),
latest AS (
  SELECT * FROM (
    SELECT CASE WHEN last_fetched_at > TIMESTAMP '1970-01-01 00:00:00' THEN last_fetched_at ELSE TIMESTAMP '1970-01-01 00:00:00' END AS last_fetched_at,
           coalesce(last_run_status, 'never') AS last_run_status, coalesce(last_article_count, 0) AS last_article_count, 1 AS real
    FROM runs
    UNION ALL SELECT TIMESTAMP '1970-01-01 00:00:00', 'never', 0, 0
  ) ORDER BY last_fetched_at DESC, real DESC LIMIT 1
)"""


@register("run_state_latest", O.with_fixtures(_RUNS_SQL + "\nSELECT last_fetched_at, last_run_status, last_article_count FROM latest"))
def q_run_state_latest(spark, sf):
    return store.latest_run(FX.runs_fixture(spark, sf))


@register(
    "run_due",
    O.with_fixtures(
        _RUNS_SQL
        + f""",
h AS (SELECT *, trunc((epoch_us({O.AS_OF}) - epoch_us(last_fetched_at)) / 3600000000.0)::BIGINT AS hours_elapsed FROM latest)
SELECT last_fetched_at, last_run_status, hours_elapsed, hours_elapsed >= 1 AS due FROM h"""
    ),
)
def q_run_due(spark, sf):
    return store.run_due(store.latest_run(FX.runs_fixture(spark, sf)), FX.as_of())


_COUNTS_SQL = f""", d1_in AS (SELECT *, {O.normalize_url('url')} AS normalized_url FROM articles_pages),
d1 AS (SELECT * FROM d1_in QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY seq) = 1),
d2 AS (SELECT * FROM d1 WHERE normalized_url NOT IN (SELECT normalized_url FROM memory_recent)
        AND {O.normalize_title('title')} NOT IN (SELECT lower(normalized_title) FROM memory_recent))
{O.greedy_sql('d2')},
uniq AS (SELECT d.* FROM d2 d JOIN greedy_kept k ON k.seq = d.seq),
sc AS ({O.scored_select('uniq')}),
capped AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY coalesce(source_domain, 'unknown') ORDER BY final_score DESC, seq) <= 5),
top30 AS (SELECT * FROM capped ORDER BY final_score DESC, seq LIMIT 30),
counts AS (
  SELECT 'fetched' AS stage, count(*)::BIGINT AS n FROM articles_pages
  UNION ALL SELECT 'unique', count(*)::BIGINT FROM uniq
  UNION ALL SELECT 'selected', count(*)::BIGINT FROM top30
  UNION ALL SELECT 'saved', count(DISTINCT {O.article_id('normalized_url')})::BIGINT FROM top30
)"""


def stage_counts(spark, sf):
    """(stage, n) for one pipeline run over the pages fixture: fetched, unique, selected, saved."""
    from curata.plans import pipeline

    run = pipeline.run_batch(FX.articles_pages(spark, sf), FX.memory_fixture(spark, sf), None, FX.as_of())
    return run["counts"]


@register("pipeline_stage_counts", O.with_fixtures(_COUNTS_SQL + "\nSELECT stage, n FROM counts"))
def q_pipeline_stage_counts(spark, sf):
    return stage_counts(spark, sf)


@register(
    "run_outcome",
    O.with_fixtures(
        _COUNTS_SQL
        + f""",
pv AS (SELECT max(CASE WHEN stage = 'fetched' THEN n END) AS fetched, max(CASE WHEN stage = 'saved' THEN n END) AS saved FROM counts)
SELECT {O.AS_OF} AS last_fetched_at,
       CASE WHEN coalesce(fetched, 0) = 0 THEN 'failed: No articles fetched from any source'
            WHEN coalesce(saved, 0) = 0 THEN 'failed: 0 articles saved' ELSE 'success' END AS last_run_status,
       CAST(CASE WHEN coalesce(fetched, 0) > 0 AND coalesce(saved, 0) > 0 THEN saved ELSE 0 END AS INTEGER) AS last_article_count,
       CAST(CASE WHEN coalesce(fetched, 0) = 0 OR coalesce(saved, 0) = 0 THEN -1 ELSE saved END AS INTEGER) AS result
FROM pv"""
    ),
)
def q_run_outcome(spark, sf):
    return store.run_outcome(stage_counts(spark, sf), FX.as_of())


@register(
    "pipeline_news",
    O.with_fixtures(
        _COUNTS_SQL
        + O.RESP_CTE
        + f""",
ans AS (
  SELECT id, max(CASE WHEN attempt = 1 THEN t END) AS text1, max(CASE WHEN attempt = 2 THEN t END) AS text2
  FROM (SELECT id, attempt, arg_min(t, {{'n': try_no, 't': t}}) AS t FROM (SELECT id, attempt, try_no, coalesce(text_raw, '') AS t FROM resp) x
        WHERE NOT {O.is_blank('t')} GROUP BY id, attempt) y
  GROUP BY id
),
sel AS (SELECT *, {O.article_id('normalized_url')} AS id FROM top30),
res AS (
  SELECT s.*, n.text1, n.text2, {O.clean_summary('n.text1')} AS c1, {O.clean_summary('n.text2')} AS c2
  FROM sel s LEFT JOIN ans n ON n.id = s.id
),
src AS (
  SELECT *, CASE WHEN {O.is_blank('text1')} THEN 'fallback' WHEN {O.is_valid_summary('c1')} THEN 'attempt1'
                 WHEN {O.is_blank('text2')} THEN 'fallback' WHEN {O.is_valid_summary('c2')} THEN 'attempt2'
                 ELSE 'fallback' END AS summary_source
  FROM res
)
SELECT id, title,
       CASE summary_source WHEN 'attempt1' THEN c1 WHEN 'attempt2' THEN c2 ELSE {O.fallback_summary('title', 'description')} END AS summary,
       source, source_domain, url, NULL::VARCHAR AS image_url, published_at, {O.AS_OF} AS created_at, final_score AS score, tags
FROM src"""
    ),
)
def q_pipeline_news(spark, sf):
    """One full run: sources -> dedup (URL, memory, greedy titles) -> rank -> summaries -> news rows."""
    from curata.plans import pipeline

    run = pipeline.run_batch(
        FX.articles_pages(spark, sf), FX.memory_fixture(spark, sf), FX.responses_fixture(spark, sf).drop("seq"), FX.as_of()
    )
    return run["news"].select(*NEWS)
