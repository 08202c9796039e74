"""Registered queries: HTML cleaning, summaries and the news projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import summary, text
from curata.operators import clean, dedup, rank, summarize
from curata.plans import oracle as O
from curata.plans.catalog import register
from curata.sources import fixtures as FX

_ID = O.article_id(O.normalize_url("url"))


@register("html_clean", O.with_fixtures(f"SELECT page_id, {O.html_text('html')} AS text FROM pages"))
def q_html_clean(spark, sf):
    return clean.clean_pages(FX.table(spark, sf, "pages").select("page_id", "html"))


@register("html_strip", O.with_fixtures(f"SELECT seq, {O.strip_tags('description')} AS text FROM articles_pages"))
def q_html_strip(spark, sf):
    return FX.articles_pages(spark, sf).select("seq", text.strip_tags(F.col("description")).alias("text"))


_ARTICLE_SQL = "regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1)"


@register("text_strip_truncate", O.with_fixtures(f"SELECT page_id, {O.strip_truncate(_ARTICLE_SQL)} AS text FROM pages"))
def q_text_strip_truncate(spark, sf):
    p = FX.table(spark, sf, "pages").select("page_id", "html")
    body = F.regexp_extract("html", "(?s)<article>(.*?)(?:</article>|$)", 1)
    return p.select("page_id", text.strip_truncate(body).alias("text"))


@register("summary_content", O.with_fixtures(f"SELECT seq, {O.content('title', 'description')} AS content FROM articles_pages"))
def q_summary_content(spark, sf):
    a = FX.articles_pages(spark, sf)
    return a.select("seq", summarize.content(F.col("title"), F.col("description")).alias("content"))


@register(
    "summary_prompt",
    O.with_fixtures(
        f"SELECT {_ID} AS id, 1 AS attempt, {O.fill(summary.PROMPT_TEMPLATE, 80, title='title', content=O.content('title', 'description'))} AS prompt FROM articles_pages "
        f"UNION ALL SELECT {_ID} AS id, 2 AS attempt, {O.fill(summary.SIMPLE_PROMPT_TEMPLATE, 80, title='title')} AS prompt FROM articles_pages"
    ),
)
def q_summary_prompt(spark, sf):
    return summarize.prompts(FX.articles_pages(spark, sf))


@register("response_text", O.with_fixtures(O.RESP_CTE + "\nSELECT id, seq, attempt, try_no, coalesce(text_raw, '') AS text FROM resp"))
def q_response_text(spark, sf):
    r = FX.responses_fixture(spark, sf)
    return r.select("id", "seq", F.col("attempt").cast("int").alias("attempt"), "try_no", summary.response_text(F.col("payload")).alias("text"))


@register(
    "summary_cleanup",
    O.with_fixtures(O.RESP_CTE + f"\nSELECT id, seq, attempt, try_no, {O.clean_summary('coalesce(text_raw, ' + chr(39) * 2 + ')')} AS summary FROM resp"),
)
def q_summary_cleanup(spark, sf):
    r = FX.responses_fixture(spark, sf)
    return r.select(
        "id", "seq", F.col("attempt").cast("int").alias("attempt"), "try_no",
        summary.clean_summary(summary.response_text(F.col("payload"))).alias("summary"),
    )


@register(
    "summary_valid",
    O.with_fixtures(
        O.RESP_CTE
        + f""", cl AS (SELECT id, seq, attempt, try_no, {O.clean_summary("coalesce(text_raw, '')")} AS s FROM resp)
SELECT id, seq, attempt, try_no, {O.word_count('s')}::INTEGER AS words, {O.is_valid_summary('s')} AS valid FROM cl"""
    ),
)
def q_summary_valid(spark, sf):
    r = FX.responses_fixture(spark, sf)
    s = summary.clean_summary(summary.response_text(F.col("payload")))
    return r.select(
        "id", "seq", F.col("attempt").cast("int").alias("attempt"), "try_no",
        text.word_count(s).alias("words"), summary.is_valid_summary(s).alias("valid"),
    )


@register("summary_fallback", O.with_fixtures(f"SELECT seq, {O.fallback_summary('title', 'description')} AS summary FROM articles_pages"))
def q_summary_fallback(spark, sf):
    a = FX.articles_pages(spark, sf)
    return a.select("seq", summary.fallback_summary(F.col("title"), F.col("description")).alias("summary"))


_RESOLVE_SQL = O.RESP_CTE + f""",
ans AS (
  SELECT id, max(CASE WHEN attempt = 1 THEN t END) AS text1, max(CASE WHEN attempt = 2 THEN t END) AS text2
  FROM (SELECT id, attempt, arg_min(t, {{'n': try_no, 't': t}}) AS t FROM (SELECT id, attempt, try_no, coalesce(text_raw, '') AS t FROM resp) x
        WHERE NOT {O.is_blank('t')} GROUP BY id, attempt) y
  GROUP BY id
),
arts AS (SELECT seq, {_ID} AS id, title, description FROM articles_pages),
res AS (
  SELECT a.seq, a.id, a.title, a.description, n.text1, n.text2,
         {O.clean_summary('n.text1')} AS c1, {O.clean_summary('n.text2')} AS c2
  FROM arts a LEFT JOIN ans n ON n.id = a.id
),
src AS (
  SELECT *, CASE WHEN {O.is_blank('text1')} THEN 'fallback' WHEN {O.is_valid_summary('c1')} THEN 'attempt1'
                 WHEN {O.is_blank('text2')} THEN 'fallback' WHEN {O.is_valid_summary('c2')} THEN 'attempt2'
                 ELSE 'fallback' END AS summary_source
  FROM res
)"""


@register(
    "summary_resolve",
    O.with_fixtures(
        _RESOLVE_SQL
        + f"""
SELECT seq, id, CASE summary_source WHEN 'attempt1' THEN c1 WHEN 'attempt2' THEN c2
                ELSE {O.fallback_summary('title', 'description')} END AS summary, summary_source FROM src"""
    ),
)
def q_summary_resolve(spark, sf):
    a = FX.articles_pages(spark, sf)
    r = FX.responses_fixture(spark, sf).drop("seq")
    return summarize.resolve_summaries(a, r).select("seq", "id", "summary", "summary_source")


@register(
    "summary_lead",
    O.with_fixtures(f"SELECT seq, {_ID} AS id, 1 AS attempt, {O.first_words(O.content('title', 'description'), 60)} AS text FROM articles_pages"),
)
def q_summary_lead(spark, sf):
    r = summarize.lead_responses(FX.articles_pages(spark, sf), keep=("seq",))
    return r.select("seq", "id", F.col("attempt").cast("int").alias("attempt"), summary.response_text(F.col("payload")).alias("text"))


@register(
    "summary_generate",
    O.with_fixtures(
        f"SELECT {_ID} AS id, 1 AS attempt, {O.first_words(O.fill(summary.PROMPT_TEMPLATE, 80, title='title', content=O.content('title', 'description')), 12)} AS text FROM articles_pages "
        f"UNION ALL SELECT {_ID} AS id, 2 AS attempt, {O.first_words(O.fill(summary.SIMPLE_PROMPT_TEMPLATE, 80, title='title'), 12)} AS text FROM articles_pages"
    ),
)
def q_summary_generate(spark, sf):
    """A provider that answers with the first words of its prompt, called through ``generate``."""
    import json
    import re

    def provider(prompts):
        words = [" ".join(re.split(r"[ \t\n\x0B\f\r]+", p)[:12]) for p in prompts]
        return [json.dumps({"candidates": [{"content": {"parts": [{"text": w}]}}]}) for w in words]

    r = summarize.generate(summarize.prompts(FX.articles_pages(spark, sf)), provider)
    return r.select("id", "attempt", summary.response_text(F.col("payload")).alias("text"))


_NEWS_SQL = f""", d1_in AS (SELECT *, {O.normalize_url('url')} AS normalized_url FROM articles_pages),
d1 AS (SELECT * FROM d1_in QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY seq) = 1),
sc AS ({O.scored_select('d1')}),
news AS (
  SELECT {O.article_id('normalized_url')} AS id, title, {O.fallback_summary('title', 'description')} AS summary, source, source_domain, url,
         NULL::VARCHAR AS image_url, published_at, {O.AS_OF} AS created_at, final_score AS score, tags
  FROM sc
)"""


def _news(spark, sf):
    s = rank.score(dedup.dedup_url(FX.articles_pages(spark, sf)), FX.as_of())
    s = s.withColumn("summary", summary.fallback_summary(F.col("title"), F.col("description")))
    return summarize.to_news(s, FX.as_of())


@register("news_project", O.with_fixtures(_NEWS_SQL + "\nSELECT * FROM news"))
def q_news_project(spark, sf):
    return _news(spark, sf)


@register(
    "news_encode",
    O.with_fixtures(
        _NEWS_SQL
        + """
SELECT id, title, summary, source, coalesce(source_domain, '') AS source_domain, url, coalesce(image_url, '') AS image_url,
       coalesce(epoch_us(published_at) // 1000, 0)::BIGINT AS published_at_ms, (epoch_us(created_at) // 1000)::BIGINT AS created_at_ms, score,
       coalesce(tags, []::VARCHAR[]) AS tags
FROM news"""
    ),
)
def q_news_encode(spark, sf):
    return summarize.encode_news(_news(spark, sf))
