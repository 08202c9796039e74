"""Query registry: every operator as ``(spark, sf_dir) -> DataFrame`` plus its DuckDB oracle.

Each query reads the driver tables (directly or through the fixture views built from them), so
its work grows with the data. Column names and types are identical on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import scoring, text, urls
from curata.operators import dedup, rank
from curata.plans import oracle as O
from curata.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _pages(spark, sf):
    return FX.articles_pages(spark, sf)


def _texts(spark, sf):
    return FX.texts_documents(spark, sf)


def _docs(spark, sf):
    return FX.articles_documents(spark, sf)


RANK_COLS = [
    "seq", "title", "url", "normalized_url", "source_domain", "published_at", "upvotes", "comments",
    *rank.SCORE_COLUMNS, "tags",
]

_D1_SQL = f""", d1_in AS (SELECT *, {O.normalize_url('url')} AS normalized_url FROM articles_pages),
d1 AS (SELECT * FROM d1_in QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY seq) = 1)"""

_SCORED_SQL = f""", sc AS ({O.scored_select('d1')}),
capped AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY coalesce(source_domain, 'unknown') ORDER BY final_score DESC, seq) <= 5)"""


# ---------------------------------------------------------------- flagship: rank pipeline


@register(
    "rank_all",
    O.with_fixtures(
        _D1_SQL + _SCORED_SQL + f"""
SELECT {', '.join(RANK_COLS)}, row_number() OVER (ORDER BY final_score DESC, seq) AS rank
FROM capped ORDER BY final_score DESC, seq LIMIT 30"""
    ),
)
def q_rank_all(spark, sf):
    d = dedup.dedup_url(_pages(spark, sf))
    r = rank.rank(d, FX.as_of())
    return r.select(*RANK_COLS, F.col("rank").cast("long").alias("rank"))


@register("rank_diversity", O.with_fixtures(_D1_SQL + _SCORED_SQL + f"\nSELECT {', '.join(RANK_COLS)} FROM capped"))
def q_rank_diversity(spark, sf):
    s = rank.score(dedup.dedup_url(_pages(spark, sf)), FX.as_of())
    return rank.cap_per_domain(s).select(*RANK_COLS)


@register(
    "rank_top",
    O.with_fixtures(
        _D1_SQL + f""", sc AS ({O.scored_select('d1')})
SELECT seq, final_score, row_number() OVER (ORDER BY final_score DESC, seq) AS rank
FROM sc ORDER BY final_score DESC, seq LIMIT 30"""
    ),
)
def q_rank_top(spark, sf):
    """Global top 30 by score without the domain cap."""
    s = rank.score(dedup.dedup_url(_pages(spark, sf)), FX.as_of())
    return rank.top_n(s).select("seq", "final_score", F.col("rank").cast("long").alias("rank"))


@register(
    "score_final",
    O.with_fixtures(
        ", sc AS (" + O.scored_select("articles_pages") + ")\nSELECT seq, " + ", ".join(rank.SCORE_COLUMNS) + " FROM sc"
    ),
)
def q_score_final(spark, sf):
    return rank.score(_pages(spark, sf), FX.as_of()).select("seq", *rank.SCORE_COLUMNS)


@register("score_recency", O.with_fixtures(f"SELECT seq, published_at, {O.r9(O.recency_score('published_at'))} AS recency_score FROM articles_pages"))
def q_score_recency(spark, sf):
    a = _pages(spark, sf)
    return a.select("seq", "published_at", scoring.rounded(scoring.recency_score(F.col("published_at"), FX.as_of())).alias("recency_score"))


@register("score_source", O.with_fixtures(f"SELECT seq, source_domain, {O.source_score('source_domain')} AS source_score FROM articles_pages"))
def q_score_source(spark, sf):
    return rank.with_source_score(_pages(spark, sf)).select("seq", "source_domain", "source_score")


@register(
    "score_engagement",
    O.with_fixtures(f"SELECT seq, upvotes, comments, {O.r9(O.engagement_score('upvotes', 'comments'))} AS engagement_score FROM articles_pages"),
)
def q_score_engagement(spark, sf):
    a = _pages(spark, sf)
    return a.select(
        "seq", "upvotes", "comments",
        scoring.rounded(scoring.engagement_score(F.col("upvotes"), F.col("comments"))).alias("engagement_score"),
    )


@register(
    "score_title",
    O.with_fixtures(
        f"SELECT seq, title, {O.utf16_length('title')}::INTEGER AS title_length, {O.title_quality_score('title')} AS title_quality_score FROM articles_pages"
    ),
)
def q_score_title(spark, sf):
    a = _pages(spark, sf)
    return a.select(
        "seq", "title", text.utf16_length(F.col("title")).alias("title_length"),
        scoring.title_quality_score(F.col("title")).alias("title_quality_score"),
    )


@register(
    "score_keyword",
    O.with_fixtures(
        f"SELECT seq, {O.keyword_matches('title', 'description')}::INTEGER AS keyword_matches, "
        f"{O.keyword_boost('title', 'description')} AS keyword_boost FROM articles_pages"
    ),
)
def q_score_keyword(spark, sf):
    a = _pages(spark, sf)
    return a.select(
        "seq",
        scoring.keyword_matches(F.col("title"), F.col("description")).alias("keyword_matches"),
        scoring.keyword_boost(F.col("title"), F.col("description")).alias("keyword_boost"),
    )


@register("derive_tags", O.with_fixtures(f"SELECT seq, {O.derive_tags('title', 'description', 'source')} AS tags FROM articles_pages"))
def q_derive_tags(spark, sf):
    a = _pages(spark, sf)
    return a.select("seq", scoring.derive_tags(F.col("title"), F.col("description"), F.col("source")).alias("tags"))


# ---------------------------------------------------------------- URL functions


@register("url_domain", O.with_fixtures(f"SELECT seq, url, {O.url_domain('url')} AS domain FROM articles_pages"))
def q_url_domain(spark, sf):
    return _pages(spark, sf).select("seq", "url", urls.url_domain(F.col("url")).alias("domain"))


@register("url_domain_or_self", O.with_fixtures(f"SELECT seq, url, {O.url_domain('url', True)} AS domain FROM articles_pages"))
def q_url_domain_or_self(spark, sf):
    return _pages(spark, sf).select("seq", "url", urls.url_domain(F.col("url"), fallback_to_url=True).alias("domain"))


@register("url_normalize", O.with_fixtures(f"SELECT seq, url, {O.normalize_url('url')} AS normalized_url FROM articles_pages"))
def q_url_normalize(spark, sf):
    return _pages(spark, sf).select("seq", "url", urls.normalize_url(F.col("url")).alias("normalized_url"))


@register("url_normalize_memory", O.with_fixtures(f"SELECT seq, url, {O.normalize_url_memory('url')} AS normalized_url FROM articles_pages"))
def q_url_normalize_memory(spark, sf):
    return _pages(spark, sf).select("seq", "url", urls.normalize_url_memory(F.col("url")).alias("normalized_url"))


@register("article_id", O.with_fixtures(f"SELECT seq, {O.article_id(O.normalize_url('url'))} AS id FROM articles_pages"))
def q_article_id(spark, sf):
    return _pages(spark, sf).select("seq", urls.article_id(urls.normalize_url(F.col("url"))).alias("id"))


# ---------------------------------------------------------------- tokens and similarity


@register("title_tokens", O.with_fixtures(f"SELECT seq, {O.title_tokens('title')} AS tokens FROM texts_documents"))
def q_title_tokens(spark, sf):
    return _texts(spark, sf).select("seq", text.title_tokens(F.col("title")).alias("tokens"))


@register(
    "title_tf",
    O.with_fixtures(
        f", tk AS (SELECT seq, unnest({O.title_tokens('title')}) AS token FROM texts_documents)\n"
        "SELECT seq, token, count(*)::INTEGER AS f FROM tk GROUP BY seq, token"
    ),
)
def q_title_tf(spark, sf):
    return dedup.term_frequency(_texts(spark, sf))


_TEXT_VEC_SQL = f""", tk AS (SELECT seq, unnest({O.title_tokens('title')}) AS token FROM texts_documents),
tf AS (SELECT seq, token, count(*)::BIGINT AS f FROM tk GROUP BY seq, token),
vec AS (SELECT seq, list(struct_pack(token := token, f := f) ORDER BY token) AS v, sum(f * f)::BIGINT AS n2 FROM tf GROUP BY seq)"""


@register(
    "title_cosine_pairs",
    O.with_fixtures(
        _TEXT_VEC_SQL + """,
allr AS (SELECT d.seq, p.seq AS prev FROM texts_documents d JOIN texts_documents p ON p.seq = d.seq - 1),
dots AS (SELECT a.seq AS i, b.seq AS j, sum(a.f * b.f)::BIGINT AS dot FROM allr r JOIN tf a ON a.seq = r.seq JOIN tf b ON b.seq = r.prev AND b.token = a.token GROUP BY a.seq, b.seq)
SELECT r.seq AS i, r.prev AS j,
       round(CASE WHEN coalesce(ni.n2, 0) = 0 OR coalesce(nj.n2, 0) = 0 THEN 0.0::DOUBLE
            ELSE coalesce(d.dot, 0)::DOUBLE / (sqrt(ni.n2::DOUBLE) * sqrt(nj.n2::DOUBLE)) END, 9) AS cosine
FROM allr r LEFT JOIN vec ni ON ni.seq = r.seq LEFT JOIN vec nj ON nj.seq = r.prev LEFT JOIN dots d ON d.i = r.seq AND d.j = r.prev
WHERE r.prev IS NOT NULL"""
    ),
)
def q_title_cosine_pairs(spark, sf):
    """Cosine of every whole text with the text of row ``seq - 1``, where that row exists (a linear
    number of pairs, an equi-join, no global ordering)."""
    return dedup.adjacent_cosine(_texts(spark, sf))


_VEC_SQL = _TEXT_VEC_SQL.replace("texts_documents", "articles_documents")


@register(
    "title_similar_pairs",
    O.with_fixtures(
        _VEC_SQL + """,
reps AS (SELECT min(seq) AS rep FROM vec GROUP BY v),
rtf AS (SELECT tf.* FROM tf JOIN reps ON reps.rep = tf.seq),
dots AS (SELECT a.seq AS i, b.seq AS j, sum(a.f * b.f)::BIGINT AS dot FROM rtf a JOIN rtf b ON a.token = b.token AND b.seq < a.seq GROUP BY a.seq, b.seq)
SELECT d.i, d.j, round(d.dot::DOUBLE / (sqrt(ni.n2::DOUBLE) * sqrt(nj.n2::DOUBLE)), 9) AS cosine
FROM dots d JOIN vec ni ON ni.seq = d.i JOIN vec nj ON nj.seq = d.j
WHERE d.dot::DOUBLE / (sqrt(ni.n2::DOUBLE) * sqrt(nj.n2::DOUBLE)) > 0.7::DOUBLE"""
    ),
)
def q_title_similar_pairs(spark, sf):
    e = dedup.similar_pairs(_docs(spark, sf))["edges"]
    return e.select("i", "j", F.round("cosine", 9).alias("cosine"))


@register(
    "title_vector_groups",
    O.with_fixtures(
        _VEC_SQL + "\nSELECT seq, min(seq) OVER (PARTITION BY v) AS rep FROM vec"
    ),
)
def q_title_vector_groups(spark, sf):
    """Each titled row mapped to the earliest row with an identical term vector."""
    d = _docs(spark, sf)
    return dedup.vector_groups(dedup.term_vectors(d))


@register(
    "dedup_title_greedy",
    O.with_fixtures(
        O.greedy_sql("articles_documents")
        + "\nSELECT d.seq, d.title FROM articles_documents d JOIN greedy_kept k ON k.seq = d.seq"
    ),
)
def q_dedup_title_greedy(spark, sf):
    return dedup.dedup_titles(_docs(spark, sf)).select("seq", "title")


@register("dedup_text_greedy")
def q_dedup_text_greedy(spark, sf):
    """Greedy near-duplicate removal over whole document texts (rows-only: an all-pairs SQL oracle
    is too slow on whole texts; tests compare it with a brute-force sequential run on sf0.001)."""
    d = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("title"))
    return dedup.dedup_texts(d).select(F.col("seq").alias("doc_id"))


# ---------------------------------------------------------------- URL / memory dedup


@register("dedup_url", O.with_fixtures(_D1_SQL + "\nSELECT seq, url, normalized_url FROM d1"))
def q_dedup_url(spark, sf):
    return dedup.dedup_url(_pages(spark, sf)).select("seq", "url", "normalized_url")


@register(
    "memory_window",
    O.with_fixtures("SELECT normalized_url, normalized_title, ts FROM memory_recent"),
)
def q_memory_window(spark, sf):
    return dedup.memory_window(FX.memory_fixture(spark, sf), FX.as_of())


@register(
    "dedup_memory_url",
    O.with_fixtures(
        _D1_SQL + "\nSELECT seq, normalized_url FROM d1 WHERE normalized_url NOT IN (SELECT normalized_url FROM memory_recent)"
    ),
)
def q_dedup_memory_url(spark, sf):
    d = dedup.dedup_url(_pages(spark, sf))
    mem = dedup.memory_window(FX.memory_fixture(spark, sf), FX.as_of())
    return dedup.drop_remembered_urls(d, mem).select("seq", "normalized_url")


@register(
    "dedup_memory_title",
    O.with_fixtures(
        f"SELECT seq, title FROM articles_pages WHERE {O.normalize_title('title')} NOT IN (SELECT lower(normalized_title) FROM memory_recent)"
    ),
)
def q_dedup_memory_title(spark, sf):
    mem = dedup.memory_window(FX.memory_fixture(spark, sf), FX.as_of())
    return dedup.drop_remembered_titles(_pages(spark, sf), mem).select("seq", "title")


_D2_SQL = _D1_SQL + f""",
d2 AS (SELECT * FROM d1 WHERE normalized_url NOT IN (SELECT normalized_url FROM memory_recent)
        AND {O.normalize_title('title')} NOT IN (SELECT lower(normalized_title) FROM memory_recent))"""


@register("dedup_memory", O.with_fixtures(_D2_SQL + "\nSELECT seq, normalized_url, title FROM d2"))
def q_dedup_memory(spark, sf):
    d = dedup.dedup_url(_pages(spark, sf))
    mem = dedup.memory_window(FX.memory_fixture(spark, sf), FX.as_of())
    return dedup.drop_remembered(d, mem).select("seq", "normalized_url", "title")


@register(
    "dedup_all",
    O.with_fixtures(_D2_SQL + O.greedy_sql("d2") + "\nSELECT d.seq, d.normalized_url, d.title FROM d2 d JOIN greedy_kept k ON k.seq = d.seq"),
)
def q_dedup_all(spark, sf):
    out = dedup.deduplicate(_pages(spark, sf), FX.memory_fixture(spark, sf), FX.as_of())
    return out.select("seq", "normalized_url", "title")
from curata.plans import q_text  # noqa: E402,F401
from curata.plans import q_store  # noqa: E402,F401
from curata.plans import q_sources  # noqa: E402,F401
from curata.plans import q_stream  # noqa: E402,F401
from curata.plans import q_runs  # noqa: E402,F401
