"""Registered queries: source parse jobs over payloads landed from the pages fixture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from curata.plans import oracle as O
from curata.plans.catalog import register
from curata.sources import feeds, landing
from curata.sources import fixtures as FX

COLS = feeds.ARTICLE_COLUMNS
_COLS = ", ".join(COLS)
_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
_SEC = "coalesce(date_trunc('second', published_at), " + _EPOCH + ")"

_HN_SQL = f""",
hn_src AS (
  SELECT seq, CASE WHEN seq % 10 = 9 THEN 'job' ELSE 'story' END AS type, upvotes * 2 AS score,
         CASE WHEN seq % 17 = 0 THEN '' ELSE url END AS url2, {O.jtrim('title')} AS t, comments, published_at
  FROM articles_pages WHERE seq % 23 <> 0
),
hn AS (
  SELECT seq AS id, t AS title, url2 AS url, 'hackernews' AS source, {O.url_domain('url2')} AS source_domain,
         NULL::VARCHAR AS description, NULL::VARCHAR AS image_url, {_SEC} AS published_at,
         CAST(score AS INTEGER) AS upvotes, comments
  FROM hn_src WHERE type = 'story' AND score >= 50 AND NOT {O.is_blank('url2')} AND NOT {O.is_blank('t')}
)"""

_GNEWS_SQL = f""",
gn_src AS (
  SELECT *, CASE WHEN seq % 9 = 0 THEN '  ' || title || ' ' ELSE title END AS t0,
         CASE WHEN seq % 3 = 0 THEN '' ELSE coalesce('https://www.' || source_domain || '/', '') END AS src_url
  FROM articles_pages WHERE (seq // 50) % 7 <> 3
),
gn AS (
  SELECT {O.jtrim('t0')} AS title, {O.jtrim('url')} AS url, 'gnews' AS source,
         {O.url_domain(f"CASE WHEN {O.is_blank('src_url')} THEN {O.jtrim('url')} ELSE src_url END")} AS source_domain,
         coalesce(description, '') AS description,
         CASE WHEN seq % 2 = 0 THEN 'https://img.example.com/' || seq || '.jpg' ELSE '' END AS image_url,
         CASE WHEN seq % 13 = 0 OR published_at IS NULL THEN {O.AS_OF} ELSE date_trunc('second', published_at)
              + CASE WHEN seq % 5 = 2 THEN INTERVAL 250 MILLISECOND ELSE INTERVAL 0 SECOND END END AS published_at,
         0 AS upvotes, 0 AS comments
  FROM gn_src WHERE NOT {O.is_blank(O.jtrim('t0'))} AND NOT {O.is_blank(O.jtrim('url'))}
)"""

_ENDPOINTS = O.str_list(feeds.REDDIT_ENDPOINTS)
_REDDIT_SQL = f""",
rd_src AS (
  SELECT seq, {O.jtrim('title')} AS t,
         {O.jtrim("CASE WHEN seq % 8 = 0 THEN 'https://www.reddit.com/r/technology/comments/' || seq ELSE url END")} AS u,
         upvotes * 4 AS score, comments * 2 AS nc,
         CASE WHEN seq % 6 = 0 THEN true WHEN seq % 6 = 1 THEN NULL ELSE false END AS is_self,
         published_at,
         CASE WHEN seq % 2 = 0 THEN 'https://thumbs.example.com/' || seq || '.jpg' ELSE 'self' END AS thumb,
         coalesce(CASE WHEN seq % 5 = 0 THEN NULL ELSE 'r/technology' END, ({_ENDPOINTS})[CAST((seq // 50) % 4 AS INTEGER) + 1]) AS sub
  FROM articles_pages
),
rd AS (
  SELECT t AS title, u AS url, 'reddit' AS source, {O.url_domain('u')} AS source_domain,
         sub || ' — ' || score::VARCHAR || ' upvotes, ' || nc::VARCHAR || ' comments' AS description,
         CASE WHEN starts_with(thumb, 'http') THEN thumb ELSE '' END AS image_url,
         {_SEC} AS published_at, CAST(score AS INTEGER) AS upvotes, CAST(nc AS INTEGER) AS comments
  FROM rd_src
  WHERE NOT coalesce(is_self, true) AND NOT contains(u, 'reddit.com') AND score >= 100 AND nc >= 20
        AND NOT {O.is_blank('t')} AND NOT {O.is_blank('u')}
)"""

_FEEDS = O.str_list(feeds.RSS_FEEDS)
_RSS_SQL = f""",
rs_src AS (
  SELECT seq, ({_FEEDS})[CAST((seq // 50) % 3 AS INTEGER) + 1] AS feed_url, {O.jtrim('title')} AS t, {O.jtrim('url')} AS u,
         CASE WHEN seq % 3 = 2 OR published_at IS NULL THEN {O.AS_OF} ELSE date_trunc('second', published_at) END AS p,
         description
  FROM articles_pages
),
rs AS (
  SELECT t AS title, u AS url, 'rss' AS source, {O.url_domain('feed_url', True)} AS source_domain,
         CASE WHEN description IS NULL THEN '' ELSE {O.strip_truncate('description')} END AS description,
         CASE seq % 4 WHEN 0 THEN 'https://media.example.com/c' || seq || '.jpg' WHEN 1 THEN 'https://media.example.com/t' || seq || '.jpg'
              WHEN 2 THEN 'https://media.example.com/t' || seq || '.jpg'
              ELSE CASE WHEN seq % 8 = 3 THEN 'https://media.example.com/y' || seq || '.jpg' ELSE '' END END AS image_url,
         p AS published_at, 0 AS upvotes, 0 AS comments
  FROM rs_src WHERE NOT {O.is_blank('t')} AND NOT {O.is_blank('u')} AND p >= {O.AS_OF} - INTERVAL 12 HOUR
)"""


_ATOM_SQL = f""",
atom_src AS (
  SELECT seq, CASE WHEN seq % 11 = 0 THEN '' ELSE {O.jtrim('title')} END AS t, {O.jtrim('url')} AS u, description,
         CASE WHEN seq % 3 = 2 OR published_at IS NULL THEN {O.AS_OF} ELSE date_trunc('second', published_at) END AS p
  FROM articles_pages
),
atom AS (
  SELECT t AS title, u AS url, 'rss' AS source, 'theverge.com' AS source_domain,
         CASE WHEN description IS NULL THEN '' ELSE {O.strip_truncate('description')} END AS description,
         '' AS image_url, p AS published_at, 0 AS upvotes, 0 AS comments
  FROM atom_src WHERE NOT {O.is_blank('t')} AND NOT {O.is_blank('u')} AND p >= {O.AS_OF} - INTERVAL 12 HOUR
)"""


def _hn(spark, sf):
    return feeds.parse_hn_items(landing.hn_item_payloads(spark, sf))


def _gnews(spark, sf):
    return feeds.parse_gnews(landing.gnews_envelopes(spark, sf), FX.as_of())


def _reddit(spark, sf):
    return feeds.parse_reddit(landing.reddit_listings(spark, sf))


def _rss(spark, sf):
    return feeds.parse_rss(landing.rss_items(spark, sf), FX.as_of())


@register("src_hn_items", O.with_fixtures(_HN_SQL + f"\nSELECT id, {_COLS} FROM hn"))
def q_src_hn_items(spark, sf):
    return _hn(spark, sf)


@register(
    "src_hn_top_ids",
    O.with_fixtures(
        _HN_SQL
        + f""",
lists AS (SELECT seq // 150 AS list_id, CAST(row_number() OVER (PARTITION BY seq // 150 ORDER BY upvotes * 2 DESC, seq) - 1 AS INTEGER) AS pos, seq AS id FROM articles_pages)
SELECT l.list_id, l.pos, h.id, h.title, h.upvotes FROM lists l JOIN hn h ON h.id = l.id WHERE l.pos < 100"""
    ),
)
def q_src_hn_top_ids(spark, sf):
    s = feeds.hn_top_stories(landing.hn_id_lists(spark, sf), landing.hn_item_payloads(spark, sf))
    return s.select("list_id", "pos", "id", "title", "upvotes")


@register("src_gnews", O.with_fixtures(_GNEWS_SQL + f"\nSELECT {_COLS} FROM gn"))
def q_src_gnews(spark, sf):
    return _gnews(spark, sf)


@register("src_reddit", O.with_fixtures(_REDDIT_SQL + f"\nSELECT {_COLS} FROM rd"))
def q_src_reddit(spark, sf):
    return _reddit(spark, sf)


@register("src_rss", O.with_fixtures(_RSS_SQL + f"\nSELECT {_COLS} FROM rs"))
def q_src_rss(spark, sf):
    return _rss(spark, sf)


@register("src_atom", O.with_fixtures(_ATOM_SQL + f"\nSELECT {_COLS} FROM atom"))
def q_src_atom(spark, sf):
    return feeds.parse_rss(landing.atom_entries(spark, sf), FX.as_of(), atom=True)


@register(
    "src_union",
    O.with_fixtures(
        _HN_SQL + _GNEWS_SQL + _REDDIT_SQL + _RSS_SQL
        + f"\nSELECT {_COLS} FROM hn UNION ALL SELECT {_COLS} FROM gn UNION ALL SELECT {_COLS} FROM rd UNION ALL SELECT {_COLS} FROM rs"
    ),
)
def q_src_union(spark, sf):
    return feeds.union_sources(_hn(spark, sf), _gnews(spark, sf), _reddit(spark, sf), _rss(spark, sf))


@register(
    "src_rejects",
    O.with_fixtures(
        f""", rj AS (
  SELECT seq, CASE WHEN seq % 23 = 0 THEN 'malformed' WHEN seq % 10 = 9 THEN 'not_story' WHEN upvotes * 2 < 50 THEN 'low_score'
                   WHEN seq % 17 = 0 OR {O.is_blank('url')} THEN 'blank_url' WHEN {O.is_blank(O.jtrim('title'))} THEN 'blank_title' END AS reason
  FROM articles_pages
)
SELECT seq, reason FROM rj WHERE reason IS NOT NULL"""
    ),
)
def q_src_rejects(spark, sf):
    return feeds.hn_rejects(landing.hn_item_payloads(spark, sf))


@register(
    "src_rejects_all",
    O.with_fixtures(
        _GNEWS_SQL + _REDDIT_SQL + _RSS_SQL + f""", rj AS (
  SELECT 'hackernews' AS source, seq::VARCHAR AS ref,
         CASE WHEN seq % 23 = 0 THEN 'malformed' WHEN seq % 10 = 9 THEN 'not_story' WHEN upvotes * 2 < 50 THEN 'low_score'
              WHEN seq % 17 = 0 OR {O.is_blank('url')} THEN 'blank_url' WHEN {O.is_blank(O.jtrim('title'))} THEN 'blank_title' END AS reason
  FROM articles_pages
  UNION ALL
  SELECT DISTINCT 'gnews', (seq // 50)::VARCHAR, 'no_articles' FROM articles_pages WHERE (seq // 50) % 7 = 3
  UNION ALL
  SELECT 'gnews', (seq // 50)::VARCHAR, CASE WHEN {O.is_blank(O.jtrim('t0'))} THEN 'blank_title' WHEN {O.is_blank(O.jtrim('url'))} THEN 'blank_url' END FROM gn_src
  UNION ALL
  SELECT 'reddit', ({_ENDPOINTS})[CAST((seq // 50) % 4 AS INTEGER) + 1],
         CASE WHEN coalesce(is_self, true) THEN 'self_post' WHEN contains(u, 'reddit.com') THEN 'internal_link' WHEN score < 100 THEN 'low_score'
              WHEN nc < 20 THEN 'few_comments' WHEN {O.is_blank('t')} THEN 'blank_title' WHEN {O.is_blank('u')} THEN 'blank_url' END FROM rd_src
  UNION ALL
  SELECT 'rss', seq::VARCHAR, CASE WHEN {O.is_blank('t')} THEN 'blank_title' WHEN {O.is_blank('u')} THEN 'blank_url'
         WHEN p < {O.AS_OF} - INTERVAL 12 HOUR THEN 'too_old' END FROM rs_src
)
SELECT source, ref, reason FROM rj WHERE reason IS NOT NULL"""
    ),
)
def q_src_rejects_all(spark, sf):
    """Everything landed that yields no article: payloads of every source, and single articles, posts and items."""
    gnews, reddit, rss = landing.gnews_envelopes(spark, sf), landing.reddit_listings(spark, sf), landing.rss_items(spark, sf)
    ref = lambda rows, source, col: rows.select(F.lit(source).alias("source"), F.col(col).cast("string").alias("ref"), "reason")
    parts = [
        ref(feeds.hn_rejects(landing.hn_item_payloads(spark, sf)), "hackernews", "seq"),
        ref(feeds.payload_rejects(gnews, "gnews"), "gnews", "chunk"), ref(feeds.gnews_rejects(gnews, FX.as_of()), "gnews", "chunk"),
        ref(feeds.payload_rejects(reddit, "reddit"), "reddit", "endpoint"), ref(feeds.reddit_rejects(reddit), "reddit", "endpoint"),
        ref(feeds.payload_rejects(rss, "rss"), "rss", "seq"), ref(feeds.rss_rejects(feeds.read_items(rss), FX.as_of()), "rss", "seq"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
