"""DuckDB SQL builders for the correctness oracle.

Each helper returns SQL text for one column expression with the same semantics as the Spark
function of the same name (RE2 patterns, explicit DOUBLE literals, 'g' for global replace).
The fixture views of ``curata.sources.fixtures`` are re-stated as CTEs in ``FIXTURE_CTES``.
"""

from __future__ import annotations

from curata.functions import vocab
from curata.sources.fixtures import AS_OF_TEXT, FIXTURE_DOMAINS

AS_OF = f"TIMESTAMP '{AS_OF_TEXT}'"
WS = r" \t\n\x0B\f\r"
BLANK_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def jtrim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def is_blank(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '^{BLANK_CLASS}*$')"


def utf16_length(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def normalize_title(x: str) -> str:
    return jtrim(f"lower({x})")


def title_tokens(x: str) -> str:
    cleaned = jtrim(f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9{WS}]', '', 'g')")
    return f"list_filter(string_split_regex({cleaned}, '[{WS}]+'), lambda tk: tk <> '')"


_SCHEME = r"^([a-z][a-z0-9+.-]*)://"
_AUTH = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_host(x: str) -> str:
    return f"nullif(regexp_extract({x}, '{_AUTH}', 1), '')"


def url_domain(x: str, fallback_to_url: bool = False) -> str:
    d = f"regexp_replace({url_host(x)}, '^www\\.', '')"
    return f"coalesce({d}, {x if fallback_to_url else q('')})"


def normalize_url(x: str) -> str:
    u = jtrim(f"lower({x})")
    scheme = f"regexp_extract({u}, '{_SCHEME}', 1)"
    host = f"regexp_extract({u}, '{_AUTH}', 1)"
    path = f"url_decode(regexp_extract({u}, '{_PATH}', 1))"
    parsed = f"regexp_replace({scheme} || '://' || {host} || {path}, '/$', '')"
    fallback = f"regexp_replace(regexp_replace({u}, '\\?.*$', ''), '/$', '')"
    return f"(CASE WHEN {x} IS NULL THEN '' WHEN {scheme} <> '' AND {host} <> '' THEN {parsed} ELSE {fallback} END)"


def normalize_url_memory(x: str) -> str:
    u = f"regexp_replace(regexp_replace({jtrim(f'lower({x})')}, '\\?.*$', ''), '/$', '')"
    return f"(CASE WHEN {x} IS NULL THEN '' ELSE {u} END)"


def article_id(x: str) -> str:
    h = f"md5({x})"
    b6 = f"lpad(lower(printf('%x', (('0x' || substr({h}, 13, 2))::INTEGER & 15) | 48)), 2, '0')"
    b8 = f"lpad(lower(printf('%x', (('0x' || substr({h}, 17, 2))::INTEGER & 63) | 128)), 2, '0')"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || {b6} || substr({h}, 15, 2) || '-' || "
        f"{b8} || substr({h}, 19, 2) || '-' || substr({h}, 21, 12))"
    )


# ---------------------------------------------------------------- scores


def combined(title: str, descr: str) -> str:
    return f"lower(coalesce({title}, '') || ' ' || coalesce({descr}, ''))"


def recency_score(p: str, as_of: str = AS_OF) -> str:
    hours = f"greatest(floor((epoch_us({as_of}) - epoch_us({p})) / 3600000000.0::DOUBLE), 0)::BIGINT"
    return (
        f"(CASE WHEN {p} IS NULL THEN 0.0::DOUBLE WHEN {hours} >= 24 THEN 0.0::DOUBLE "
        f"ELSE greatest(0.0::DOUBLE, 10.0::DOUBLE - ({hours} * 10.0::DOUBLE) / 24.0::DOUBLE) END)"
    )


def engagement_score(up: str, cm: str) -> str:
    total = f"(coalesce({up}, 0)::BIGINT + coalesce({cm}, 0)::BIGINT)"
    return (
        f"(CASE WHEN {total} <= 0 THEN 3.0::DOUBLE ELSE least(10.0::DOUBLE, "
        f"(ln(1.0::DOUBLE + {total}::DOUBLE) * 10.0::DOUBLE) / ln(10001.0::DOUBLE)) END)"
    )


def title_quality_score(t: str) -> str:
    n = utf16_length(t)
    click = f"len(list_filter({str_list(vocab.CLICKBAIT_PATTERNS)}, lambda p: contains(lower({t}), p))) > 0"
    digit = rf"(regexp_matches({t}, '[0-9]') AND NOT regexp_matches({t}, '[\n\r\x{{85}}\x{{2028}}\x{{2029}}]'))"
    s = (
        f"(2.0::DOUBLE - (CASE WHEN {click} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END)"
        f" - (CASE WHEN {n} < 20 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)"
        f" + (CASE WHEN {n} >= 30 AND {n} <= 100 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)"
        f" + (CASE WHEN {digit} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END))"
    )
    return f"(CASE WHEN {t} IS NULL THEN 0.0::DOUBLE ELSE greatest(-5.0::DOUBLE, least(5.0::DOUBLE, {s})) END)"


def keyword_matches(t: str, d: str) -> str:
    return f"len(list_filter({str_list(vocab.TRENDING_KEYWORDS)}, lambda k: contains({combined(t, d)}, k)))"


def keyword_boost(t: str, d: str) -> str:
    return f"least(3.0::DOUBLE, {keyword_matches(t, d)}::DOUBLE * 0.5::DOUBLE)"


def source_score(dom: str) -> str:
    cases = " ".join(f"WHEN {q(d)} THEN {s!r}::DOUBLE" for d, s in vocab.SOURCE_SCORES)
    return (
        f"(CASE WHEN {is_blank(dom)} THEN 5.0::DOUBLE ELSE "
        f"(CASE lower({dom}) {cases} ELSE 5.0::DOUBLE END) END)"
    )


def final_score(r: str, s: str, e: str, t: str, k: str) -> str:
    w = vocab.WEIGHTS
    return f"(({r}) * {w[0]}::DOUBLE + ({s}) * {w[1]}::DOUBLE + ({e}) * {w[2]}::DOUBLE + ({t}) * {w[3]}::DOUBLE + ({k}) * {w[4]}::DOUBLE)"


def derive_tags(t: str, d: str, src: str) -> str:
    matched = f"list_filter({str_list(vocab.TAG_KEYWORDS)}, lambda tg: contains({combined(t, d)}, lower(tg)))"
    return (
        f"(list_concat({matched}, CASE WHEN {src} IS NOT NULL AND NOT list_contains({matched}, {src}) "
        f"THEN [{src}] ELSE []::VARCHAR[] END))[1:5]"
    )


def r9(x: str) -> str:
    return f"round({x}, 9)"


# ---------------------------------------------------------------- fixture views

FIXTURE_CTES = rf"""
eng AS (
  SELECT user_id,
         CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS INTEGER) AS upvotes,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS comments,
         max(ts) AS published_at
  FROM events GROUP BY user_id
),
articles_pages AS (
  SELECT p.page_id AS seq,
         regexp_extract(p.html, '(?s)<title>(.*?)</title>', 1) AS title,
         p.url AS url,
         'web' AS source,
         ({str_list(FIXTURE_DOMAINS)})[CAST(p.page_id % 25 AS INTEGER) + 1] AS source_domain,
         regexp_extract(p.html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS description,
         e.published_at AS published_at,
         coalesce(e.upvotes, 0) AS upvotes,
         coalesce(e.comments, 0) AS comments
  FROM pages p LEFT JOIN eng e ON p.page_id = e.user_id
),
articles_documents AS (
  SELECT doc_id AS seq, trim(regexp_extract(text, '^([^.!?\n]*)', 1)) AS title FROM documents
),
texts_documents AS (SELECT doc_id AS seq, text AS title FROM documents),
memory_fixture AS (
  SELECT {normalize_url_memory('url')} AS normalized_url,
         {normalize_title('title')} AS normalized_title,
         {AS_OF} - to_hours(CAST(seq % 72 AS BIGINT)) AS ts
  FROM articles_pages
),
memory_recent AS (
  SELECT coalesce(normalized_url, '') AS normalized_url, coalesce(normalized_title, '') AS normalized_title, ts
  FROM memory_fixture WHERE ts > {AS_OF} - INTERVAL 24 HOUR
)"""


def with_fixtures(body: str) -> str:
    """``body`` is either ``SELECT ...`` or ``, name AS (...) SELECT ...``."""
    body = body.strip()
    sep = "" if body.startswith(",") else "\n"
    return f"WITH RECURSIVE {FIXTURE_CTES}{sep}{body}"


def scored_select(src: str) -> str:
    """Projection adding the six rounded score columns and tags to a relation with article columns."""
    rec = recency_score("published_at")
    srs = source_score("source_domain")
    eng_s = engagement_score("upvotes", "comments")
    ttl = title_quality_score("title")
    kw = keyword_boost("title", "description")
    fin = final_score(rec, srs, eng_s, ttl, kw)
    return (
        f"SELECT *, {r9(rec)} AS recency_score, {r9(srs)} AS source_score, {r9(eng_s)} AS engagement_score, "
        f"{r9(ttl)} AS title_quality_score, {r9(kw)} AS keyword_boost, {r9(fin)} AS final_score, "
        f"{derive_tags('title', 'description', 'source')} AS tags FROM {src}"
    )


def greedy_sql(src: str, threshold: float = 0.7) -> str:
    """CTE text (starting with ',') ending in relation ``greedy_kept(seq)``: the sequential greedy
    walk as a recursive CTE over rows in seq order, carrying the list of kept rows."""
    return rf"""
, g_tok AS (SELECT seq, unnest({title_tokens('title')}) AS token FROM {src}),
g_tf AS (SELECT seq, token, count(*)::BIGINT AS f FROM g_tok GROUP BY seq, token),
g_norm AS (SELECT seq, sum(f * f)::BIGINT AS n2 FROM g_tf GROUP BY seq),
g_dot AS (
  SELECT a.seq AS i, b.seq AS j, sum(a.f * b.f)::BIGINT AS dot
  FROM g_tf a JOIN g_tf b ON a.token = b.token AND b.seq < a.seq GROUP BY a.seq, b.seq
),
g_edges AS (
  SELECT d.i, d.j FROM g_dot d JOIN g_norm ni ON ni.seq = d.i JOIN g_norm nj ON nj.seq = d.j
  WHERE d.dot::DOUBLE / (sqrt(ni.n2::DOUBLE) * sqrt(nj.n2::DOUBLE)) > {threshold}::DOUBLE
),
g_nb AS (
  SELECT s.seq, row_number() OVER (ORDER BY s.seq) AS pos,
         coalesce(list(e.j) FILTER (WHERE e.j IS NOT NULL), []::BIGINT[]) AS earlier
  FROM (SELECT seq FROM {src}) s LEFT JOIN g_edges e ON e.i = s.seq GROUP BY s.seq
),
g_walk(pos, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT w.pos + 1,
         CASE WHEN len(list_intersect(w.kept, n.earlier)) > 0 THEN w.kept ELSE list_append(w.kept, n.seq) END
  FROM g_walk w JOIN g_nb n ON n.pos = w.pos + 1
),
greedy_kept AS (
  SELECT unnest(kept) AS seq FROM g_walk WHERE pos = (SELECT count(*) FROM g_nb)
)"""


# ---------------------------------------------------------------- cleaning and summaries


# Entities that the tables hold, with and without a semicolon; ``&amp;`` last, so nothing is decoded twice.
_ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", chr(160)), ("copy", chr(169)), ("middot", chr(183)), ("amp", "&")]


def decode_entities(x: str) -> str:
    out = f"replace({x}, '&#39;', {q(chr(39))})"
    for name, ch in _ENTITIES:
        out = rf"regexp_replace(replace({out}, '&{name};', {q(ch)}), '&{name}([^A-Za-z0-9;]|$)', {q(ch + chr(92) + '1')}, 'g')"
    return out


def escape_text(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), {q(chr(160))}, '&nbsp;')"


def first_words(x: str, n: int) -> str:
    return f"array_to_string((string_split_regex({x}, '[{WS}]+'))[1:{n}], ' ')"


def word_count(x: str) -> str:
    t = jtrim(f"coalesce({x}, '')")
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(string_split_regex({t}, '[{WS}]+')) END)"


def _gone(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def html_text(x: str, max_words: int = 800) -> str:
    """For pages whose excluded elements do not hold one another."""
    s = _gone(_gone(_gone(x, "(?s)<!--.*?(?:-->|$)"), "(?is)<script[^>]*>.*?(?:</script>|$)"), "(?is)<style[^>]*>.*?(?:</style>|$)")
    for name in ("nav", "footer", "header", "aside"):
        s = _gone(s, rf"(?is)<{name}(?:\s[^>]*)?>.*?(?:</{name}>|$)")
    s = _gone(s, '(?is)<div class="ad">.*?(?:</div>|$)')
    s = _gone(_gone(s, "(?s)</?[A-Za-z!][^>]*$"), r"(?i)</?(?:a|b|i|em|strong|span|code|small|u|sub|sup|abbr|cite|mark|font|s|q|img|input|wbr)(?:\s[^>]*)?>")
    s = _gone(s, "(?s)<[!?][^>]*>")
    s = jtrim(_gone(decode_entities(_gone(s, "(?s)<[^>]*>", " ")), f"[{WS}]+", " "))
    return f"(CASE WHEN {is_blank(x)} THEN '' ELSE {first_words(s, max_words)} END)"


_TAG = r"""(?s)<(?:/?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*|[!?/][^>]*)>"""


def strip_tags(x: str) -> str:
    s = _gone(_gone(_gone(x, "(?s)<!--.*?(?:-->|$)"), "(?is)<script[^>]*>.*?(?:</script>|$)"), "(?is)<style[^>]*>.*?(?:</style>|$)")
    # a tag as names, values in either quotes and the rest, one after another; then what a cut-off one leaves
    t = escape_text(decode_entities(_gone(_gone(s, _TAG), "(?s)</?[A-Za-z][^>]*$")))
    c = jtrim(f"regexp_replace({t}, '[{WS}]+', ' ', 'g')")
    return f"(CASE WHEN {is_blank(x)} THEN '' ELSE {c} END)"


def strip_truncate(x: str, n: int = 500) -> str:
    t = jtrim(f"regexp_replace({x}, '<[^>]+>', '', 'g')")
    # the longest prefix within n units: a character beyond the basic plane takes two
    units = f"list_transform(string_split({t}, ''), lambda ch: CASE WHEN unicode(ch) > 65535 THEN 2 ELSE 1 END)"
    fits = f"len(list_filter(range(1, len({t}) + 1), lambda k: list_sum(list_slice({units}, 1, k)) <= {n}))"
    plain = f"regexp_matches({t}, '[\\x{{10000}}-\\x{{10FFFF}}]')"
    return f"(CASE WHEN {utf16_length(t)} > {n} THEN substr({t}, 1, CASE WHEN {plain} THEN {fits} ELSE {n} END) || '...' ELSE {t} END)"


def response_text(p: str) -> str:
    return (
        f"(CASE WHEN json_valid({p}) THEN coalesce(json_extract_string({p}, '$.candidates[0].content.parts[0].text'), '') "
        f"ELSE '' END)"
    )


def clean_summary(x: str) -> str:
    s = jtrim(f"coalesce({x}, '')")
    s = f"regexp_replace({s}, '^[\"'']|[\"'']$', '', 'g')"
    s = f"regexp_replace({s}, '^Summary:\\s*', '')"
    return jtrim(s)


def is_valid_summary(x: str) -> str:
    n = word_count(x)
    return f"(NOT {is_blank(x)} AND {n} >= 5 AND {n} <= 100)"


def fallback_summary(title: str, descr: str, n: int = 80) -> str:
    d = strip_tags(descr)
    words = f"string_split_regex({d}, '[{WS}]+')"
    return (
        f"(CASE WHEN {is_blank(d)} THEN {title} WHEN len({words}) > {n} THEN array_to_string(({words})[1:{n}], ' ') || '...' "
        f"ELSE {d} END)"
    )


def content(title: str, descr: str, n: int = 800) -> str:
    return html_text(f"(CASE WHEN NOT {is_blank(descr)} THEN {descr} ELSE {title} END)", n)


def fill(template: str, max_words: int, **cols: str) -> str:
    rest = template.replace("{max_words}", str(max_words))
    parts = []
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        parts.append(q(rest[:i]))
        parts.append(f"coalesce({cols[rest[i + 1:j]]}, 'null')")
        rest = rest[j + 1:]
    parts.append(q(rest))
    return "(" + " || ".join(parts) + ")"


RESP_CTE = f""",
resp AS (
  SELECT {article_id(normalize_url('a.url'))} AS id, a.seq AS seq, CASE WHEN (c.turn // 2) % 2 = 0 THEN 1 ELSE 2 END AS attempt, c.turn AS try_no,
         CASE WHEN c.turn < 3 AND a.seq % 10 = 0 THEN '' WHEN c.turn < 3 AND a.seq % 10 = 5 THEN NULL ELSE c.text END AS text_raw
  FROM articles_pages a JOIN conversations c ON c.conv_id = a.seq
  WHERE c.role = 'assistant'
)"""
