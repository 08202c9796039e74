"""Per-row score expressions (recency, engagement, title quality, keywords, tags).

Everything is a Catalyst expression; vocabularies are literal arrays so ``exists``/``filter``
run inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions import vocab
from curata.functions.text import LINE_TERMINATORS, utf16_length

SCORE_DECIMALS = 9


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _combined(title: Column, description: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def recency_score(published: Column, as_of: Column) -> Column:
    """10 at age 0, linear in whole hours, 0 from 24 h on; future times count as age 0; NULL -> 0."""
    micros = F.timestamp_diff("MICROSECOND", published, as_of)
    # whole hours, truncated; negative ages count as 0
    hours = F.greatest(F.floor(micros / F.lit(3_600_000_000)), F.lit(0)).cast("long")
    score = F.greatest(F.lit(0.0), F.lit(10.0) - (hours * F.lit(10.0)) / F.lit(24.0))
    return F.when(published.isNull(), F.lit(0.0)).when(hours >= 24, F.lit(0.0)).otherwise(score)


def engagement_score(upvotes: Column, comments: Column) -> Column:
    """log-scaled upvotes + comments; a total <= 0 is the neutral 3.0."""
    total = F.coalesce(upvotes, F.lit(0)).cast("long") + F.coalesce(comments, F.lit(0)).cast("long")
    scaled = F.least(F.lit(10.0), (F.log1p(total.cast("double")) * F.lit(10.0)) / F.log1p(F.lit(10000.0)))
    return F.when(total <= 0, F.lit(3.0)).otherwise(scaled)


def title_quality_score(title: Column) -> Column:
    """2.0 base, -3 once for a clickbait phrase, -2 under 20 UTF-16 units, +2 for 30..100,
    +0.5 if the title is one line containing a digit; clamped to [-5, 5]; NULL -> 0."""
    low = F.lower(title)
    clickbait = F.exists(_lit_array(vocab.CLICKBAIT_PATTERNS), lambda p: F.instr(low, p) > 0)
    n = utf16_length(title)
    has_digit_one_line = title.rlike("[0-9]") & ~title.rlike(LINE_TERMINATORS)
    s = (
        F.lit(2.0)
        - F.when(clickbait, F.lit(3.0)).otherwise(F.lit(0.0))
        - F.when(n < 20, F.lit(2.0)).otherwise(F.lit(0.0))
        + F.when((n >= 30) & (n <= 100), F.lit(2.0)).otherwise(F.lit(0.0))
        + F.when(has_digit_one_line, F.lit(0.5)).otherwise(F.lit(0.0))
    )
    return F.when(title.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), s)))


def keyword_matches(title: Column, description: Column) -> Column:
    txt = _combined(title, description)
    return F.size(F.filter(_lit_array(vocab.TRENDING_KEYWORDS), lambda k: F.instr(txt, k) > 0))


def keyword_boost(title: Column, description: Column) -> Column:
    """min(3, 0.5 per distinct vocabulary entry contained in lower(title + ' ' + description))."""
    return F.least(F.lit(3.0), keyword_matches(title, description).cast("double") * F.lit(0.5))


def final_score(rec: Column, src: Column, eng: Column, ttl: Column, kw: Column) -> Column:
    w = vocab.WEIGHTS
    return (rec * F.lit(w[0])) + (src * F.lit(w[1])) + (eng * F.lit(w[2])) + (ttl * F.lit(w[3])) + (kw * F.lit(w[4]))


def derive_tags(title: Column, description: Column, source: Column) -> Column:
    """Vocabulary tags in vocabulary order, then the source; distinct; first five."""
    txt = _combined(title, description)
    matched = F.filter(_lit_array(vocab.TAG_KEYWORDS), lambda t: F.instr(txt, F.lower(t)) > 0)
    extra = F.when(source.isNotNull() & ~F.array_contains(matched, source), F.array(source)).otherwise(
        F.array().cast("array<string>")
    )
    return F.slice(F.concat(matched, extra), 1, 5)


def rounded(c: Column) -> Column:
    return F.round(c, SCORE_DECIMALS)
