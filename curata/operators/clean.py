"""Corpus cleaning of raw HTML pages into plain text (first N words).

Catalyst expressions only: a walk over the page's tags drops excluded elements with all they hold
(see ``functions.html``), inline tags vanish, other tags become a space, entities are decoded, white
space collapses and the text is cut to ``max_words`` words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import html, text, vocab


def html_text(c: Column, max_words: int = vocab.CONTENT_MAX_WORDS) -> Column:
    """Plain text of an HTML string, first ``max_words`` words; blank input gives ''."""
    s = text.jtrim(F.regexp_replace(html.visible_text(c), f"[{text.WS}]+", " "))
    return F.when(text.is_blank(c), F.lit("")).otherwise(text.first_words(s, max_words))


def clean_pages(df: DataFrame, html_col: str = "html", max_words: int = vocab.CONTENT_MAX_WORDS, out_col: str = "text") -> DataFrame:
    """Add ``out_col`` with the cleaned text of ``html_col`` (drops the HTML column)."""
    return df.withColumn(out_col, html_text(F.col(html_col), max_words)).drop(html_col)
