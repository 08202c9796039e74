"""Summary text functions: prompts, response extraction, cleanup, validation and fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions import text, vocab

# FIXED VALUES: prompt templates, written out in full; {max_words}, {title}, {content} are filled in.
PROMPT_TEMPLATE = (
    "You are a tech news summarizer for developers.\n"
    "Write a concise, engaging summary of the following tech article in EXACTLY {max_words} words or fewer.\n"
    "Be clear and specific. No fluff. Developer-focused tone. No clickbait.\n"
    "Start directly with the key information — no intro phrase like \"This article...\".\n"
    "\n"
    "Title: {title}\n"
    "\n"
    "Content: {content}\n"
    "\n"
    "Summary:"
)
SIMPLE_PROMPT_TEMPLATE = (
    "Summarize this tech news headline in {max_words} words or fewer.\n"
    "Be direct and informative. Developer-focused.\n"
    "\n"
    "Headline: {title}\n"
    "\n"
    "Summary:"
)
RESPONSE_TEXT_PATH = "$.candidates[0].content.parts[0].text"


def _fill(template: str, max_words: int, **cols: Column) -> Column:
    """Concatenate literal pieces and columns (no format-string interpretation of the values)."""
    pieces: list[Column] = []
    rest = template.replace("{max_words}", str(max_words))
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        pieces.append(F.lit(rest[:i]))
        pieces.append(F.coalesce(cols[rest[i + 1 : j]], F.lit("null")))
        rest = rest[j + 1 :]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def prompt(title: Column, content: Column, max_words: int = vocab.SUMMARY_MAX_WORDS) -> Column:
    return _fill(PROMPT_TEMPLATE, max_words, title=title, content=content)


def simple_prompt(title: Column, max_words: int = vocab.SUMMARY_MAX_WORDS) -> Column:
    return _fill(SIMPLE_PROMPT_TEMPLATE, max_words, title=title)


def response_text(payload: Column) -> Column:
    """First candidate's first part text; '' when the payload is malformed or the path is missing."""
    return F.coalesce(F.get_json_object(payload, RESPONSE_TEXT_PATH), F.lit(""))


def clean_summary(c: Column) -> Column:
    """Trim, drop one leading and one trailing quote, then a leading 'Summary:' label, trim again."""
    s = text.jtrim(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, "^[\"']|[\"']$", "")
    s = F.regexp_replace(s, "^Summary:\\s*", "")
    return text.jtrim(s)


def is_valid_summary(c: Column) -> Column:
    """Nonblank and 5..100 words."""
    n = text.word_count(c)
    return text.not_blank(c) & (n >= vocab.SUMMARY_MIN_VALID_WORDS) & (n <= vocab.SUMMARY_MAX_VALID_WORDS)


def fallback_summary(title: Column, description: Column, max_words: int = vocab.SUMMARY_MAX_WORDS) -> Column:
    """Tag-stripped description, cut to ``max_words`` words + '...'; the title when blank."""
    d = text.strip_tags(description)
    words = F.split(d, f"[{text.WS}]+")
    cut = F.when(F.size(words) > max_words, F.concat(F.array_join(F.slice(words, 1, max_words), " "), F.lit("..."))).otherwise(d)
    return F.when(text.is_blank(d), title).otherwise(cut)
