"""String column functions with the exact character semantics the pipeline relies on.

All functions take and return ``Column`` and stay inside Catalyst (no Python UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions import html

# Classic (non-Unicode) regex \s: space, tab, newline, vertical tab, form feed, carriage return.
WS = " \\t\\n\\x0B\\f\\r"
# Characters that a Java-style String.isBlank() treats as white space.
BLANK_CLASS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}\\x{2028}\\x{2029}\\x{205F}\\x{3000}]"
LINE_TERMINATORS = "[\\n\\r\\x{85}\\x{2028}\\x{2029}]"


def jtrim(c: Column) -> Column:
    """Trim every character <= U+0020 at both ends (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def is_blank(c: Column) -> Column:
    """NULL, empty or only white space."""
    return F.coalesce(c, F.lit("")).rlike("^" + BLANK_CLASS + "*$")


def not_blank(c: Column) -> Column:
    return ~is_blank(c)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units (astral characters count twice)."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def normalize_title(c: Column) -> Column:
    """Title key used by dedup memory: lower case, then trimmed."""
    return jtrim(F.lower(c))


def title_tokens(c: Column) -> Column:
    """Lower case, delete every char outside [a-z0-9\\s] (no space inserted), split on white space.

    NULL gives an empty array; empty tokens are dropped.
    """
    cleaned = jtrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^a-z0-9{WS}]", ""))
    return F.filter(F.split(cleaned, f"[{WS}]+"), lambda x: x != "")


def escape_text(c: Column) -> Column:
    """Escape text the way an HTML serialiser writes a text node."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit("\u00a0"), F.lit("&nbsp;"))


def strip_tags(c: Column) -> Column:
    """Tag removal for short descriptions (text kept, markup, scripts and styles dropped, output entity-escaped).

    Tags are removed (quoted attribute values may hold ``>``; a tag that never ends goes), entities decoded and the text re-escaped (``&``, ``<``, ``>``, no-break
    space), then white space is collapsed and trimmed. Blank input gives ''.
    """
    text = escape_text(html.decode_entities(html.without_markup(c)))
    collapsed = jtrim(F.regexp_replace(text, f"[{WS}]+", " "))
    return F.when(is_blank(c), F.lit("")).otherwise(collapsed)


def cut_utf16(c: Column, units: int) -> Column:
    """The first ``units`` UTF-16 code units; half of a pair at the cut goes."""
    raw = F.encode(c, "UTF-16BE")
    high = F.hex(F.substring(raw, 2 * units - 1, 1)).between("D8", "DB")
    return F.decode(F.when(high, F.substring(raw, 1, 2 * units - 2)).otherwise(F.substring(raw, 1, 2 * units)), "UTF-16BE")


def strip_truncate(c: Column, max_len: int = 500) -> Column:
    """Feed description: drop ``<...>`` tags, trim, cut at ``max_len`` UTF-16 units and add '...'."""
    t = jtrim(F.regexp_replace(c, "<[^>]+>", ""))
    return F.when(utf16_length(t) > max_len, F.concat(cut_utf16(t, max_len), F.lit("..."))).otherwise(t)


def first_words(c: Column, n: int) -> Column:
    """First ``n`` white-space separated words joined by one space."""
    return F.array_join(F.slice(F.split(c, f"[{WS}]+"), 1, n), " ")


def word_count(c: Column) -> Column:
    """Number of words after trimming (0 for blank)."""
    t = jtrim(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{WS}]+")))
