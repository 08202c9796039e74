"""HTML as columns: entity decoding and a tag walk, inside Catalyst and linear in the text.

``visible_text`` cuts a document into tags and text and walks them once with a stack that is empty
outside excluded elements. An excluded element (by name, or by a word of its class attribute, in any
quoting) is skipped up to its own end: its end tag, the implied end of elements whose end tag may be
left out, or the end of the element around it. One that never ends takes the rest of the document,
as in a parser.
"""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: elements and class words that are not content.
EXCLUDED_TAGS = ["script", "style", "nav", "footer", "header", "aside"]
EXCLUDED_CLASSES = ["ad", "advertisement", "social-share"]
# Elements of the HTML standard: those inside a line of text, those without content, and what ends an
# element whose end tag may be left out.
INLINE_TAGS = ["a", "b", "i", "em", "strong", "span", "code", "small", "u", "sub", "sup", "abbr", "cite", "mark", "font", "s", "q", "img", "input", "wbr"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
_BLOCKS = ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul").split()
_ROWS = ["tbody", "tfoot", "thead"]
ENDED_BY = {"li": ["li"], "p": _BLOCKS, "td": ["td", "th", "tr", *_ROWS], "th": ["td", "th", "tr", *_ROWS], "tr": ["tr", *_ROWS],
            "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option", "optgroup"]}

# The rest of a tag: a quote after ``=`` hides what it encloses, also ``>``; one that never ends takes the rest.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|$)|'[^']*+(?:'|$))?+)*+"""
_RAW = rf"<!--.*?(?:-->|$)|<(script|style)(?=[\s/>]){_REST}>.*?(?:</\1(?=[\s/>]){_REST}>|$)"
#: Comments, script and style elements, tags and declarations.
MARKUP = rf"(?is){_RAW}|</?[a-z]{_REST}(?:>|$)|<[!?/][^>]*(?:>|$)"
TOKEN = rf"{MARKUP}|[^<]+|<"
_CLASS = r"""(?is)^<[^\s>]+(?:.*?[\s"'/])?class\s*=\s*(?:"(?:[^"]*\s)?(?:WORDS)(?:\s[^"]*)?"|'(?:[^']*\s)?(?:WORDS)(?:\s[^']*)?'|(?:WORDS)(?=[\s>/]))"""
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?|[^&]+|&"
#: Names that also stand without a semicolon.
_BARE = sorted(n for n in html5 if not n.endswith(";"))
#: All names, dealt by checksum over small maps, since a lookup goes through a map's keys one by one.
_MAPS = 128
_NAMES = json.dumps([{n[:-1]: x for n, x in sorted(html5.items()) if n.endswith(";") and zlib.crc32(n[:-1].encode()) % _MAPS == k} for k in range(_MAPS)])
_BLOCK = 64


def _char(code: Column) -> Column:
    """The character of a code point; the replacement character for what is none."""
    ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(F.lit(0xFFFD)).cast("bigint")), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Named and numeric character references, each decoded once; unknown ones stay."""
    maps = F.from_json(F.lit(_NAMES), "array<map<string,string>>")  # folded to a constant by Catalyst

    def one(t: Column) -> Column:
        body = F.regexp_replace(t, "^&|;$", "")
        named = F.when(t.endswith(";") | body.isin(_BARE), F.element_at(F.get(maps, (F.crc32(body.cast("binary")) % _MAPS).cast("int")), body))
        number = F.when(body.rlike("^#[0-9]"), F.lit(True)).otherwise(F.lit(False))
        code = F.when(number, F.substring(body, 2, 8).try_cast("bigint")).otherwise(F.conv(F.substring(body, 3, 8), 16, 10).try_cast("bigint"))
        return F.when(~t.startswith("&") | (t == "&"), t).when(body.startswith("#"), _char(code)).otherwise(F.coalesce(named, t))

    parts = F.transform(F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0)), one)
    return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)


def without_markup(c: Column) -> Column:
    """The text outside tags, comments, and script and style elements, entities as they stand."""
    return F.regexp_replace(c, MARKUP, "")


def visible_text(c: Column) -> Column:
    """The text outside tags and excluded elements, entities decoded, a space for each tag that is not inline."""
    words = "|".join(EXCLUDED_CLASSES)

    def token(t: Column) -> Column:
        tag, close = t.rlike(r"^(?!(?i:<(?:script|style)[\s/>]))</?[A-Za-z]"), t.startswith("</")
        name = F.lower(F.regexp_extract(t, "^</?([A-Za-z][^\\s/>]*)", 1))
        whole = t.endswith(">")
        raw = t.rlike(r"^(?:<!--|(?i:<(?:script|style)[\s/>]))")
        kind = F.when(~t.startswith("<") | (t == "<"), "text").when(~tag | ~whole | name.isin(VOID_TAGS), "void").when(close, "close").otherwise("open")
        bad = F.when(tag & ~close, name.isin(EXCLUDED_TAGS) | (F.contains(t, F.lit("=")) & t.rlike(_CLASS.replace("WORDS", words)))).otherwise(F.lit(False))
        shown = F.when(~t.startswith("<") | (t == "<"), decode_entities(t)).when(raw | ~whole | ~tag | name.isin(INLINE_TAGS), "").otherwise(" ")
        return F.struct(kind.alias("kind"), name.alias("name"), bad.alias("bad"), shown.alias("shown"))

    ends = [f"{k}>{x}" for k, v in ENDED_BY.items() for x in v]
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        stack, name = acc["stack"], x["name"]
        implied = (x["kind"] == "open") & F.concat(F.coalesce(F.get(stack, F.size(stack) - 1), F.lit("")), F.lit(">"), name).isin(ends)
        base = F.when(implied, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(stack)
        back = F.array_position(F.reverse(stack), name)
        ended = F.when(back > 0, F.slice(stack, F.lit(1), (F.size(stack) - back).cast("int"))).when(~name.isin([*INLINE_TAGS, "p"]), none).otherwise(stack)
        after = (
            F.when((x["kind"] == "open") & (F.size(base) > 0), F.concat(base, F.array(name)))
            .when((x["kind"] == "open") & x["bad"], F.array(name)).when(x["kind"] == "open", none)
            .when((x["kind"] == "close") & (F.size(stack) > 0), ended).otherwise(stack)
        )
        own_end = (x["kind"] == "close") & (F.size(stack) > 0) & (back > 0)
        return F.struct(after.alias("stack"), F.concat(acc["out"], F.array(F.when((F.size(after) == 0) & ~own_end, x["shown"]).otherwise(F.lit("")))).alias("out"))

    # blocks of tokens, so that growing the output never copies more than a block
    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["stack"].alias("stack"), none.alias("out")), step)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["stack"].alias("stack"), F.concat(acc["out"], F.array(F.array_join(r["out"], ""))).alias("out"))), F.lit(0))

    tokens = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), token)
    cut = F.get(F.transform(F.array(tokens), lambda a: F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(_BLOCK)), lambda s: F.slice(a, s, _BLOCK))), F.lit(0))
    return F.aggregate(cut, F.struct(none.alias("stack"), none.alias("out")), block, lambda acc: F.array_join(acc["out"], ""))
