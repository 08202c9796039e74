"""URL column functions: domain extraction and the two URL normalisers.

``try_parse_url`` parses with the JVM's URI rules and returns NULL instead of failing under
ANSI mode; no Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.text import jtrim


def _host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def url_domain(c: Column, fallback_to_url: bool = False) -> Column:
    """Host without one leading ``www.``; unparsable or host-less URLs give '' (or the URL itself
    when ``fallback_to_url`` – the feed-host variant)."""
    d = F.regexp_replace(_host(c), "^www\\.", "")
    return F.coalesce(d, c if fallback_to_url else F.lit(""))


def normalize_url(c: Column) -> Column:
    """Dedup key: ``scheme://host + decoded path`` of the lower-cased, trimmed URL, one trailing
    '/' removed. Port, user info, query and fragment are dropped. When the URL has no scheme or
    host (or does not parse) the fallback is: lower, trim, cut at '?', strip one trailing '/'.
    NULL gives ''."""
    u = jtrim(F.lower(c))
    scheme = F.try_parse_url(u, F.lit("PROTOCOL"))
    host = _host(u)
    raw_path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    path = F.try_url_decode(F.replace(raw_path, F.lit("+"), F.lit("%2B")))
    parsed = F.regexp_replace(F.concat(scheme, F.lit("://"), host, path), "/$", "")
    fallback = F.regexp_replace(F.regexp_replace(u, "\\?.*$", ""), "/$", "")
    out = F.when(scheme.isNotNull() & host.isNotNull() & path.isNotNull(), parsed).otherwise(fallback)
    return F.when(c.isNull(), F.lit("")).otherwise(out)


def normalize_url_memory(c: Column) -> Column:
    """Memory key: lower, trim, cut at '?', strip one trailing '/'. Keeps port and fragment."""
    u = F.regexp_replace(F.regexp_replace(jtrim(F.lower(c)), "\\?.*$", ""), "/$", "")
    return F.when(c.isNull(), F.lit("")).otherwise(u)


def article_id(normalized_url: Column, url: Column | None = None) -> Column:
    """Name-based (version 3, MD5) UUID of the normalised URL (the raw URL when it is NULL)."""
    base = normalized_url if url is None else F.coalesce(normalized_url, url)
    h = F.md5(F.encode(base, "UTF-8"))
    # Set the version nibble to 3 and the variant bits to 10xx, then format 8-4-4-4-12.
    b6 = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 13, 2), 16, 10).cast("int").bitwiseAND(0x0F).bitwiseOR(0x30)), 2, "0"))
    b8 = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)), 2, "0"))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(b6, F.substring(h, 15, 2)),
        F.concat(b8, F.substring(h, 19, 2)),
        F.substring(h, 21, 12),
    )
