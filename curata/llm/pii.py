"""Format-preserving pseudonyms for personal data.

Numbers and dates are recognised by form and validated (check digits, octets, number plans, the
calendar). A valid value's free digits become one integer, a keyed Feistel network permutes the
integers of that format (walking on until the result is in range again), and the result is written
back in the same form: a card stays a valid card of that length, a date a valid date written the
same way. A permutation has no collisions, so equal values stay linked across documents and
different ones stay apart, whatever their spacing. Email names keep their letters' and digits' places.

Defined results: null stays null and empty stays empty; values that fail validation stay as they are;
equal rows get equal results; an empty table gives an empty result; further columns pass through
:func:`pseudonymise` unchanged, and its new columns get names that the table does not have.
"""

from __future__ import annotations

import hashlib
import ipaddress
import os
import re
from bisect import bisect, bisect_left
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Setting that holds the key of :func:`op3_pii`. Without it each application draws a key of its own, which nobody can
#: read from this source; pseudonyms are then linked within the application only.
KEY_SETTING = "spark.curata.pii.key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
# Month names, in order.
MONTHS = "January February March April May June July August September October November December".split()
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
_DRAWN_KEY = os.urandom(32)
# Two-digit calling codes (+1 and +7 have one digit, all others three), and prefixes and lengths of card issuers.
_TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ISSUERS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:2[2-9]|[3-6]\d|7[01])\d{13}|2720\d{12}|3[47]\d{13}"
                      r"|(?:6011|65\d\d|64[4-9]\d|62\d\d|35(?:2[89]|[3-8]\d))\d{12,15}|3(?:0[0-5]|[689]\d)\d{11,16}|(?:50|5[6-9]|6\d)\d{11,17}")


# ---------------------------------------------------------------- the permutation

def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network over an even number of bits, walked into range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            h = hashlib.blake2b(f"{tweak}|{size}|{r}|{right}".encode(), key=key[:64], digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(h, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def _mixed(digits: list[int], bases: list[int], key: bytes, tweak: str) -> list[int]:
    """Permute digits of mixed bases as one number."""
    value, size = 0, 1
    for d, b in zip(digits, bases):
        value, size = value * b + d, size * b
    value, out = permute(value, size, key, tweak), []
    for b in reversed(bases):
        value, d = divmod(value, b)
        out.append(d)
    return out[::-1]


def _refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


# ---------------------------------------------------------------- the formats

def _luhn(payload: str) -> str:
    total = sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def card(text: str, key: bytes) -> str | None:
    d = re.sub(r"[ -]", "", text)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or _luhn(d[:-1]) != d[-1]:
        return None
    free = f"{permute(int(d[:-1]), 10 ** (len(d) - 1), key, 'card'):0{len(d) - 1}d}"
    return _refill(text, free + _luhn(free))


def ip(text: str, key: bytes) -> str | None:
    if ":" in text:
        if not re.search("[0-9]", text) or (text.count(":") < 3 and not text.startswith("::")):
            return None  # rather a name with a scope
        try:
            value = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        return str(ipaddress.IPv6Address(permute(value, 1 << 128, key, "ip6")))
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, _mixed([int(p) for p in parts], [256] * 4, key, "ip")))


@lru_cache(None)
def _days(late: bool) -> list[int]:
    """All days from ``FIRST_DAY`` to ``LAST_DAY`` that are (not) after the 12th of their month."""
    return [n for n in range(FIRST_DAY, LAST_DAY + 1) if (date.fromordinal(n).day > 12) == late]


def _other_day(y: int, mo: int, d: int, key: bytes) -> date | None:
    """A date's pseudonym. Days up to the 12th and later ones are permuted apart, so that a day and month which could be
    read in one order only are read in that order again, and one date is linked in all forms."""
    try:
        n = date(y, mo, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= n <= LAST_DAY:
        return None
    days = _days(d > 12)
    return date.fromordinal(days[permute(bisect_left(days, n), len(days), key, f"date{d > 12}")])


def day(text: str, key: bytes) -> str | None:
    """ISO, or day and month before the year: the day first where that is a date, else the month; or with the month's name."""
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", text)
    if m:
        got = _other_day(int(m[1]), int(m[2]), int(m[3]), key)
        return got and got.isoformat()
    m = re.search("[A-Za-z]+", text)
    if m:
        month = next((k for k, name in enumerate(MONTHS, 1) if m[0] in (name, name[:3])), 0)
        numbers = re.findall("[0-9]+", text)
        got = _other_day(int(numbers[1]), month, int(numbers[0]), key) if month else None
        if got is None:
            return None
        name = MONTHS[got.month - 1]
        form = re.sub("[0-9]+", "{}", text.replace(m[0], name[:3] if len(m[0]) == 3 and m[0] != "May" else name))
        return form.format(f"{got.day:02d}" if numbers[0][0] == "0" else got.day, got.year)
    a, b, y = map(int, re.split(r"[./-]", text))
    got, first = _other_day(y, b, a, key), "day"
    if got is None:
        got, first = _other_day(y, a, b, key), "month"
    if got is None:
        return None
    sep = re.search(r"[./-]", text)[0]
    pad = 2 if re.match(r"0\d|\d\d[./-]\d\d", text) else 1
    x, z = (got.day, got.month) if first == "day" else (got.month, got.day)
    return f"{x:0{pad}d}{sep}{z:0{pad}d}{sep}{got.year}"


def ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, re.split("[ -]", text))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    a, g, s = _mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
    a += 1
    return _refill(text, f"{a + (a >= 666):03d}{g + 1:02d}{s + 1:04d}")


def calling_code(digits: str) -> str:
    return digits[:1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3]


def phone(text: str, key: bytes) -> str | None:
    """Digits alone decide, so a number has one pseudonym in any spacing, with or without +1."""
    d = re.sub(r"\D", "", text)
    code = calling_code(d) if text[0] == "+" else "1" if len(d) == 11 and re.match(r"1[ .(-]", text) else "0" if text[0] == "0" else ""
    own = d[len(code):]
    if not 8 <= len(d) <= 15:
        return None
    if len(own) == 10 and code in ("", "1"):  # North American plan: area and exchange start at 2; with 0 or 1 a format of its own
        low = [2 * (k in (0, 3) and c >= "2") for k, c in enumerate(own)]
        bases = [10 if k not in (0, 3) else 8 if x else 2 for k, x in enumerate(low)]
        kind = "phone1" + "".join("" if low[k] else f"|{k}" for k in (0, 3))
        got = _mixed([int(c) - x for c, x in zip(own, low)], bases, key, kind)
        new = "".join(str(v + x) for v, x in zip(got, low))
    else:
        new = f"{permute(int(own), 10 ** len(own), key, 'phone' + code):0{len(own)}d}"
    return _refill(text, code + new)


def iban(text: str, key: bytes) -> str | None:
    s = text.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    free = s[4:]
    got = _mixed([int(c) if c.isdigit() else ord(c) - 65 for c in free], [10 if c.isdigit() else 26 for c in free], key, "iban")
    new = "".join(str(v) if c.isdigit() else chr(65 + v) for v, c in zip(got, free))
    new = f"{s[:2]}{98 - number(new + s[:2] + '00') % 97:02d}{new}"
    it = iter(new)
    return "".join(" " if c == " " else next(it) for c in text)


def email(text: str, key: bytes) -> str | None:
    name, _, domain = text.rpartition("@")
    low = name.lower()
    free = [c for c in low if c.isascii() and c.isalnum()]  # letters beyond ASCII stay
    got = iter(_mixed([int(c) if c.isdigit() else ord(c) - 97 for c in free], [10 if c.isdigit() else 26 for c in free], key, "email" + domain.lower()))
    out = []
    for c, small in zip(name, low if len(low) == len(name) else name):
        if not (small.isascii() and small.isalnum()):
            out.append(c)
        else:
            v = next(got)
            out.append(str(v) if c.isdigit() else chr((65 if c.isupper() else 97) + v))
    return "".join(out) + "@" + domain


_EMAIL = re.compile(r"(?<![\w.%+-])[^\W_][\w.%+-]{0,63}@(?:(?:[^\W_]|-){1,63}\.){1,8}[^\W\d_]{2,24}(?![\w-])")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)|(?<=:):){2,7}(?:[0-9A-Fa-f]{1,4})?(?![\w:]|\.[0-9])")
_NAMED = re.compile(r"(?<![\w./-])[0-9]{1,2}\.? (?:%s),? [0-9]{4}(?![\w/-])|(?<![\w])(?:%s) [0-9]{1,2},? [0-9]{4}(?![\w/-])" % (("|".join(MONTHS + [m[:3] for m in MONTHS]),) * 2))
_IBAN = re.compile(r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_RUN = re.compile(r"[0-9+(][0-9 ()./+-]{5,}")
_NUMBERS = (
    ("ip", re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"), ip),
    ("date", re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4})(?![0-9]|[./-][0-9])"), day),
    ("ssn", re.compile(r"(?<![0-9-])(?<![0-9] )[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![0-9]|[- ][0-9])"), ssn),
)
_PHONE = re.compile(r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{1,8}(?:[ .-][0-9]{1,8}){0,6}(?![0-9])"
                    r"|(?<![0-9+])\+[0-9]{1,15}(?:[ .-][0-9]{1,14}){0,7}(?![0-9])"
                    r"|(?<![0-9+])(?:1[ .-]?)?\([0-9]{1,4}\)[ .-]?[0-9]{2,8}(?:[ .-][0-9]{2,4}){0,3}(?![0-9])"
                    r"|(?<![0-9+-])(?:1[ .-])?[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9]|-[0-9])"
                    r"|(?<![0-9+-])(?<![0-9] )0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![0-9]|[ -][0-9])")
_NORTH_AMERICAN = re.compile(r"\+1|1[ .(-]|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_TIME = re.compile(r"T[0-9]{2}")


def _phone_ends(text: str) -> list[int]:
    """Ends at digit-group borders: ten digits of the North American plan first, else the longest."""
    ends = [m.end() for m in re.finditer(r"[0-9](?![0-9])", text)]
    if not _NORTH_AMERICAN.match(text):
        return ends[::-1]
    full = 10 + (text[0] in "+1")
    return sorted(ends, key=lambda e: (sum(c.isdigit() for c in text[:e]) != full, -e))


def _cards(text: str, start: int, end: int) -> tuple[list, list]:
    """(start, end) of all digit groups in a row that pass the check digit, the likeliest first: those with an
    issuer's prefix and length, written in one piece or in the usual groups, and the others."""
    likely, others = [], []
    for run in _GROUPS.finditer(text, start, end):
        at = [m.span() for m in re.finditer("[0-9]+", run[0])]
        for i, (s, _) in enumerate(at):
            d, sizes = "", []
            for a, e in at[i:]:
                d += run[0][a:e]
                sizes.append(e - a)
                if len(d) > 19:
                    break
                if len(d) < 13 or len(set(d)) == 1 or _luhn(d[:-1]) != d[-1]:
                    continue
                usual = len(sizes) == 1 or sizes in ([4, 6, 5], [4, 6, 4]) or (sizes[:3] == [4] * 3 and len(sizes) <= 5 and all(x == 4 for x in sizes[:-1]) and sizes[-1] <= 4)
                lone = run.start() + s == 0 or text[run.start() + s - 1] != "+"
                known = bool(_ISSUERS.fullmatch(d))
                rank = (not usual, not known, abs(len(d) - 16), run.start() + s)
                (likely if usual and known and lone else others).append((rank, run.start() + s, run.start() + e))
    return [x[1:] for x in sorted(likely)], [x[1:] for x in sorted(others)]


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def find(text: str, key: bytes, cached=None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of all valid values, not overlapping: the formats are tried in the order of
    ``KINDS``, but cards of a known issuer in a usual spacing before phones."""
    call = cached or (lambda f, x: f(x, key))
    taken: list[tuple[int, int, str, str]] = []  # sorted

    def take(start, end, kind, f) -> bool:
        if _word(text, start - 1) or (_word(text, end) and not (kind == "date" and _TIME.match(text, end))):
            return False
        k = bisect(taken, (start,))
        if (k and taken[k - 1][1] > start) or (k < len(taken) and taken[k][0] < end):
            return False
        new = call(f, text[start:end])
        if new is None:
            return False
        taken.insert(k, (start, end, kind, new))
        return True

    if "@" in text:
        for m in _EMAIL.finditer(text):
            take(*m.span(), "email", email)
    if "::" in text or text.count(":") > 6:
        for m in _IP6.finditer(text):
            take(*m.span(), "ip", ip)
    for m in _NAMED.finditer(text):
        take(*m.span(), "date", day)
    m = _IBAN.search(text)
    while m:
        on = m.start() + 1
        for end in range(m.end(), m.start() + 14, -1):  # the longest valid one; words after it may look alike
            if text[end - 1] != " " and take(m.start(), end, "iban", iban):
                on = end
                break
        m = _IBAN.search(text, on)
    for run in _RUN.finditer(text):
        for kind, pattern, f in _NUMBERS:
            for m in pattern.finditer(text, *run.span()):
                take(*m.span(), kind, f)
        likely, others = _cards(text, *run.span())
        for span in likely:
            take(*span, "card", card)
        m = _PHONE.search(text, *run.span())
        while m:
            on = m.end()
            for end in _phone_ends(m[0]):
                if take(m.start(), m.start() + end, "phone", phone):
                    on = m.start() + end
                    break
            m = _PHONE.search(text, on, run.end())
        for span in others:
            take(*span, "card", card)
    return taken


def replace(text: str | None, key: bytes, cached=None) -> tuple[str | None, list[str]]:
    """The text with pseudonyms in place, and ``kind:start:end`` of the values replaced (code points of the given text)."""
    if not text:
        return text, []
    out, at, spans = [], 0, []
    for start, end, kind, new in find(text, key, cached):
        out += [text[at:start], new]
        spans.append(f"{kind}:{start}:{end}")
        at = end
    return "".join(out) + text[at:] if out else text, spans


def column(text: Column, spark, key: bytes) -> Column:
    """Struct (text, spans) for each text."""
    C.ship(spark)

    def run(texts: pa.Array) -> pa.Array:
        cached = lru_cache(1 << 16)(lambda f, x: f(x, key))
        rows = [replace(t.as_py(), key, cached) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["text", "spans"])

    return F.arrow_udf(run, "text string, spans array<string>")(text)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with pseudonyms in ``text``, and the name of the added column of spans."""
    both, spans = C.fresh(docs, "pii", "pii_spans")
    # texts without a digit or an @ hold no value and skip Python
    may = F.col(text).rlike("[0-9@]")
    marked = docs.withColumn(both, column(F.when(may, F.col(text)), docs.sparkSession, key))
    out = [F.when(may, F.col(both)["text"]).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return marked.select(*out, F.coalesce(F.col(both)["spans"], F.array().cast("array<string>")).alias(spans)), spans


def key_of(spark) -> bytes:
    """The key that the session's setting holds, else the one that this application has drawn."""
    given = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING, None)
    return given.encode() if given else _DRAWN_KEY


def op3_pii(spark, sf_dir: str) -> DataFrame:
    out, spans = pseudonymise(C.read(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return out.select("doc_id", "text", F.size(spans).cast("long").alias("n_values"), F.array_join(spans, ",").alias("spans"))
