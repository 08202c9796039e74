"""Secret scans with a trigram inverted index (DataFrame functions only).

Each rule's regex is turned into a Boolean query over the trigrams that any match must hold (case
ignored). The index holds, for every trigram that some query names, the keys of the documents with it,
as sorted lists by block of about ``BLOCK`` documents, so no list grows with the corpus. Queries are
answered block by block by intersecting and uniting lists; the candidates are verified with the regex
itself. A rule without a mandatory trigram scans every text.

Matches are leftmost and do not overlap within a rule; spans count code points, end exclusive.

Defined results: a null text is empty; equal rows get equal results; matches of a base rule that
fail its length test are dropped after matching; an empty table gives an empty result; columns other
than the id and the text are not carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 4096
#: Strings that a part of a pattern may stand for before it counts as open, and characters of a class likewise.
MOST_STRINGS, MOST_CHARS = 64, 6


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    ignore_case: bool = False
    #: (group, least length) that a match must have to count.
    least: tuple[int, int] = (0, 1)
    base: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: In the order in which kinds are listed. The two open-ended base patterns carry their least length in the
#: repeat: a shorter run can't hold a longer match, so nothing else changes.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, (2, 8), True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)


# ---------------------------------------------------------------- from a regex to a trigram query

def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[k:k + 3] for k in range(len(s) - 2))


def _either(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    return _least([*a, *b])


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    return _least([x | y for x, y in product(a, b)])


def _least(terms: list[frozenset]) -> list[frozenset]:
    """Without the terms that another one implies."""
    terms = list(dict.fromkeys(terms))
    return [t for t in terms if not any(o < t for o in terms)]


def _strings(parsed) -> list[str] | None:
    """All strings that a parsed pattern stands for, in lower case, or None when they are too many."""
    out = [""]
    for op, arg in parsed:
        more = _one(str(op), arg)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = list(dict.fromkeys(a + b for a, b in product(out, more)))
    return out


def _one(op: str, arg) -> list[str] | None:
    if op == "LITERAL":
        return [chr(arg).lower()]
    if op == "IN":
        chars = []
        for kind, x in arg:
            span = [x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1) if str(kind) == "RANGE" else None
            if span is None or len(span) > MOST_CHARS:
                return None
            chars += [chr(c).lower() for c in span]
        return list(dict.fromkeys(chars)) if len(chars) <= MOST_CHARS else None
    if op == "SUBPATTERN":
        return _strings(arg[-1])
    if op == "BRANCH":
        parts = [_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) else [s for p in parts for s in p]
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 8:
        own = _strings(arg[2])
        if own is None or len(own) ** int(arg[1]) > MOST_STRINGS:
            return None
        return list(dict.fromkeys("".join(p) for n in range(arg[0], int(arg[1]) + 1) for p in product(own, repeat=n)))
    return [""] if op == "AT" else None


def _query(parsed) -> list[frozenset]:
    """Alternatives, each a set of trigrams that a match must hold; an empty set demands nothing."""
    need, run = [frozenset()], [""]

    def close():
        nonlocal need, run
        need = _both(need, _least([_trigrams(s) for s in run]))
        run = [""]

    for op, arg in parsed:
        own = _one(str(op), arg)
        if own is not None and len(own) * len(run) <= MOST_STRINGS:
            run = list(dict.fromkeys(a + b for a, b in product(run, own)))
            continue
        close()
        if own is not None:
            run = own
        elif str(op) == "SUBPATTERN":
            need = _both(need, _query(arg[-1]))
        elif str(op) == "BRANCH":
            need = _both(need, reduce(_either, [_query(p) for p in arg[1]]))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            need = _both(need, _query(arg[2]))
    close()
    return need


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams (lower case); none when some match needs no trigram."""
    out = _query(re._parser.parse(pattern))
    return [] if any(not t for t in out) else out


# ---------------------------------------------------------------- index

def build_index(docs: DataFrame, grams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns block, gram, keys: the postings of ``grams``, as a table in the shared folder."""
    rows = docs.select(C.row_key(F.col(doc_id), F.col(text)).alias("key"), F.lower(F.col(text)).alias("low"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("low"), g))
    blocks = max(1, -(-docs.count() // BLOCK))
    postings = rows.select("key", F.explode(held).alias("gram")).withColumn("block", F.pmod("key", F.lit(blocks)))
    return C.materialise(postings.groupBy("block", "gram").agg(F.sort_array(F.collect_set("key")).alias("keys")))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Columns key, rules: documents that satisfy the query of some rule."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("post"))
    none = F.array().cast("array<bigint>")

    def answer(terms):
        return reduce(F.array_union, [reduce(F.array_intersect, [F.coalesce(F.col("post")[g], none) for g in sorted(t)]) for t in terms])

    each = [_tagged(answer(terms), name) for name, terms in queries.items()]
    found = blocks.select(F.explode(F.concat(*each)).alias("x")).select("x.key", "x.rule")
    return found.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _tagged(keys: Column, name: str) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(name).alias("rule")))


# ---------------------------------------------------------------- verification

def _sums_before(x: Column) -> Column:
    """Sums of all earlier elements, in two levels so that long arrays are not copied at every step."""
    size = 256

    def running(a: Column) -> Column:
        zero = F.array(F.lit(0).cast("bigint"))
        return F.aggregate(a, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.lit(size))).otherwise(F.array().cast("array<int>"))
    inner = F.transform(starts, lambda s: running(F.slice(x, s, size)))
    outer = running(F.transform(inner, lambda a: F.element_at(a, -1)))
    moved = F.transform(inner, lambda a, k: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda v: v + F.get(outer, k)))
    return F.flatten(moved)


def spans(text: Column, rule: Column) -> Column:
    """Structs (start, rank, end, kind) of a rule's matches: match lengths and the text between them add up to positions.

    ``rule`` is a struct (rank, kind, regex, group, least, open), so one expression serves all rules."""
    size = lambda parts: F.transform(parts, lambda p: F.length(p).cast("bigint"))
    gaps, whole = size(F.split(text, rule["regex"], -1)), size(F.regexp_extract_all(text, rule["regex"], F.lit(0)))
    part = F.when(rule["group"] == 0, whole).otherwise(size(F.regexp_extract_all(text, rule["regex"], rule["group"])))

    def placed(m: Column) -> Column:  # gaps, whole, part bound once
        gap = F.slice(m["gaps"], F.lit(1), F.size(m["whole"]))
        before = _sums_before(F.zip_with(gap, m["whole"], lambda a, b: a + b))
        made = F.transform(F.arrays_zip(gap.alias("gap"), m["whole"].alias("len"), m["part"].alias("part"), before.alias("before")), lambda z: F.struct(
            (z["before"] + z["gap"]).alias("start"), rule["rank"].alias("rank"), (z["before"] + z["gap"] + z["len"]).alias("end"), rule["kind"].alias("kind"), z["part"].alias("part")))
        return F.transform(F.filter(made, lambda s: s["part"] >= rule["least"]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.get(F.transform(F.array(F.struct(gaps.alias("gaps"), whole.alias("whole"), part.alias("part"))), placed), F.lit(0))


def scan(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, spans: every match of every rule in each text, by start and then by the order of ``rules``."""
    queries = {r.name: q for r in rules if (q := trigram_query(r.pattern))}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       C.row_key(F.col(doc_id), F.col(text)).alias("key"))
    grams = sorted({g for q in queries.values() for t in q for g in t})
    found = C.materialise(candidates(build_index(docs, grams, doc_id, text), queries)) if queries else None
    rows = rows.join(C.bounded(found), "key", "left") if queries else rows.withColumn("rules", F.lit(None).cast("array<string>"))
    table = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(r.name).alias("kind"), F.lit(r.regex).alias("regex"), F.lit(r.least[0]).alias("group"),
                               F.lit(r.least[1]).alias("least"), F.lit(r.name not in queries).alias("open")) for k, r in enumerate(rules)])
    due = F.filter(table, lambda r: F.when(r["open"], F.call_function("rlike", F.col("text"), r["regex"])).otherwise(F.coalesce(F.array_contains("rules", r["kind"]), F.lit(False))))
    return rows.select("doc_id", F.array_sort(F.flatten(F.transform(due, lambda r: spans(F.col("text"), r)))).alias("spans"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(C.read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.name for r in RULES if r.base]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                      listed(F.col("spans")).alias("spans"))
