"""Benchmark decontamination against a broadcast hash set of test n-grams (DataFrame functions only).

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Every run of ``n``
consecutive item words is a gram; a shorter item is one gram. All word windows of a document, of the
gram lengths in use, are hashed and looked up in a table of the grams' hash slots that every task
holds; the windows that hit are verified by joining their whole text with the broadcast set.

Defined results: null or wordless texts have no words and no hits; grams shared by several items
count for each of them; items without words never match; an empty benchmark leaves all documents
clean; rows that are equal get equal results; further columns pass through :func:`clean` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

N = 10
GRAM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The gram set is broadcast up to this many grams and bytes of text and item ids; a larger one is joined by a shuffle,
#: which then gets all windows.
MAX_GRAMS, MAX_BYTES = 1_000_000, 200_000_000
#: Hash slots (one bit each) for each gram, and at most.
SLOTS, MAX_SLOTS = 64, 1 << 24


def words(text: Column) -> Column:
    return F.regexp_extract_all(C.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(GRAM), F.lit(0))


def gram_set(items: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Columns gram, len, items: each gram once with the ids (as text) of the items that have it."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    w = w.filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    grams = w.select("item", size.alias("len"), F.explode(_windows(F.col("w"), size)).alias("x"))
    return grams.groupBy(F.col("x.gram").alias("gram"), "len").agg(F.collect_set("item").alias("items"))


def _windows(w: Column, n) -> Column:
    """All windows of ``n`` words as structs (pos, gram), pos from 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i, n), " ").alias("gram")))


def _slots(grams: DataFrame, n: int) -> tuple[str, int]:
    """A bit for each slot, set where some gram's hash falls, as comma-separated 64-bit words, and the number of slots.

    The set's size is bounded by ``MAX_GRAMS`` and the table's by ``MAX_SLOTS``."""
    size = 1 << 12
    while size < min(MAX_SLOTS, SLOTS * n):
        size *= 2
    slot = F.pmod(F.xxhash64(_hashes(F.split("gram", " "))), F.lit(size)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)))
    rows = grams.select(F.shiftright(slot, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    table = ["0"] * (size >> 6)
    for r in rows.toLocalIterator():  # at most size / 64
        table[r["at"]] = str(r["bits"])
    return ",".join(table), size


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _windows_that_hit(w: Column, hashes: Column, n: int, table: str, size: int) -> Column:
    """The windows of ``n`` words whose hash slot is taken, as structs (pos, len, gram); ``hashes`` has one of each word."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    bits = F.split(F.lit(table), ",").cast("array<bigint>")  # folded to a constant when the plan is made
    slots = F.transform(at, lambda i: F.pmod(F.xxhash64(F.slice(hashes, i, n)), F.lit(size)).cast("int"))
    taken = F.transform(slots, lambda s, i: F.when(F.getbit(F.element_at(bits, F.shiftright(s, 6) + 1), s.bitwiseAND(F.lit(63))) == 1, i + 1))
    return F.transform(F.filter(taken, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i, n), " ").alias("gram")))


def scan(docs: DataFrame, grams: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, key, n_words, n_hit, items: one row per document, ``items`` empty where no gram occurs.

    ``grams`` must be materialised: its size decides between a broadcast set and a shuffle join, and
    its different lengths (at most n) are read to know which windows to cut. Row numbers tell equal rows apart.
    """
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 8)
    got = grams.agg(F.count("*").alias("n"), F.sum(F.octet_length("gram") + ids).alias("b"), F.collect_set("len").alias("lens")).first()
    small = got["n"] <= MAX_GRAMS and (got["b"] or 0) <= MAX_BYTES
    table, size = _slots(grams, got["n"]) if small else ("", 0)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), C.row_key(F.col(doc_id), F.col(text)).alias("key"), F.explode(F.array(words(F.col(text)))).alias("w"))
    rows = rows.select("*", F.explode(F.array(_hashes(F.col("w")))).alias("hashes"))  # explode of one: made once, not in every window
    none = F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    cut = [_cut(F.col("w"), F.col("hashes"), n, table, size) for n in sorted(got["lens"])]
    found = rows.select("row", "doc_id", "key", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(none, *cut)).alias("x"))
    # documents without a window have a key of their own, so that they don't meet in one task of a shuffle join
    found = found.select("row", "doc_id", "key", "n_words", "x.pos", "x.len", F.coalesce("x.gram", F.concat(F.lit(" "), F.col("row").cast("string"))).alias("gram"))
    one = grams.select(F.col("gram"), F.col("items").alias("own"))
    found = found.join(F.broadcast(one) if small else one, "gram", "left")
    per_doc = found.groupBy("row", "doc_id", "key", "n_words").agg(
        F.collect_set(F.when(F.col("own").isNotNull(), F.struct("pos", "len"))).alias("at"), F.array_distinct(F.flatten(F.collect_set("own"))).alias("items"))
    return per_doc.select("doc_id", "key", "n_words", _covered(F.array_sort("at")).alias("n_hit"), "items")


def _cut(w: Column, hashes: Column, n: int, table: str, size: int) -> Column:
    if table:
        return _windows_that_hit(w, hashes, n, table, size)
    return F.transform(_windows(w, n), lambda x: F.struct(x["pos"].alias("pos"), F.lit(n).alias("len"), x["gram"].alias("gram")))


def _covered(spans: Column) -> Column:
    """Number of words inside sorted spans (pos, len)."""
    end = lambda x: x["pos"] + x["len"]
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), end(x) - F.greatest(a["to"], x["pos"]))).cast("long").alias("n"),
        F.greatest(a["to"], end(x)).cast("int").alias("to"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def clean(docs: DataFrame, items: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a gram of ``items``."""
    key, theirs, their_id = C.fresh(docs, "decon_key", "decon_other", "decon_id")
    found = scan(docs, C.materialise(gram_set(items, n)), doc_id, text).filter("n_hit > 0")
    found = C.materialise(found.select(F.col("key").alias(theirs), F.col("doc_id").alias(their_id)).distinct())
    found = C.bounded(found)
    rows = docs.withColumn(key, C.row_key(F.col(doc_id), F.col(text)))
    return rows.join(found, (rows[key] == found[theirs]) & rows[doc_id].eqNullSafe(found[their_id]), "left_anti").drop(key)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, C.materialise(gram_set(C.read(spark, sf_dir, "benchmark"))))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM bi),
l AS (SELECT DISTINCT n FROM g),
di AS (SELECT r, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, l WHERE len(w) >= l.n),
dg AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM di),
h AS (SELECT dg.r, dg.n, dg.i, g.item FROM dg JOIN g ON dg.gram = g.gram AND dg.n = g.n),
p AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(q.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(q.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN q ON d.r = q.r
"""
