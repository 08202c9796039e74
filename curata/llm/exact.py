"""Exact dedup with an extendible-hash index on shared files (DataFrame functions only).

A row's key is a 64-bit hash of its lower-cased text. The index holds one entry (row number, id, key,
digest) per row. Its directory starts with one bucket and doubles: a bucket with more than
``capacity`` different keys is split on the next leading bit of the key, down to ``max_depth`` bits.
Each bucket is written by one owner task, or by several overflow pages when copies of few keys, which
no split can part, fill it. Keys with several entries form chains; the texts behind them are compared
byte by byte, so equal hashes alone never make two rows equal.

Defined results: null counts as empty text; of equal texts the row with the largest doc_id stays
(a null id is the smallest; of fully equal rows one stays); an empty table gives an empty result;
further columns pass through :func:`deduplicate` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_DEPTH, CAPACITY = 16, 8192


def normal(text: Column) -> Column:
    return C.ascii_lower(F.coalesce(text, F.lit("")))


def chain_key(text: Column) -> Column:
    """Equal for equal normal texts; cheaper than the normal text itself, and coarser (all letters lower)."""
    return F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Columns slot, bucket, depth, pages: at most 2 ** max_depth rows, one per slot of the doubled directory.

    A slot's bucket is its shortest prefix that holds at most ``capacity`` different keys.
    """
    slot = F.shiftrightunsigned("h", 64 - max_depth)
    keys = entries.groupBy("h").agg(F.count("*").alias("n"))
    slots = keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("keys"), F.sum("n").alias("n"))
    paths = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    paths = paths.withColumn("prefix", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    nodes = paths.groupBy("depth", "prefix").agg(F.sum("keys").alias("keys"), F.sum("n").alias("n"))
    fits = (F.col("keys") <= capacity) | (F.col("depth") == max_depth)
    leaf = paths.select("slot", "depth", "prefix").join(F.broadcast(nodes.filter(fits)), ["depth", "prefix"])  # under 2 ** (max_depth + 1) rows
    best = leaf.groupBy("slot").agg(F.min(F.struct("depth", "prefix", "n")).alias("b"))
    bucket = F.expr(f"shiftleft(b.prefix, {max_depth} - b.depth)")  # first slot of its key range
    return best.select("slot", bucket.alias("bucket"), F.col("b.depth").alias("depth"),
                       F.ceil(F.col("b.n") / (4 * capacity)).alias("pages"))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index as a table in the shared folder: entries (row, doc_id, h, sha) by bucket and page."""
    entries = C.materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), chain_key(F.col(text)).alias("h"),
        F.sha2(normal(F.col(text)).cast("binary"), 256).alias("sha")))
    slots = C.materialise(directory(entries, capacity, max_depth))
    paged = entries.withColumn("slot", F.shiftrightunsigned("h", 64 - max_depth)).join(F.broadcast(slots), "slot")
    paged = paged.withColumn("page", F.pmod(F.xxhash64("row"), F.col("pages"))).drop("slot", "pages")
    return C.materialise(paged.repartition("bucket", "page").sortWithinPartitions("bucket", "page", "h"))


def classes(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns h, sha, keep_id, n: one row for each text that several rows have.

    Only keys with a chain reach this step. Rows are grouped by key and whole normal text (byte
    comparison), with partial aggregation first, so a text held by a third of all rows is one row per
    map task in the exchange.
    """
    chains = C.bounded(C.materialise(index.groupBy("h").count().filter("count > 1").select("h")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), chain_key(F.col(text)).alias("h"))
    rows = rows.join(chains, "h", "left_semi").select("h", "doc_id", normal(F.col("text")).alias("norm"))
    same = rows.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    return same.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "n")


def _digest(index: DataFrame, found: DataFrame) -> DataFrame:
    """Index entries with their class; ``kept`` marks one row of each class."""
    rows = index.select("row", "doc_id", "h", "sha").join(found, ["h", "sha"], "left")
    top = rows.filter(F.col("n").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    top = top.groupBy("h", "sha").agg(F.max("row").alias("keep_row"))
    rows = rows.join(top, ["h", "sha"], "left")
    alone = F.col("n").isNull()
    return rows.select("doc_id", "h", "sha", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                       F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                       (alone | (F.col("row") == F.col("keep_row"))).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose equal text is kept elsewhere."""
    h, sha, key, n = C.fresh(docs, "dedup_h", "dedup_sha", "dedup_keep", "dedup_n")
    index = build_index(docs, doc_id, text)
    found = C.materialise(classes(docs, index, doc_id, text))
    small = C.bounded(found.select(F.col("h").alias(h), F.col("sha").alias(sha), F.col("keep_id").alias(key), F.col("n").alias(n)))
    rows = docs.withColumn(h, chain_key(F.col(text))).withColumn(sha, F.sha2(normal(F.col(text)).cast("binary"), 256))
    rows = rows.join(small, [h, sha], "left").filter(F.col(n).isNull() | F.col(doc_id).eqNullSafe(F.col(key)))
    repeated = index.groupBy("doc_id", "h", "sha").count().filter("count > 1")
    if not repeated.isEmpty():  # equal rows under one id: any one of them
        rows = rows.dropDuplicates([doc_id, h, sha])
    return rows.select(*docs.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    index = build_index(docs)
    found = C.materialise(classes(docs, index))
    return _digest(index, found).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
