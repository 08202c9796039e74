"""Mixing sources to target weights.

Sizes are summed per source, a water level turns the weights into targets that never pass ``cap``
times a source's size, and each document is emitted ``floor(rate)`` times plus once more when a
hash of its id falls below the rate's fraction.

Defined results: a null text has size 0; a null source is a source of its own, sorted last; a source
of size 0 gets target and rate 0, so its documents are not emitted; rows that share a doc_id share
their draw; an empty table gives an empty mix; further columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-42"
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from a hash of the id: 52 bits, equal on every run."""
    hexed = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP,
                   text: str = "text", source: str = "source") -> DataFrame:
    """Columns source, source_size, target, rate: one row per source.

    Documents meet only in partial sums; the windows without a key run over one row per source.
    Sources fill up in order of cap / weight: one stays at its cap when that is not above the level
    which the rest of the tokens would give it and all later sources.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(word_count(F.col(text))).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.row_number().over(by_name) - 1) % len(weights) + 1)
    w = sizes.select("source", "source_size", weight.alias("w"), F.row_number().over(by_name).alias("pos"),
                     F.sum("source_size").over(Window.partitionBy()).alias("total"))
    order = Window.orderBy((F.col("source_size") * cap / F.col("w")), "pos")
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = w.withColumn("level", (F.col("total") * share - before * cap) / rest)
    full = level.withColumn("full", F.col("source_size") * cap / F.col("w") <= F.col("level"))
    final = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") * cap / F.col("w")).alias("r"), "pos", "level")))
    out = full.withColumn("final", final.over(Window.partitionBy()).getField("level"))
    target = F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("w") * F.col("final"))
    out = out.select("source", "source_size", target.alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED, doc_id: str = "doc_id",
                source: str = "source", rows: int = C.BROADCAST_ROWS) -> tuple[DataFrame, str, str, str]:
    """``docs`` with its source's size and target and the number of copies to emit, and those columns' names.

    The targets are broadcast when their counted number is within ``rows``; otherwise the join is
    salted, so a source with a third of all documents is spread over ``SALTS`` tasks.
    """
    size, target, copies, salt, src, rate = C.fresh(docs, "source_size", "target", "copies", "salt", "src", "rate")
    t = targets.select(F.col("source").alias(src), F.col("source_size").alias(size), F.col("target").alias(target),
                       F.col("rate").alias(rate))
    same = docs[source].eqNullSafe(t[src])
    if targets.count() <= rows:
        joined = docs.join(F.broadcast(t), same, "left")
    else:
        t = t.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        other = C.fresh(t, "salt_d")[0]
        left = docs.withColumn(other, F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int"))
        joined = left.join(t, left[source].eqNullSafe(t[src]) & (left[other] == t[salt]), "left").drop(other, salt)
    whole = F.floor(F.col(rate))
    more = (draw(F.col(doc_id), seed) < F.col(rate) - whole).cast("long")
    return joined.withColumn(copies, whole + more).drop(src, rate), size, target, copies


def mix(docs: DataFrame, targets: DataFrame | None = None, **kw) -> DataFrame:
    """Every document as often as the mix takes it; ``copy`` numbers the repeats from 1."""
    targets = C.materialise(source_targets(docs)) if targets is None else targets
    out, size, target, copies = with_copies(docs, targets, **kw)
    copy = C.fresh(docs, "copy")[0]
    out = out.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return out.drop(size, target, copies)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    targets = C.materialise(source_targets(docs))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out, size, target, copies = with_copies(sized, targets)
    return out.select("doc_id", "size", F.col(size).alias("source_size"), F.col(target).alias("target"),
                      (F.col("size") * F.col(copies)).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos, sum(source_size) OVER () AS total FROM s),
v AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM w),
l AS (SELECT *, (source_size * 2)::DOUBLE / w AS r FROM v),
m AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - (2 * coalesce(sum(source_size) OVER (ORDER BY r, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
  / sum(w) OVER (ORDER BY r, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
f AS (SELECT *, (SELECT arg_min(level, r * 1e6 + pos) FROM m WHERE r > level) AS final FROM m),
t AS (SELECT source, source_size, CASE WHEN r <= level THEN (source_size * 2)::DOUBLE ELSE w * final END AS target FROM f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(sha256('mix-42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken FROM x
"""
