"""SimHash near-dedup by the generalised pigeonhole principle.

A document's fingerprint has a bit set when over half of its shingle hashes have it. Two fingerprints
link at ``distance`` or fewer differing bits. The 64 bits are cut into ``m`` partitions, correlated
bits together, and partition i gets a threshold t_i >= -1 with sum(t_i) = distance - m + 1: if every
partition differed in more than t_i bits, the fingerprints would differ in more than ``distance``.
A dynamic program picks the thresholds (and m) with the fewest estimated candidates and probes. Each
different fingerprint is filed under its exact value of every partition in use and under all values
within t_i bits; fingerprints that meet are verified on all 64 bits.

Statistics steer only the cost. Links never do: any plan finds the same ones.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than
a shingle hash as one; the smallest doc_id of a component names it (null ids only where there is no
other); equal rows get equal results; an empty table gives an empty result; further columns pass
through :func:`deduplicate` unchanged.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Different fingerprints that the plan's estimates look at; they choose cost, never results.
PLAN_SAMPLE = 10_000
#: A bucket with more entries is filed again under four keys of other bits.
BUCKET = 4096
#: Entries compared at once inside a bucket.
BLOCK = 1024


# ---------------------------------------------------------------- fingerprints

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_CHUNK = 1 << 18


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint; memory is bounded by the words of one text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    grams = zip(*(itertools.islice(words, k, None) for k in range(n))) if len(words) >= n else iter([words])
    counts, total = np.zeros((8, 8), np.int64), 0
    while True:
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), seed) for g in itertools.islice(grams, _CHUNK)), np.uint64)
        if not len(h):
            break
        total += len(h)
        cols = h.view(np.uint8).reshape(-1, 8)  # little endian: byte k holds bits 8k to 8k + 7
        for k in range(8):
            counts[k] += np.bincount(cols[:, k], minlength=256) @ _BYTE_BITS
    bits = (counts.reshape(-1) * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint_column(text, spark, n: int = SHINGLE, seed: int = SEED):
    C.ship(spark)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(t.as_py(), n, seed) for t in texts), pa.int64())

    return F.arrow_udf(run, "long")(text)


# ---------------------------------------------------------------- plan

def bit_groups(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m groups of near equal size; each group grows by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    dev = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        first = max(left, key=lambda b: corr[b, left].sum())
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(left, key=lambda b: corr[b, group].sum())
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group`` packed into the low bits, for each fingerprint."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(bits: int, t: int) -> np.ndarray:
    """All values of ``bits`` bits with 1 to t bits set."""
    return np.array([sum(1 << b for b in c) for k in range(1, t + 1) for c in itertools.combinations(range(bits), k)], np.uint64)


def candidates(sample: np.ndarray, group: list[int], t: int, n: int) -> float:
    """Estimated pairs of n fingerprints within t bits on ``group``: sample pairs scaled up, even spread at least."""
    bits = len(group)
    even = n * n / 2 * sum(comb(bits, k) for k in range(t + 1)) / 2.0**bits
    if len(sample) < 2:
        return even
    v, c = np.unique(values(sample, group), return_counts=True)
    pairs = (c * (c - 1) / 2).sum()
    for mask in masks(bits, t) if t > 0 else ():
        other = v ^ mask
        at = np.minimum(np.searchsorted(v, other), len(v) - 1)
        pairs += (c * np.where(v[at] == other, c[at], 0)).sum() / 2
    return max(even, pairs * (n / len(sample)) ** 2)


def plan(sample: np.ndarray, together: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, cheapest by estimate over m = 2 to distance + 1."""
    best, chosen = None, []
    for m in range(2, distance + 2):
        groups, total = bit_groups(together, n, m), distance - m + 1
        cost = []  # cost[i][t + 1]: candidates plus probes of partition i at threshold t
        for g in groups:
            row = [0.0]
            for t in range(0, total + m):  # the others may be -1 each
                probes = n * sum(comb(len(g), k) for k in range(t + 1))
                row.append(candidates(sample, g, t, n) + 2.0 * probes if comb(len(g), t) <= 500 else float("inf"))
            cost.append(row)
        table = {0: (0.0, ())}  # sum of (t_i + 1) so far -> cheapest
        for row in cost:
            nxt: dict[int, tuple[float, tuple]] = {}
            for used, (c, ts) in table.items():
                for t1 in range(0, min(len(row) - 1, total + m - used) + 1):
                    got = (c + row[t1], (*ts, t1 - 1))
                    if used + t1 not in nxt or got[0] < nxt[used + t1][0]:
                        nxt[used + t1] = got
            table = nxt
        c, ts = table[total + m]
        if best is None or c < best:
            best, chosen = c, [(g, t) for g, t in zip(groups, ts) if t >= 0]
    return chosen


def _together(batches):
    """How often two bits are set together, summed per task."""
    total = np.zeros((64, 64))
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(fp), 1 << 16):
            x = np.unpackbits(fp[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])


# ---------------------------------------------------------------- probe and verify

def _probe(chosen):
    """Fingerprints to (part, value, fp, probe): one entry under the exact value, probes around it."""
    spec = [(i, g, masks(len(g), t)) for i, (g, t) in enumerate(chosen)]

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), 4096):
                fp = fps[at:at + 4096]
                for i, g, around in spec:
                    v = values(fp, g)
                    for lo in range(-1, len(around), 16):
                        ms = np.zeros(1, np.uint64) if lo < 0 else around[lo:lo + 16]
                        key = (v[:, None] ^ ms[None, :]).reshape(-1)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)),
                            pa.array(np.repeat(fp, len(ms)).view(np.int64)), pa.array(np.full(len(key), lo >= 0))], ["part", "value", "fp", "probe"])

    return run


def _links_in(fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the entries of one bucket that joins what is linked there: at most one link less than entries."""
    n = len(fp)
    root = np.arange(n)
    outs = []
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            x, y = fp[a:a + BLOCK], fp[b:b + BLOCK]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= distance
            near &= ~(probe[a:a + BLOCK][:, None] & probe[b:b + BLOCK][None, :])
            if a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            while len(i):  # hook the larger root under the smaller until no link joins two trees
                ri, rj = root[i], root[j]
                keep = ri != rj
                i, j, ri, rj = i[keep], j[keep], ri[keep], rj[keep]
                if not len(i):
                    break
                hi, lo = np.maximum(ri, rj), np.minimum(ri, rj)
                order = np.lexsort((lo, hi))
                hi, lo, oi, oj = hi[order], lo[order], i[order], j[order]
                first = np.r_[True, hi[1:] != hi[:-1]]
                outs.append((oi[first], oj[first]))
                root[hi[first]] = lo[first]
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs])


def _verify(distance: int):
    """Rows sorted by bucket to links (a, b) between fingerprints."""

    def bucket(fp, probe):
        if len(fp) <= 64:
            d = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
            d &= ~(probe[:, None] & probe[None, :])
            i, j = np.nonzero(np.triu(d, 1))
            if len(i) < len(fp):
                return fp[i], fp[j]
        i, j = _links_in(fp, probe, distance)
        return fp[i], fp[j]

    def whole(part, sub, value, fp, probe):
        cut = np.flatnonzero((part[1:] != part[:-1]) | (sub[1:] != sub[:-1]) | (value[1:] != value[:-1])) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(part)]
        size = ends - starts
        out = []
        two = starts[size == 2]  # most buckets: one comparison for all at once
        near = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance) & ~(probe[two] & probe[two + 1])
        out.append((fp[two[near]], fp[two[near] + 1]))
        for s, e in zip(starts[size > 2], ends[size > 2]):
            if not probe[s:e].all():
                out.append(bucket(fp[s:e], probe[s:e]))
        a, b = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            now[3] = now[3].astype(np.int64).view(np.uint64)
            if rest is not None:
                now = [np.concatenate(p) for p in zip(rest, now)]
            part, sub, value = now[:3]
            if not len(part):
                continue
            last = np.flatnonzero((part != part[-1]) | (sub != sub[-1]) | (value != value[-1]))
            end = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if end:
                yield whole(*[x[:end] for x in now])
            rest = [x[end:] for x in now]
        if rest is not None and len(rest[0]):
            yield whole(*rest)

    return run


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Columns a, b: links that join all fingerprints (column fp, each once) within ``distance`` bits.

    Per bucket a forest, not all pairs. A bucket with more than ``BUCKET`` entries is filed again by
    ``distance + 1`` parts of the whole fingerprint: two linked fingerprints share one of them.
    """
    C.ship(fps.sparkSession)
    sums = fps.mapInArrow(_together, "m binary")
    n = fps.count()
    together = sum((np.frombuffer(bytes(r["m"])).reshape(64, 64) for r in sums.toLocalIterator()), np.zeros((64, 64)))
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()
    chosen = plan(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), together, n, distance)
    entries = fps.mapInArrow(_probe(chosen), "part int, value long, fp long, probe boolean")
    sizes = entries.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    large = C.materialise(sizes.select("part", "value", F.lit(True).alias("large")))
    entries = entries.withColumn("sub", F.lit(0))
    if not large.isEmpty():
        entries = entries.join(C.bounded(large), ["part", "value"], "left")
        cuts = [64 * k // (distance + 1) for k in range(distance + 2)]
        keys = [F.struct(F.lit(k + 1).alias("sub"), F.shiftright("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1 if hi - lo < 64 else -1).cast("long")).alias("v"))
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
        sub = F.when(F.col("large"), F.array(*keys)).otherwise(F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("v"))))
        entries = entries.drop("sub").withColumn("s", F.explode(sub))
        entries = entries.select("part", F.col("s.sub").alias("sub"), F.when(F.col("large"), F.xxhash64("value", "s.v")).otherwise(F.col("value")).alias("value"), "fp", "probe")
    entries = entries.select("part", "sub", "value", "fp", "probe")
    sorted_ = entries.repartition("part", "sub", "value").sortWithinPartitions("part", "sub", "value")
    return sorted_.mapInArrow(_verify(distance), "a long, b long").distinct()


def groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Columns fp, root, component_id from (doc_id, fp): one row per different fingerprint.

    ``root`` is the component's least fingerprint, ``component_id`` its least doc_id.
    """
    each = C.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(each.select("fp"), distance))
    each = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = each.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return each.join(least, "root").select("fp", "root", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id."""
    key, gone_id, gone_key = C.fresh(docs, "near_key", "gone_id", "gone_key")
    prints = C.materialise(docs.select(F.col(doc_id).alias("doc_id"), C.row_key(F.col(doc_id), F.col(text)).alias("key"),
                                       fingerprint_column(F.col(text), docs.sparkSession, n).alias("fp")))
    rows = prints.join(groups(prints.select("doc_id", "fp"), distance).select("fp", "root"), "fp")
    # the least (doc_id, key) stays; a null id only where there is no other
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("s"))
    gone = rows.join(least, "root").filter(~(F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("key") == F.col("s.key"))))
    gone = C.materialise(gone.select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct())
    marked = docs.withColumn(key, C.row_key(F.col(doc_id), F.col(text)))
    kept = marked.join(C.bounded(gone), (F.col(key) == F.col(gone_key)) & F.col(doc_id).eqNullSafe(F.col(gone_id)), "left_anti")
    if not prints.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():  # equal rows: any one of them
        kept = kept.dropDuplicates([doc_id, key])
    return kept.drop(key)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    prints = C.materialise(docs.select("doc_id", fingerprint_column(F.col("text"), spark).alias("fp")))
    found = groups(prints)
    return prints.join(found.select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
