"""Suffix-array dedup of byte strings.

A full suffix array would ship every byte's suffix; this one is sparse. Of the first ``SPAN`` positions
of a window, the one whose next 8 bytes hash least is its sample, so equal windows have equal samples
at equal offsets and every window belongs to exactly one sampled suffix. Suffixes whose first
``LEAD`` bytes occur once are dropped by hash. The others are range-partitioned by leading bytes
with sampled splitters, and each bucket sorts its suffixes (and, reversed, the text before them) by
multikey quicksort, eight bytes a step. Two windows are equal exactly when the suffixes share the
bytes on the right and the reversed texts share those on the left, which the common prefixes of
neighbours tell. A leading string that fills several splitters is dealt over several buckets, and
windows that are single in such a bucket are compared across the boundaries by 128-bit hashes. Of suffixes
whose windows are all equal inside one piece of texts (128-bit hashes) two are sent: the others are repeated, too.

Defined results: null counts as empty; matches never cross documents; texts shorter than a window keep
everything; equal rows repeat each other; an empty table gives an empty result; the kept bytes may
not be valid text, so they are binary; columns other than the id and the text are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import common as C
from . import textnum as T

WINDOW, SPAN = 200, 101
LEAD = WINDOW - SPAN + 1
#: Leading bytes compared with the splitters; about so many bytes of text are read for them, and so many heads kept (they only
#: even out the tasks).
HEAD, SAMPLE, HEADS = 24, 1 << 26, 40_000
#: Range buckets for each shuffle partition; suffixes of one leading string that are sorted together at most.
BUCKETS, GROUP = 8, 10_000
#: Bytes of suffixes that leave a task at a time.
SENT = 1 << 21
FAILS, SINGLE, SPEAKER = 0, 1, 2
_BYTE = T.mix(np.arange(1, 257, dtype=np.uint64))


def samples(data: np.ndarray, off: np.ndarray):
    """Sampled positions, first and last start of the windows that they stand for, and their documents."""
    none = np.zeros(0, np.int64)
    step = np.zeros(len(data) + 1, np.int64)
    long = np.flatnonzero(np.diff(off) >= WINDOW)
    if not len(long):
        return none, none, none, none
    step[off[long]] += 1
    np.add.at(step, off[long + 1] - WINDOW + 1, -1)
    starts = np.flatnonzero(np.cumsum(step[:-1]))
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).astype(np.uint64)
    low = np.uint64((1 << len(data).bit_length()) - 1)
    least = (T.mix(eight) & ~low) | np.arange(len(eight), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
    at = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    p = at[first]
    return p, starts[first], starts[last], np.searchsorted(off, p, "right") - 1


def _lead(data, p):
    return T.windows(T.prefix(_BYTE[data]), p, LEAD) if len(p) else np.zeros(0, np.uint64)


def _find(data, off):
    p, _, _, doc = samples(data, off)
    return _lead(data, p), doc


def _heads(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data[p[:, None] + np.arange(HEAD)]).view(f"S{HEAD}").reshape(-1)


def _twice(data: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which samples to send: of those whose windows all are equal (128-bit hashes), two tell the rest of the corpus as much as all."""
    if not len(p):
        return np.zeros(0, bool)
    a, b = (T.prefix(_BYTE[data], lane) for lane in (0, 1))
    size = hi + WINDOW - lo
    # lengths and places are part of the hash: contexts of other shapes are others
    shape = T.mix(((p - lo) * 1024 + size).astype(np.uint64))
    a, b = T.windows(a, lo, size) ^ shape, T.windows(b, lo, size, 1) ^ shape
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])]
    first = np.flatnonzero(new)
    turn = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)]))
    out = np.zeros(len(p), bool)
    out[order[turn < 2]] = True
    return out


def _sample_heads(share: float):
    """(.., text, rid) to a ``share`` of the heads of what the texts would send, chosen by hash."""

    def run(batches):
        for b in batches:
            data, off = T.texts(b.column(1))
            rid = A.numbers(b.column(2))
            for i, j in T.pieces(off):
                piece = data[off[i]:off[j]]
                p, lo, hi, doc = samples(piece, off[i:j + 1] - off[i])
                chosen = T.mix(T.mix(p.view(np.uint64)) ^ rid[i + doc].view(np.uint64)) <= np.uint64(min(int(share * 2**64), 2**64 - 1))
                p = p[_twice(piece, p, lo, hi) & chosen]
                for a in range(0, len(p), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(_heads(piece, p[a:a + 1024]).tolist(), pa.binary())], ["head"])

    return run


def splitters(rows: DataFrame, buckets: int) -> tuple[np.ndarray, float]:
    """``buckets - 1`` leading strings at even distances in sorted heads, and the estimated number of suffixes.

    The heads are about ``HEADS`` at most, from documents chosen by hash with about ``SAMPLE`` bytes in all."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    every = max(1, size // SAMPLE)
    share = min(1.0, HEADS * (SPAN + 1) / 2 * every / max(1, size))
    heads = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).mapInArrow(_sample_heads(share), "head binary").toArrow()["head"].to_pylist()
    heads = np.sort(np.array(heads, f"S{HEAD}")) if heads else np.zeros(0, f"S{HEAD}")
    return (heads[(np.arange(1, buckets) * len(heads)) // buckets] if len(heads) else heads), len(heads) / share * every


class Ranges:
    """Bucket numbers by leading string. One that fills several splitters, ``GROUP`` suffixes or more each, has buckets of its own."""

    def __init__(self, cuts: np.ndarray, suffixes: float):
        self.cuts, often = np.unique(cuts, return_counts=True)
        share = suffixes / (len(cuts) + 1)
        ways = np.where(often > 1, often * share // GROUP, 0).astype(np.int64)
        self.ways = np.r_[0, np.where(ways > 1, ways, 0)]
        self.base = np.r_[0, np.cumsum(self.ways + 1)]
        self.count = int(self.base[-1])

    def of(self, head: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each head, and whether its string is dealt over several; ``turn`` (uint64) deals them."""
        if not len(self.cuts):
            return np.zeros(len(head), np.int64), np.zeros(len(head), bool)
        at = np.searchsorted(self.cuts, head, "right")
        split = (at > 0) & (self.cuts[at - 1] == head) & (self.ways[at] > 0)
        dealt = (turn % np.maximum(self.ways[at], 1).astype(np.uint64)).astype(np.int64)
        return self.base[at] + np.where(split, 1 + dealt, 0), split


def _suffixes(ranges: Ranges):
    """(doc_id, text, rid, keys) to the repeated sampled suffixes with the text of their windows."""

    def send(piece, own, start, p, lo, hi, h):
        bucket, split = ranges.of(_heads(piece, p), T.mix(own.view(np.uint64) ^ h))
        size = hi + WINDOW - lo
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
        text = pa.BinaryArray.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(piece[at])])
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(split), pa.array(own), pa.array(lo - start), pa.array((p - lo).astype(np.int32)),
                                           pa.array((hi - lo + 1).astype(np.int32)), text], ["bucket", "split", "rid", "pos", "left", "wins", "text"])

    def run(batches):
        for b in batches:
            data, off = T.texts(b.column(1))
            rid = A.numbers(b.column(2))
            for i, j in T.pieces(off):
                piece = data[off[i]:off[j]]
                p, lo, hi, doc = samples(piece, off[i:j + 1] - off[i])
                h = _lead(piece, p)
                ok = A.member(h, doc, b.column(3), i)
                ok[ok] = _twice(piece, p[ok], lo[ok], hi[ok])
                size = np.where(ok, hi + WINDOW - lo, 0)
                for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(size) // SENT)) + 1):
                    part = part[ok[part]]
                    if len(part):
                        yield send(piece, rid[i + doc[part]], off[i + doc[part]] - off[i], p[part], lo[part], hi[part], h[part])

    return run


def multikey(cols: np.ndarray) -> np.ndarray:
    """Order of the rows by their columns: each step sorts only the rows still tied, within their ties."""
    n = len(cols)
    order, group, active = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for c in range(cols.shape[1]):
        if not len(active):
            break
        rows = order[active]
        key = cols[rows, c]
        s = np.lexsort((key, group[active]))
        key, g = key[s], group[active]
        order[active] = rows[s]
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(active)])
        group[active] = np.repeat(active[first], size)
        active = active[np.repeat(size, size) > 1]
    return order


def _ranked(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place in the sorted order of ``m`` (bytes, a multiple of 8 wide), and the common prefix with the row before, by place."""
    order = multikey(m.view(">u8").astype(np.uint64))
    place = np.empty(len(m), np.int64)
    place[order] = np.arange(len(m))
    common = np.zeros(len(m), np.int64)
    for a in range(1, len(m), 4096):
        b = min(a + 4096, len(m))
        differ = m[order[a:b]] != m[order[a - 1:b - 1]]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return place, common


def _matrix(data, start, size, width, step):
    """Bytes from start onwards (step 1) or before start backwards (step -1), zero beyond ``size``."""
    out = np.zeros((len(start), width), np.uint8)
    span = np.arange(width)
    for a in range(0, len(start), 4096):
        s, n = start[a:a + 4096], size[a:a + 4096]
        at = s[:, None] + (span if step > 0 else -1 - span)
        inside = span < n[:, None]
        out[a:a + 4096] = np.where(inside, data[np.where(inside, at, 0)], 0)
    return out


def _bucket(split, rid, pos, left, wins, text):
    """Windows of one bucket that are not repeated in it, a few rows of the bucket at a time: arrays ha, hb, rid, pos, n, kind.

    What is found is kept as one flag for each window of a row, so memory is a fixed number of bytes per suffix."""
    text = text.cast(pa.large_binary()) if not pa.types.is_large_binary(text.type) else text
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    n, before = len(rid), (SPAN + 7) // 8 * 8
    start, right = off[:-1] + left, np.diff(off) - left
    r_place, r_common = _ranked(_matrix(data, start, right, WINDOW, 1))
    l_place, l_common = _ranked(_matrix(data, start, left, before, -1))
    same = np.stack([np.cumsum(r_common < WINDOW)[r_place], np.cumsum(l_common < before)[l_place], left, wins])
    order = np.lexsort(same)
    new = np.r_[True, (same[:, order[1:]] != same[:, order[:-1]]).any(axis=0)]
    one = order[new]  # a row of each set of equal contexts; all windows of the larger sets are repeated
    weight = np.diff(np.r_[np.flatnonzero(new), n])
    most, least = left[one], left[one] - wins[one] + 1
    single = np.zeros((len(one), SPAN + 1), bool)  # by row and number of the window
    speaks = np.zeros((len(one), SPAN + 1), bool) if split else None
    for l in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= l) & (l <= most))
        if not split and not (weight[own] == 1).any():
            continue
        rc = np.cumsum(r_common < WINDOW - l)[r_place[one[own]]]
        lc = np.cumsum(l_common < l)[l_place[one[own]]]
        _, first, back = np.unique(rc * (n + 1) + lc, return_index=True, return_inverse=True)
        count = np.bincount(back, weights=weight[own])
        alone = own[count[back] == 1]
        single[alone, most[alone] - l] = True
        if split:
            told = own[first[count > 1]]
            speaks[told, most[told] - l] = True
    for a in range(0, len(one), 2048):
        rows = one[a:a + 2048]
        if split:
            for flags, kind in ((single, SINGLE), (speaks, SPEAKER)):
                i, k = np.nonzero(flags[a:a + 2048])
                if len(i):
                    ha, hb = _window_hashes(data, off, rows, i, k)
                    yield ha, hb, rid[rows[i]], pos[rows[i]] + k, np.ones(len(i), np.int64), np.full(len(i), kind, np.int8)
        else:
            edge = np.diff(np.pad(single[a:a + 2048], ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (i, k), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            if len(i):
                own, at = rid[rows[i]], pos[rows[i]] + k
                yield T.mix(own.view(np.uint64)), T.mix(at.view(np.uint64)) ^ own.view(np.uint64), own, at, end - k, np.full(len(i), FAILS, np.int8)


def _window_hashes(data, off, rows, i, k):
    """128-bit hashes of window k of row rows[i], for pairs (i, k)."""
    size = off[rows + 1] - off[rows]
    ends = np.cumsum(size)
    near = data[np.arange(ends[-1]) + np.repeat(off[rows] - (ends - size), size)]
    s = (ends - size)[i] + k
    return tuple(T.windows(T.prefix(_BYTE[near], lane), s, WINDOW, lane) for lane in (0, 1))


def _sorted_buckets(batches):
    """Rows sorted by bucket to the windows that are single in theirs."""

    def done(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        flag = t["split"].to_numpy()
        for f in (False, True):
            own = t.filter(pa.array(flag == f)) if flag.any() and not flag.all() else t if bool(flag[0]) == f else t.slice(0, 0)
            if not len(own):
                continue
            own = own.combine_chunks()
            cols = [own[c].to_numpy().astype(np.int64) for c in ("rid", "pos", "left", "wins")]
            for ha, hb, rid, pos, n, kind in _bucket(f, *cols, own["text"].chunk(0)):
                yield pa.RecordBatch.from_arrays([A.int64(ha), A.int64(hb), pa.array(rid), pa.array(pos), pa.array(n), pa.array(kind)], ["ha", "hb", "rid", "pos", "n", "kind"])

    parts, now = [], None
    for b in batches:
        bucket = b.column(0).to_numpy()
        cut = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        for s, e in zip(cut[:-1], cut[1:]):
            if s == e:
                continue
            if now is not None and bucket[s] != now:
                yield from done(parts)
                parts = []
            now = bucket[s]
            parts.append(b.slice(s, e - s))
    if parts:
        yield from done(parts)


def _remove(batches):
    """(doc_id, text, rid, keys, alone) to the kept bytes of each document."""
    for b in batches:
        data, off = T.texts(b.column(1))
        runs = b.column(4)
        kept, removed, spans = [], [], []
        for i, j in T.pieces(off):
            piece, own = data[off[i]:off[j]], off[i:j + 1] - off[i]
            p, lo, hi, doc = samples(piece, own)
            ok = A.member(_lead(piece, p), doc, b.column(3), i)
            step = np.zeros(len(piece) + 1, np.int64)
            np.add.at(step, lo[ok], 1)
            np.add.at(step, hi[ok] + 1, -1)
            starts = np.cumsum(step[:-1]) > 0
            for k in range(i, j):
                for r in runs[k].as_py() or ():
                    s = own[k - i] + r["pos"]
                    starts[s:s + r["n"]] = False
            out = A.covered(np.flatnonzero(starts), WINDOW, len(piece))
            edge = np.flatnonzero(out & ~np.r_[False, out[:-1]] | _document_starts(out, own))
            spans.append(np.diff(np.searchsorted(edge, own)))
            total = np.r_[0, np.cumsum(out)]
            removed.append(np.diff(total[own]))
            for k in range(i, j):
                a, z = own[k - i], own[k - i + 1]
                kept.append(piece[a:z][~out[a:z]].tobytes() if removed[-1][k - i] else piece[a:z].tobytes())
        if kept:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(np.concatenate(removed)), pa.array(np.concatenate(spans)),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _document_starts(out: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Removed bytes that begin a document, each the start of a span of its own."""
    first = np.zeros(len(out), bool)
    at = own[:-1][np.diff(own) > 0]
    first[at] = out[at]
    return first


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept: each text's bytes without its repeated windows."""
    spark = docs.sparkSession
    rows = A.keyed(docs, doc_id, text)
    keys = A.repeated(rows, _find)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = Ranges(*splitters(rows, parts * BUCKETS))
    held = rows.join(keys, "rid").select("doc_id", "text", "rid", "keys")
    found = held.mapInArrow(_suffixes(ranges), "bucket int, split boolean, rid long, pos long, left int, wins int, text binary")
    # neighbouring ranges share a task; the buckets of one string go round the tasks
    task = F.when(F.col("split"), F.col("bucket") % parts).otherwise(F.floor(F.col("bucket") * F.lit(parts) / F.lit(ranges.count)))
    ranged = found.repartitionById(parts, task.cast("int"))
    single = ranged.sortWithinPartitions("bucket").mapInArrow(_sorted_buckets, "ha long, hb long, rid long, pos long, n long, kind byte")
    alone = single.groupBy("ha", "hb").agg(F.count("*").alias("c"), F.max("kind").alias("kind"), F.min(F.struct("rid", "pos", "n")).alias("w"))
    alone = alone.filter((F.col("c") == 1) & (F.col("kind") < SPEAKER))
    alone = alone.groupBy("w.rid").agg(F.collect_list(F.struct("w.pos", "w.n")).alias("alone"))
    both = rows.join(keys, "rid", "left").join(alone, "rid", "left").select("doc_id", "text", "rid", "keys", "alone")
    kind = docs.schema[doc_id].dataType.simpleString()
    return both.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
