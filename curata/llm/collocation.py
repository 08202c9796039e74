"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. Words are counted from the first scan on.
A longer phrase becomes active once both its subphrases (all but its last and all but its first word) have reached
the threshold; from the next scan on it is counted, so lengths are counted together in one scan and a long phrase
need not wait for the end of the passes before. Until each phrase has completed a full cycle, the scans go on.

A phrase that reaches the threshold has its share of it, threshold / shards, in one shard at least. So a count is
kept from the first scan with that share on, and for one full cycle; smaller counts of phrases not kept yet can't
matter and go at once, and a phrase that ends its cycle below the threshold goes too.

Activity is not a list of phrases: every scan gets three tables of marks, of bounded size, of the phrases that have reached
the threshold ever and within the last cycle, and of those kept whose cycle is not complete. A window of
words is counted when both its subphrases are in the first table and one is in the second, or when it is in the
third itself. All tasks of a scan see the same tables, so a count covers its whole shard or is not there; phrases
that share a place only make a scan count more than it must.

Texts are read as Arrow batches in pieces; windows are known by two independent 64-bit numbers and a row that has
them, from which their text is read in the end (two texts for one pair of numbers there would stop the job).

Defined results: a null or empty text has no phrases; a null language is ``und``; equal rows count each; a text
of any length is read in pieces that overlap by the words of a window; an empty table gives an empty result;
columns beside those named are not carried.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors as A
from . import common as C
from . import textnum as T

SHARDS, LONGEST, LEAST, TOP, SHARE = 3, 5, 100, 2000, 100
#: Bytes of text that are read at a time, windows whose counts are gathered before they leave a task, and
#: phrases up to which the rows to spell them from are broadcast (their numbers and lengths only).
PIECE, GATHERED, SPELT = 1 << 20, 1 << 20, 1 << 20
#: Places of the tables for each phrase in them, and at least and at most; beyond that tables only filter less.
BITS, MIN_BITS, MAX_BITS = 64, 1 << 16, 1 << 26
EVER, LATE, OPEN = 1, 2, 4
HARD, SOFT = b".,;:!?\n\x0b\x0c\r", b" \t"
_HARD = np.zeros(256, bool)
_HARD[list(HARD)] = True
_BETWEEN = _HARD.copy()
_BETWEEN[list(SOFT)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = re.compile(rb"[%s%s]" % (re.escape(HARD), SOFT))
_NEXT = re.compile(rb"[%s]+[^%s%s]+" % (SOFT, re.escape(HARD), SOFT))


@dataclass
class Tables:
    """One byte for each place, with a bit for the phrases that have reached the threshold ever and late, and for those
    not counted in full (open); a phrase has two places. ``lens`` are the lengths that a scan counts."""

    marks: np.ndarray
    lens: set[int]

    def of(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.marks) - 1)
        out = self.marks[(h & mask).astype(np.int64)]
        some = np.flatnonzero(out)
        out[some] &= self.marks[(h[some] >> np.uint64(32) & mask).astype(np.int64)]
        return out


def _parts(data: np.ndarray, off: np.ndarray, longest: int):
    """Pieces (data, offsets, first document, stop): windows count that start before ``stop``."""
    for i, j in T.pieces(off, PIECE):
        size = int(off[j] - off[i])
        if size <= 2 * PIECE or j > i + 1:
            yield data[off[i]:off[j]], off[i:j + 1] - off[i], i, size
            continue
        text, at = data[off[i]:off[j]].tobytes(), 0
        while at < size:
            gap = _GAP.search(text, min(at + PIECE, size))
            stop = end = gap.start() if gap else size
            for _ in range(longest - 1):
                more = _NEXT.match(text, end)
                if not more:
                    break
                end = more.end()
            yield np.frombuffer(text, np.uint8, end - at, at), np.array([0, end - at]), i, stop - at
            at = stop


def _sum(h: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One position of each different (h, g), and how often it is there (or the sum of its ``n``)."""
    order = np.argsort(h)
    hs, gs = h[order], g[order]
    if ((hs[1:] == hs[:-1]) & (gs[1:] != gs[:-1])).any():
        order = np.lexsort((g, h))
        hs, gs = h[order], g[order]
    first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])]) if len(hs) else np.zeros(0, np.int64)
    return order[first], np.diff(np.r_[first, len(hs)]) if n is None else np.add.reduceat(n[order], first)


def _seed(lang: str, lane: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=bytes([lane] * 16)).digest(), "little")


_BYTE = T.mix(np.arange(1, 257, dtype=np.uint64))


class _Words:
    """The words of a piece of texts: first numbers of all windows, second numbers and texts of some.

    First numbers, which choose the places in the tables, are polynomials of the bytes; second ones are drawn by byte and place."""

    def __init__(self, data, off, first, stop, seeds):
        self.low = low = _LOWER[data]
        self.starts, self.ends, word_off = T.spans(low, off, _BETWEEN)
        self.n = len(self.starts)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(word_off)) + first
        self.seeds, self.second = seeds, None
        byte = T.prefix(_BYTE[low])
        own = (byte[self.ends] - byte[self.starts]) * T.powers(len(byte))[1][self.starts]
        self.pre = T.prefix(T.mix(own ^ seeds[0][self.doc]))
        self.line = np.searchsorted(np.flatnonzero(_HARD[low]), self.starts) + self.doc  # words of one piece share it
        self.own = self.starts < stop

    def firsts(self, k):
        m = self.n - k + 1
        return T.mix((self.pre[k:] - self.pre[:m]) * T.powers(len(self.pre))[1][:m])

    def whole(self, k):
        """Windows of k words inside one piece that this part of a text counts."""
        m = self.n - k + 1
        return self.own[:m] & (self.line[:m] == self.line[k - 1:])

    def _letters(self):
        """All words' bytes one after another, and where each word begins there."""
        size = (self.ends - self.starts).astype(np.int32)
        begin = np.cumsum(size, dtype=np.int32) - size
        return self.low[~_BETWEEN[self.low]], begin, size

    def seconds(self, i, k):
        if self.second is None and len(i) * k * 4 < self.n:  # few windows: the numbers of their words only
            words, at = np.unique(i[:, None] + np.arange(k), return_inverse=True)
            letters = T.letters(self.low, self.starts[words], self.ends[words])
            own = T.mix(T.drawn(*letters, 1) ^ self.seeds[1][self.doc[words]])[at.reshape(len(i), k)]
            return T.mix((own * T.powers(k, 1)[0][:k]).sum(axis=1, dtype=np.uint64))
        if self.second is None:
            byte, begin, size = self._letters()
            at = np.arange(len(byte), dtype=np.int32) - np.repeat(begin, size)
            self.second = T.prefix(T.mix(T.drawn(byte, at, begin, 1) ^ self.seeds[1][self.doc]), 1)
        return T.windows(self.second, i, k, 1)

    def texts(self, i, k):
        byte, begin, size = self._letters()
        at = np.arange(self.n, dtype=np.int32)
        packed = np.full(len(byte) + self.n, 32, np.uint8)
        packed[np.arange(len(byte), dtype=np.int32) + np.repeat(at, size)] = byte
        packed, place, last = packed.tobytes(), begin + at, i + k - 1
        return pa.array([packed[a:b] for a, b in zip(place[i].tolist(), (place[last] + size[last]).tolist())], pa.binary()).cast(pa.string())


def _pieces(batches, longest: int):
    """The words of all pieces of (lang, text, at) batches, with the batch's row numbers."""
    for batch in batches:
        data, off = T.texts(batch.column(1))
        coded = batch.column(0).dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        seeds = [np.array([_seed(x, k) for x in names], np.uint64)[code] for k in (0, 1)]
        ids = A.numbers(batch.column(2))
        for piece in _parts(data, off, longest):
            words = _Words(*piece, seeds)
            if words.n:
                yield words, ids


_COUNTS = ["h", "g", "len", "n", "begin", "doc"]


def counter(tables, words: bool, longest: int):
    """mapInArrow function over (lang, text, at) to (h, g, len, n, begin, doc): windows that are counted in this scan, whether
    a count may begin here (those that are only in the table of open cycles go on, they begin nothing), and a row that has
    the window. While ``words`` are counted, rows of length 0 have the number of all words under the language's numbers.

    ``tables`` is a broadcast of :class:`Tables` or None before any phrase is kept."""

    def flush(k, parts):
        h, g, begin, doc = (np.concatenate(x) for x in zip(*parts))
        one, times = _sum(h, g)
        return pa.RecordBatch.from_arrays([A.int64(h[one]), A.int64(g[one]), pa.array(np.full(len(one), k, np.int8)), pa.array(times.astype(np.int64)), pa.array(begin[one]),
                                           pa.array(doc[one])], _COUNTS)

    def totals(w, ids):
        doc, times = np.unique(w.doc[w.own], return_counts=True)
        h, g = w.seeds[0][doc], w.seeds[1][doc]
        one, n = _sum(h, g, times)
        return pa.RecordBatch.from_arrays([A.int64(h[one]), A.int64(g[one]), pa.array(np.zeros(len(one), np.int8)), pa.array(n.astype(np.int64)), pa.array(np.ones(len(one), bool)),
                                           pa.array(ids[doc[one]])], _COUNTS)

    def run(batches):
        table = tables.value if tables is not None else None
        lens = (table.lens if table is not None else set()) | ({1} if words else set())
        held, size = {k: [] for k in lens}, dict.fromkeys(lens, 0)
        for w, ids in _pieces(batches, longest):
            if words and w.own.any():
                yield totals(w, ids)
            above = None
            for k in range(1, min(max(lens), w.n) + 1):
                if k not in lens and k + 1 not in lens:
                    above = None
                    continue
                h = w.firsts(k)
                marks = table.of(h) if table is not None else np.zeros(len(h), np.uint8)
                if k in lens:
                    begin = np.full(len(h), words) if k == 1 else (above[:-1] & above[1:] & EVER > 0) & ((above[:-1] | above[1:]) & LATE > 0)
                    i = np.flatnonzero((begin | (marks & OPEN > 0)) & w.whole(k))
                    if len(i):
                        held[k].append((h[i], w.seconds(i, k), begin[i], ids[w.doc[i]]))
                        size[k] += len(i)
                        if size[k] >= GATHERED:
                            yield flush(k, held[k])
                            held[k], size[k] = [], 0
                above = marks
        for k in held:
            if held[k]:
                yield flush(k, held[k])

    return run


def speller(longest: int):
    """mapInArrow function over (lang, text, at, h, len), the last two lists of the phrases to spell from this row, to
    (lang, h, g, phrase): one row for each phrase and second number that the text has under it."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("g", pa.int64()), ("phrase", pa.string())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                want, lens = np.array(row.column(3)[0].as_py(), np.int64).view(np.uint64), np.array(row.column(4)[0].as_py())
                for w, _ in _pieces([row], longest):
                    for k in np.unique(lens[lens <= w.n]).tolist():
                        h = w.firsts(k)
                        i = np.flatnonzero(np.isin(h, want[lens == k]) & w.whole(k))
                        if len(i):
                            g = w.seconds(i, k)
                            one, _ = _sum(h[i], g)
                            at = i[one]
                            yield pa.RecordBatch.from_arrays([pa.array([row.column(0)[0].as_py()] * len(at)), A.int64(h[at]), A.int64(g[one]), w.texts(at, k)], schema=schema)

    return run


def _languages(batches):
    """(lang) with the numbers of its total."""
    for b in batches:
        names = b.column(0).to_pylist()
        numbers = [A.int64(np.array([_seed(x, k) for x in names], np.uint64)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), *numbers], ["lang", "h", "g"])


def _tables(state: DataFrame, step: int, shards: int, longest: int) -> Tables:
    """The tables for scan ``step`` (as rows they are bounded by their places)."""
    state = state.filter("len > 0")
    reached = F.col("reach").isNotNull()
    late, open_ = reached & (F.col("reach") >= step - shards), F.col("since") > step - shards
    got = state.agg(F.count("*").alias("n"), F.collect_set(F.when(late, F.col("len") + 1)).alias("late"), F.collect_set(F.when(open_, F.col("len"))).alias("open")).first()
    size = MIN_BITS
    while size < min(MAX_BITS, BITS * got["n"]):
        size *= 2
    mark = sum((F.when(m, bit).otherwise(0) for m, bit in ((late, LATE), (open_, OPEN))), F.when(reached, EVER).otherwise(0))
    places = F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1)))
    place = F.col("place")
    # eight places in one row: a table of the most places comes as an eighth of them
    octet = F.call_function("shiftleft", F.col("mark").cast("long"), (F.pmod(place, F.lit(8)) * 8).cast("int"))
    rows = state.select(mark.alias("mark"), F.explode(places).alias("place")).select(F.shiftright(place, 3).alias("at"), octet.alias("octet")).groupBy("at").agg(F.bit_or("octet").alias("octet")).toArrow()
    marks = np.zeros(size >> 3, np.int64)
    marks[rows["at"].to_numpy()] = rows["octet"].to_numpy()
    return Tables(marks.astype("<i8").view(np.uint8), {k for k in (*got["late"], *got["open"]) if k <= longest})


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
             shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, len, f) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n)
    of all word occurrences."""
    spark = docs.sparkSession
    C.ship(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    corpus = C.new_path(spark)  # any numbers and any deal of the rows will do, also others when a task runs again
    rows.select("lang", "text", "at", F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("shard")).write.partitionBy("shard").parquet(corpus)
    texts = spark.read.schema("lang string, text string, at long, shard int").parquet(corpus)
    by_shard, share = [f"c{k}" for k in range(shards)], -(-least // shards)
    whole = sum((F.col(c) for c in by_shard[1:]), F.col(by_shard[0]))
    state, path, step, tables = None, None, 0, None
    while step < shards or tables.lens:
        now = by_shard[step % shards]
        sent = spark.sparkContext.broadcast(tables) if tables is not None else None
        scan = texts.filter(F.col("shard") == step % shards).select("lang", "text", "at")
        found = scan.mapInArrow(counter(sent, step < shards, longest), "h long, g long, len byte, n long, begin boolean, doc long")
        no = lambda kind: F.lit(None).cast(kind)
        found = found.select("h", "g", "len", "n", "begin", "doc", *[no("long").alias(c) for c in by_shard], no("int").alias("since"), no("int").alias("reach"))
        if state is not None:
            found = found.unionAll(state.select("h", "g", "len", no("long").alias("n"), no("boolean").alias("begin"), "doc", *by_shard, "since", "reach"))
        count = lambda c: F.coalesce(F.greatest(F.max(c), F.sum("n")) if c == now else F.max(c), F.lit(0))
        sums = found.groupBy("h", "g").agg(F.min("len").alias("len"), F.sum("n").alias("n"), F.max("begin").alias("begin"), F.min("doc").alias("doc"), *[count(c).alias(c) for c in by_shard], F.min("since").alias("since"), F.min("reach").alias("reach"))
        sums = sums.filter(F.col("since").isNotNull() | (F.col("begin") & ((F.col("n") >= share) | (F.col("len") == 0)))).withColumn("since", F.coalesce("since", F.lit(step)))
        sums = sums.withColumn("reach", F.when(whole >= least, F.coalesce("reach", F.lit(step))))
        new = C.new_path(spark)
        sums.filter((F.col("len") == 0) | F.col("reach").isNotNull() | (F.col("since") > step + 1 - shards)).drop("n", "begin").write.parquet(new)
        state = spark.read.parquet(new)
        if sent is not None:
            sent.destroy()
        if path is not None:
            C.drop_path(spark, path)
        path, step = new, step + 1
        tables = _tables(state, step, shards, longest)
    known = state.filter("len > 0 AND reach IS NOT NULL")
    # the text of a phrase is read from one row that has it
    rows = C.materialise(known.groupBy(F.col("doc").alias("at")).agg(F.collect_list("h").alias("hs"), F.collect_list("len").alias("lens")))
    small = rows.agg(F.sum(F.size("hs"))).first()[0] or 0
    spelt = texts.join(F.broadcast(rows) if small <= SPELT else rows, "at").select("lang", "text", "at", "hs", F.col("lens").cast("array<int>"))
    spelt = spelt.mapInArrow(speller(longest), "lang string, h long, g long, phrase string")
    spelt = C.materialise(spelt.groupBy("h", "g").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"), F.max("phrase").alias("other")))
    langs = texts.select("lang").distinct().mapInArrow(_languages, "lang string, h long, g long")
    totals = C.materialise(state.filter("len = 0").join(langs, ["h", "g"]).select("lang", whole.alias("n")))
    phrase = F.when(F.col("phrase") == F.col("other"), F.col("phrase")).otherwise(F.raise_error(F.lit("two phrases with equal numbers")).cast("string"))
    freq = known.join(spelt, ["h", "g"]).select("lang", phrase.alias("phrase"), F.col("len").cast("int").alias("len"), whole.alias("f"))
    freq = C.materialise(freq)
    C.drop_path(spark, corpus)
    return freq, totals


def collocations(freq: DataFrame, totals: DataFrame, top: int = TOP, share: int = SHARE) -> DataFrame:
    """Each language's ``top`` phrases by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A phrase goes when a longer frequent one that holds its words has at least ``share`` percent of its count.
    Scores are exact: products are decimals of 38 digits."""
    words = F.split("phrase", " ")
    part = lambda w, i, n: F.array_join(F.slice(w, i, n), " ")
    longer = freq.filter("len > 2").select("lang", "f", words.alias("w"), "len")
    inner = longer.select("lang", "f", "w", "len", F.explode(F.sequence(F.lit(2), F.col("len") - 1)).alias("k"))
    inner = inner.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("k") + 1)).alias("i"))
    held = inner.groupBy("lang", part(F.col("w"), F.col("i"), F.col("k")).alias("phrase")).agg(F.max("f").alias("held"))
    some = freq.filter("len > 1").join(held, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (F.col("held") * 100 < F.col("f") * share))
    some = C.attach(some.withColumnRenamed("f", "a"), totals, ["lang"], "phrase")
    cuts = some.select("lang", "phrase", "a", "n", words.alias("w"), "len", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", part(F.col("w"), F.lit(1), F.col("k")).alias("left"), part(F.col("w"), F.col("k") + 1, F.col("len") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):  # a common word is part of many phrases
        cuts = C.lookup(C.materialise(cuts), freq.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], "phrase")
    score = F.expr("(CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0))) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    best = best.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(*frequent(C.read(spark, sf_dir, "documents")))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
u AS (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < k),
h AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS held FROM u GROUP BY ALL),
x AS (SELECT c.*, unnest(range(1, k)) AS j FROM c LEFT JOIN h USING (lang, phrase) WHERE held IS NULL OR 100 * held < 100 * a),
s AS (SELECT x.lang, x.phrase, x.a, x.j, fl.f AS l, fr.f AS r, n.n, (1000::HUGEINT * x.a * n.n) // (fl.f::HUGEINT * fr.f) AS score FROM x
  JOIN n ON n.lang = x.lang JOIN f fl ON fl.lang = x.lang AND fl.phrase = array_to_string(list_slice(x.w, 1, j), ' ')
  JOIN f fr ON fr.lang = x.lang AND fr.phrase = array_to_string(list_slice(x.w, j + 1, x.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
