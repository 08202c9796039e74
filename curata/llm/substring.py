"""Substring dedup with difference-cover anchors.

A cover D modulo v holds two members at every distance modulo v, so for any two positions some shift
below v brings both onto the cover. Hashing the ``window - v + 1`` words from cover positions only,
any repeated window shares at least one aligned anchor with its other occurrence. Repeated
anchors are extended to the windows that hold them; a window stays a repeat unless the hash of its
whole word sequence (128 bits) turns out to be alone.

Defined results: null and empty texts have no words; documents shorter than a window keep everything;
equal rows repeat each other; the kept words are joined by one space; an empty table gives an empty
result; columns other than the id and the text are not carried.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import common as C
from . import textnum as T

WINDOW = 35
#: Perfect difference set: every distance modulo 21 is the difference of one pair.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
OUT = "doc_id long, n_words long, n_removed long, kept string"


def _anchors(window: int):
    size = window - PERIOD + 1
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True

    def find(word_off: np.ndarray, pre: np.ndarray):
        """Hashes and positions of all anchors, and their documents."""
        n = np.diff(word_off)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(on[(np.arange(len(doc)) - word_off[doc]) % PERIOD])
        at = at[at + size <= word_off[doc[at] + 1]]
        return T.windows(pre, at, size), at, doc[at]

    return find, size


def _words(data: np.ndarray, off: np.ndarray):
    """The first numbers of all words, the n + 1 offsets of each document's words, and a call for the second numbers.

    Both numbers are drawn by byte and place, independently of each other."""
    starts, ends, word_off = T.spans(data, off)
    letters = T.letters(data, starts, ends)
    return T.drawn(*letters, 0), word_off, lambda: T.drawn(*letters, 1)


def _emit(window: int):
    find, _ = _anchors(window)

    def run(data, off):
        ids, word_off, _ = _words(data, off)
        h, _, doc = find(word_off, T.prefix(ids))
        return h, doc

    return run


def _candidates(ids, word_off, lists, first, window):
    """Starts of the windows that hold a repeated anchor among their first ``PERIOD`` positions, and their documents."""
    find, _ = _anchors(window)
    pre = T.prefix(ids)
    h, at, doc = find(word_off, pre)
    ok = A.member(h, doc, lists, first)
    at, doc = at[ok], doc[ok]
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, np.maximum(at - PERIOD + 1, word_off[doc]), 1)
    np.add.at(step, at + 1, -1)
    starts = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    doc = np.searchsorted(word_off, starts, "right") - 1
    fits = starts + window <= word_off[doc + 1]
    return starts[fits], doc[fits], pre


def _windows(window: int):
    """(doc_id, text, rid, keys) to (ha, hb, rid, kind): the candidate windows, repeats within a buffer once."""

    def flush(parts):
        a, b, rid = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, rid = a[order], b[order], rid[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        many = np.diff(np.r_[np.flatnonzero(new), len(a)]) > 1
        return pa.RecordBatch.from_arrays([A.int64(a[new]), A.int64(b[new]), pa.array(rid[new]), pa.array(many.astype(np.int8))], ["ha", "hb", "rid", "kind"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            data, off = T.texts(batch.column(1))
            rid = A.numbers(batch.column(2))
            for i, j in T.pieces(off):
                ids, word_off, second = _words(data[off[i]:off[j]], off[i:j + 1] - off[i])
                starts, doc, pre = _candidates(ids, word_off, batch.column(3), i, window)
                if not len(starts):
                    continue
                parts.append((T.windows(pre, starts, window), T.windows(T.prefix(second(), 1), starts, window, 1), rid[i + doc]))
                held += len(starts)
                if held >= A.BUFFER:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _remove(window: int):
    """(doc_id, text, rid, keys, alone) to the kept words of each document."""

    def run(batches):
        for batch in batches:
            data, off = T.texts(batch.column(1))
            raw = data.tobytes()
            kept, words, removed = [], [], []
            for i, j in T.pieces(off):
                ids, word_off, _ = _words(data[off[i]:off[j]], off[i:j + 1] - off[i])
                starts, doc, pre = _candidates(ids, word_off, batch.column(3), i, window)
                starts = starts[~A.member(T.windows(pre, starts, window), doc, batch.column(4), i)]
                out = A.covered(starts, window, len(ids))
                total = np.add.reduceat(np.r_[out, False].astype(np.int64), np.minimum(word_off[:-1], len(out))) * (np.diff(word_off) > 0)
                words.append(np.diff(word_off))
                removed.append(total)
                for k in range(i, j):
                    own = raw[off[k]:off[k + 1]].split()
                    if total[k - i]:
                        own = compress(own, (~out[word_off[k - i]:word_off[k - i + 1]]).tolist())
                    kept.append(b" ".join(own))
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words)), pa.array(np.concatenate(removed)),
                                                  pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept: each text without the words of its repeated windows."""
    if window <= PERIOD:
        raise ValueError(f"the window must be longer than the period of {PERIOD}")
    rows = A.keyed(docs, doc_id, text)
    keys = A.repeated(rows, _emit(window))
    held = rows.join(keys, "rid").select("doc_id", "text", "rid", "keys")
    cut = held.mapInArrow(_windows(window), "ha long, hb long, rid long, kind byte")
    alone = cut.groupBy("ha", "hb").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.min("rid").alias("rid"))
    alone = alone.filter("n = 1 and kind = 0").groupBy("rid").agg(F.collect_list("ha").alias("alone"))
    both = rows.join(keys, "rid", "left").join(alone, "rid", "left").select("doc_id", "text", "rid", "keys", "alone")
    return both.mapInArrow(_remove(window), OUT.replace("doc_id long", f"doc_id {docs.schema[doc_id].dataType.simpleString()}"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
