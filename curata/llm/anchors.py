"""Which hashed anchors occur more than once, and in which documents.

Every document emits (anchor hash, row key). Anchors that repeat within a task's buffer are known
repeats at once: one of them stays to tell the other tasks, the rest travel under salted keys. So an
anchor found in a third of all documents is a few rows per task in the exchange by hash, and its
other rows are spread evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import textnum as T

#: Anchors that a task gathers before it looks for repeats among them.
BUFFER = 1 << 20
ALONE, SPEAKER, KNOWN = 0, 1, 2


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and the row key rid, the input of all steps (one exchange by rid serves them all)."""
    C.ship(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), C.row_key(F.col(doc_id), F.col(text)).alias("rid"))


def int64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _flush(h: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((rid, h))
    h, rid = h[order], rid[order]
    new = np.r_[True, h[1:] != h[:-1]]
    many = np.repeat(np.diff(np.r_[np.flatnonzero(new), len(h)]) > 1, np.diff(np.r_[np.flatnonzero(new), len(h)]))
    once = new | np.r_[True, rid[1:] != rid[:-1]]  # an anchor twice in one document needs one row
    kind = np.where(many, np.where(new, SPEAKER, KNOWN), ALONE).astype(np.int8)
    key = np.where(kind == KNOWN, h ^ rid.view(np.uint64), h)
    return pa.RecordBatch.from_arrays([int64(key[once]), pa.array(rid[once]), pa.array(kind[once])], ["k", "rid", "kind"])


def emitter(find):
    """mapInArrow function over (.., text at 1, rid at 2); ``find(data, off)`` gives anchor hashes and their documents."""

    def run(batches):
        hs, rids, held = [], [], 0
        for b in batches:
            data, off = T.texts(b.column(1))
            rid = numbers(b.column(2))
            for i, j in T.pieces(off):
                h, doc = find(data[off[i]:off[j]], off[i:j + 1] - off[i])
                hs.append(h)
                rids.append(rid[i + doc])
                held += len(h)
                if held >= BUFFER:
                    yield _flush(np.concatenate(hs), np.concatenate(rids))
                    hs, rids, held = [], [], 0
        if held:
            yield _flush(np.concatenate(hs), np.concatenate(rids))

    return run


def repeated(rows: DataFrame, find) -> DataFrame:
    """Columns rid, keys: the repeated anchors of each document that has any, as a table in the shared folder."""
    found = rows.mapInArrow(emitter(find), "k long, rid long, kind byte")
    found = found.withColumn("n", F.count("*").over(Window.partitionBy("k"))).filter((F.col("n") > 1) | (F.col("kind") > 0))
    own = found.select("rid", F.when(F.col("kind") == KNOWN, F.col("k").bitwiseXOR(F.col("rid"))).otherwise(F.col("k")).alias("k"))
    return C.materialise(own.groupBy("rid").agg(F.collect_set("k").alias("keys")))


def member(values: np.ndarray, docs: np.ndarray, lists: pa.Array, first: int) -> np.ndarray:
    """Whether values[i] is in the list of document first + docs[i] (a null list is empty)."""
    if not len(values):
        return np.zeros(0, bool)
    n = int(docs.max()) + 1
    part = lists.slice(first, n)
    size = np.diff(np.asarray(part.offsets)) if not part.null_count else np.array([0 if v is None else v for v in part.value_lengths().to_pylist()])
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    salt = T.mix(np.arange(1, n + 1, dtype=np.uint64))
    return np.isin(values ^ salt[docs], flat ^ np.repeat(salt, size))


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Positions 0..n inside [s, s + size) of any start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:n]) > 0
