"""Helpers shared by the operators: reading, row keys, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import curata
from curata.session import cut_lineage, drop_path, new_path  # noqa: F401

#: Most rows that a broadcast side may have; beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 200_000
#: ASCII white space, the separator of "plain" words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, for functions that run in Python there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(curata.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="curata-code-"), "curata_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"{n}_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit key made from a row's content, the same in every scan and on every retry."""
    return F.xxhash64(doc_id, text)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back (a lost executor loses nothing)."""
    return cut_lineage(df)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table, marked for broadcast when its counted size is within ``rows``, else left as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def lookup(rows: DataFrame, table: DataFrame, on: list[str], salt_by: str, ways: int = 64) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row for each ``on``); values of ``on`` that many rows share are dealt
    over ``ways`` tasks by a hash of ``salt_by``. ``rows`` is read twice, so it should be a materialised table."""
    (salt,) = fresh(rows, "salt")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(ways)))
    there = rows.select(*on, salt).distinct().join(table, on)  # at most ``ways`` rows for each value
    return rows.join(there, [*on, salt], "left").drop(salt)


def attach(rows: DataFrame, table: DataFrame, on: list[str], salt_by: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (materialised, one row for each ``on``): by broadcast while its counted size
    is within ``BROADCAST_ROWS``, else by :func:`lookup`."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, "left")
    return lookup(rows, table, on, salt_by)
