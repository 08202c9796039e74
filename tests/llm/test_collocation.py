"""Dynamic itemset counting against plain counts: edge rows, late reachers, long texts, full bit tables, no rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from curata.llm import collocation

SCHEMA = "doc_id long, text string, lang string, source string"


def _rows(n=400, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "the", "of"] * 4
    rows = []
    for k in range(n):
        t = []
        for _ in range(r.randint(0, 60)):
            t.append(r.choice(["new york city", "New York city hall", "na na na na na na", "per se", *r.choices(words, k=6)]))
            t.append(r.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ";", "\x0b"]))
        rows.append((k, "".join(t), r.choice(["en", "en", "en", "de", None]), "s"))
    return [*rows, (None, None, "en", None), (None, "", None, None), (5, " \t.. ", "fr", None), (5, "\x0c" * 9, "fr", None), (6, "one word's", "zz", None)] + [(7, "copy of a text, again", "en", "s")] * 150


def _run(df, least=100, top=2000, share=100, **more):
    freq, totals = collocation.frequent(df, least=least, **more)
    return sorted(map(tuple, collocation.collocations(freq, totals, top, share).collect()))


@pytest.mark.parametrize("least,top,share,shards", [(100, 2000, 100, 4), (20, 7, 60, 3), (3, 2000, 100, 1)])
def test_edge_rows_match_brute_force(spark, least, top, share, shards):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"phrase": F.lit(1), "n": F.lit(2), "len": F.lit(3), "shard": F.lit("x")}).repartition(4)
    want = brute.op11([(lang, text) for _, text, lang, _ in rows], least, top=top, share=share)
    assert len(want) > 10
    assert _run(df, least, top, share, shards=shards) == sorted(want)


def test_full_bit_tables_and_small_pieces_change_nothing(spark, monkeypatch):
    rows = _rows(120, 2)
    rows.append((1, " ".join(f"w{k % 9}" + ("." if k % 50 == 0 else "") for k in range(4000)), "en", None))
    want = sorted(brute.op11([(lang, text) for _, text, lang, _ in rows], 10))
    monkeypatch.setattr(collocation, "MIN_BITS", 64)
    monkeypatch.setattr(collocation, "MAX_BITS", 64)
    assert _run(spark.createDataFrame(rows, SCHEMA).repartition(3), 10) == want


def test_long_texts_are_read_in_overlapping_pieces():
    import numpy as np

    text = ("alpha beta gamma delta. " * 50 + "x" * 500 + " tail end ").encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    collocation.PIECE, old = 64, collocation.PIECE
    try:
        parts = list(collocation._parts(data, off, 5))
    finally:
        collocation.PIECE = old
    assert len(parts) > 10
    starts = []
    at = 0
    for piece, o, first, stop in parts:
        assert piece.tobytes() == text[at:at + len(piece)] and first == 0 and o[-1] == len(piece)
        starts.append(at)
        at += stop
    assert at == len(text)


def test_a_table_and_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert collocation.op11_collocations(spark, str(tmp_path)).collect() == []
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()
    got = sorted(map(tuple, collocation.op11_collocations(spark, sf).collect()))
    assert got == sorted(brute.op11([tuple(r) for r in rows])) and got
