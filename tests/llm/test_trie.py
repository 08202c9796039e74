"""The prefix trie against plain Python, on the table, edge rows, long and repeated conversations, and no rows."""

import random

import brute
from pyspark.sql import functions as F

from curata.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _same(df, want):
    assert df.columns == COLUMNS
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def _rows():
    r = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(95, 130), 201, 203, 500, 555]:
        for t in range(r.choice([1, 1, 2, 4, 8])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "hi", "é😀", None, "long " * 20])))
    rows += [(700 + k, t, "user", "same") for k in range(60) for t in range(7)]  # one conversation many times
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 1, "b", "tie"), (8, 1, "a", "tie"), (None, 0, "user", "nobody"), (9, 0, "a\nb", "x"), (10, 0, "a", "\nbx")]
    rows += [(1203, 0, "user", "short")]  # its base is absent: turnless when its first h turns are dropped
    return rows


def test_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in common.read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    _same(trie.op13_prefix_trie(spark, sf), brute.op13(rows))


def test_edge_rows_match_brute_force(spark, tmp_path):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"name": F.lit(1), "pos": F.lit(2), "top": F.lit("x")})
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute.op13(rows)
    assert any(d == 0 and n > 1 for _, d, _, n, *_ in want)
    _same(trie.op13_prefix_trie(spark, str(tmp_path)), want)


def test_long_conversation_and_deep_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)  # ends of a node in several pieces
    rows = [(c, t, "user", f"t{t if c % 3 else t % 5}") for c in range(12) for t in range(400 + c % 2)]
    convs = {}
    for c, _, role, text in rows:
        convs.setdefault(c, []).append((role, text))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    _same(trie.prefix_trie(df), brute.trie(convs))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    _same(trie.op13_prefix_trie(spark, str(tmp_path)), [])
    only = spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)
    _same(trie.prefix_trie(only), [])


def test_lookup_spreads_a_hot_value(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    table = spark.range(-1, 1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {r.id: r.v for r in common.lookup(rows, table, ["k"], "id").collect()}
    assert got == {i: (-2 if i % 3 else i * 2 if i < 1500 else None) for i in range(3000)}
