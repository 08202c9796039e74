"""The pipeline against a plain Python version of its stages (toxicity by the same model's scores)."""

import re

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from curata.llm import common, decontaminate, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = common.read(spark, SF, "documents")
    model = toxicity.train_on(docs, common.read(spark, SF, "labels"))
    clean = {r.doc_id for r in docs.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect() if r.s < 0.5}
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = {}
    for i in sorted(clean):
        kept[re.sub("[A-Z]", lambda m: m[0].lower(), rows[i])] = i
    left = [(i, rows[i]) for i in kept.values()]
    firsts = {c for _, _, c in brute.op7(left)}
    left = [(i, t) for i, t in left if i in firsts]
    grams = set()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for r in common.read(spark, SF, "benchmark").collect():
        w = words(r.text)
        n = min(10, len(w))
        grams |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1) if n}
    sizes = {len(g) for g in grams}
    left = {i for i, t in left if not any(tuple(w[k:k + n]) in grams for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}
    assert 0 < len(left) < len(rows)
    last = docs.filter(F.col("doc_id").isin(sorted(left)))
    want = sorted((r.doc_id, r.copy) for r in mixing.mix(last).collect())
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "copy"]
    assert sorted((r.doc_id, r.copy) for r in got.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "source_mix"]
    assert decontaminate.N == 10


def test_stages_take_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        common.read(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
