"""Corpus preparation: toxicity, exact copies, near copies, benchmark passages, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes every stage's
result as Parquet to the shared checkpoint folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from curata.llm import common, decontaminate, exact, mixing, simhash, toxicity


def toxicity_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; it learns from the labels of the documents given."""
    return toxicity.reject(docs, toxicity.train_on(docs, common.read(spark, sf_dir, "labels")))


def exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays: the one with the largest doc_id."""
    return exact.deduplicate(docs)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links stays: the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned to their source's target; ``copy`` numbers the repeats."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix)]
#: A trained classifier and connected components are not SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
