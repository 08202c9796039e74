"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two aggregations and joins on node ids and one table in the shared checkpoint folder.
A star's centre can hold a third of all links: minima are partial sums, and the join that hands them
back is a plain sort-merge join, which Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node move to the least of its circle. Small star: those below do."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    moved = both.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Columns node, root: for every node of ``links`` (columns a, b) the least node that it reaches.

    Stops when a double round leaves the table as it was (same rows by count and checksum).
    """
    links = C.materialise(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        links = C.materialise(_star(_star(links, True), False))
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
