"""Connected components of a graph given as rows, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root for all nodes of ``edges`` (a, b); root is the smallest node reachable.

    Large star: every node links its larger neighbours to its smallest one; small star: its smaller
    ones.  Each round is written; rounds are logarithmic in the length of the longest path.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    step, before = 0, None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        rest = large.join(small, F.col("a") == F.col("c"))
        nxt = rest.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(rest.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        written = scratch.write(nxt, f"{name}{step}")
        state = written.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{step - 1}")
        now = written
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
