"""Findings on a corpus before it is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T


def duplicates(docs: DataFrame, key: str, digest: str) -> DataFrame:
    """digest, first (smallest key) and number of documents with equal content, where more than one."""
    return docs.groupBy(digest).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks: unresolved references, retired documents, absent embeddings."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def findings(**kinds: DataFrame) -> DataFrame:
    """One table (finding, subject) of several one-column tables of subjects."""
    out = None
    for kind, df in kinds.items():
        one = df.select(F.lit(kind).alias("finding"), F.col(df.columns[0]).cast("string").alias("subject"))
        out = one if out is None else out.unionByName(one)
    return out


def common_to_all(members: DataFrame, marks: DataFrame, by: list[str], mark: list[str]) -> DataFrame:
    """``by``, ``mark``: the marks that every member of a group has.  ``marks`` has a row a member and mark.

    Both sides are counted before they meet, so no group is ever gathered.
    """
    every = members.groupBy(*by).agg(F.count("*").alias("_every"))
    have = marks.groupBy(*by, *mark).agg(F.count("*").alias("_have"))
    return have.join(every, by).where("_have = _every").select(*by, *mark)


def run_pairs(docs: DataFrame, doc: str, items: DataFrame, item: str, words: int, most: int = 64 << 20) -> DataFrame:
    """``doc``, ``item``, run: the distinct runs of so many lower-case words that two texts have in common.

    Runs meet by 64 hash bits and are then compared.  Where the items' texts take at most ``most`` bytes
    times the run's length, their runs go to every executor and no run of a document is shuffled; else both sides are.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        def cut(w: Column) -> Column:
            at = F.when(F.size(w) >= words, F.sequence(F.lit(1), F.size(w) - (words - 1))).otherwise(F.array().cast("array<int>"))
            return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(words)), " ")))

        rows = df.select(key, F.explode(T.let(T.words(F.lower("text")), cut)).alias("run"))
        return rows.select(F.col(key).alias(f"_{key}"), F.xxhash64("run").alias("_hash"), "run")

    held = runs(items, item)
    if words * (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= most:
        held = F.broadcast(held)
    return runs(docs, doc).join(held, ["_hash", "run"]).select(F.col(f"_{doc}").alias(doc), F.col(f"_{item}").alias(item), "run")


def shared_runs(docs: DataFrame, doc: str, items: DataFrame, item: str, words: int, most: int = 64 << 20) -> DataFrame:
    """``doc``, ``item``, shared: how many distinct runs of so many lower-case words two texts have in common."""
    return run_pairs(docs, doc, items, item, words, most).groupBy(doc, item).agg(F.count("*").alias("shared"))
