"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by it within their source, and a
distributed prefix sum of sizes says where each one lies in its source's epoch.  A source is cut at
its exact budget of words: whole epochs first, then the part of the next epoch before the cut; the
document at the cut gives the words up to it.  Reruns agree, as the key depends on the document only.

Targets: sources in code point order, null last, take ``weights`` in turn.  The budget is
``share`` times all sizes, dealt by weight; a target stops at ``most`` times its source's size, and
the excess is dealt again by weight among the others: target = min(weight * level, most * size) with
the one level that spends the budget.  Only a row a source takes part in this.

Defined cases: a null text has size 0; a document without words takes nothing; a null source is a
source; equal documents (repeated rows) have separate places; an empty table gives no rows; a source
without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, numbered, prefix_sums

NOT_SPACE = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Runs of anything but white space.  Counted as starts: a non-space after a space or at the start."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target from a row a source (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("_i", (F.row_number().over(by_name) - 1) % len(weights))
    named = named.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i") + 1))
    named = named.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    # Sources reach their caps in the order of cap / weight; the level lies after the last that does.
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum(
        "_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    named = named.withColumn("_level", level)
    # The first source, in that order, whose cap is not below the level that is left for it and all after it.
    named = named.withColumn("_free", F.col("_cap") >= F.col("_w") * F.col("_level"))
    named = named.withColumn("_final", F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(by_cap.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("_cap", F.coalesce(F.col("_w") * F.col("_final"), F.col("_cap")))
    return named.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the columns ``keep``."""
    scratch = Scratch(docs.sparkSession)
    keep = keep or []
    rows = docs.select(
        "doc_id", "source", count_words(F.col("text")).alias("size"),
        F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_key"),
        F.xxhash64("text").alias("_tie"), *keep)
    placed = prefix_sums(scratch, rows, ["source"], [F.col("_key"), F.col("_tie")], "size", "_before", "mix")
    sized = scratch.spark.read.schema(placed.select("source", "size").schema).parquet(scratch.paths["mix"])
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, most)
    goal = goal.withColumn("_budget", F.floor(F.col("target") + 0.5))
    goal = goal.withColumnRenamed("source", "_source")
    out = placed.join(goal, F.col("source").eqNullSafe(F.col("_source")), "inner").drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("_budget") - epochs * F.col("source_size") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for every repeat, the document at a cut shortened."""
    marked = numbered(docs, Scratch(docs.sparkSession))  # rows are told apart by numbers, and no column of theirs is touched
    rows = marked.select(*[F.col(f"_doc.{c}").alias(c) for c in ("doc_id", "source", "text")], F.col("_row").alias("_at"))
    taken = plan(rows, keep=["_at"], **how).where("taken > 0").select("_at", "size", "taken")
    full, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    repeats = F.concat(F.array_repeat(F.col("size"), full.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array()))
    mixed = marked.join(taken, F.col("_row") == F.col("_at")).select("_doc", "size", F.explode(repeats).alias("_words"))
    words = F.filter(F.split("_doc.text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = F.when(F.col("_words") == F.col("size"), F.col("_doc.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " "))
    return mixed.select(*[(cut if c == "text" else F.col("_doc").getField(c)).alias(c) for c in docs.columns])
