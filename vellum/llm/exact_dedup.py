"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only.

Each input partition is reduced to a run: its distinct digests in order, with the identifier to keep
and the number of copies.  Runs are merged in binomial rounds of ``fan_in``: run r sends to run
``r - r % fan_in**k``.  A merge brings the runs that meet into one (run, digest) order and passes over
it once, as a sort aggregate: no hash table, so any number of digests fits a task.  Every level keeps
per digest the verified extreme identifier: rows meet only if SHA-256, byte length and a second,
independent 64-bit hash all agree.  The runs of every level are dealt by digest, so the last run is
spread over the cluster as well.

The tree is then descended: the root's decision goes to the leaves by digest (one row a run and
digest, so at most one a run for a hot digest), and from a leaf to its documents by (run, digest),
whose copies all fit one input partition.  No key therefore ever gathers a large group.

Defined cases: a null text counts as empty; in ``report`` equal texts with the same doc_id (repeated
rows) are copies that all carry the kept doc_id, and a null doc_id never wins against another;
``dedup`` keeps exactly one row of equal texts, of repeated ones the first; an empty table gives no
rows; other columns are ignored by ``report`` and kept by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, numbered, shuffle_width

KEY = ["_digest", "_bytes", "_check"]
#: The setting by which Spark aggregates sorted input without a hash table.
SORTED_MERGE = "spark.sql.execution.replaceHashWithSortAgg"


def report(docs: DataFrame, keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    best, first = {"smallest": (F.min, F.col("_id").asc_nulls_last()), "largest": (F.max, F.col("_id").desc_nulls_last())}[keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_check"), F.spark_partition_id().alias("_run"))
    rows = scratch.write(rows, "rows")  # a run must not change if a task is repeated
    width = shuffle_width(spark)

    def merged(df: DataFrame, name: str) -> DataFrame:
        # The identifier to keep comes first among a digest's rows.
        ordered = df.repartition(width, "_run", "_digest").sortWithinPartitions("_run", *KEY, first)
        before = spark.conf.get(SORTED_MERGE)
        spark.conf.set(SORTED_MERGE, "true")
        try:
            return scratch.write(ordered.groupBy("_run", *KEY).agg(F.first("_id", ignorenulls=True).alias("_id"), F.sum("_n").alias("_n")), name)
        finally:
            spark.conf.set(SORTED_MERGE, before)

    # A run's copies are counted where they are read, before anything is sent.
    copies = rows.groupBy("_run", *KEY).agg(best("doc_id").alias("_id"), F.count("*").alias("_n"))
    leaves = scratch.write(copies.sortWithinPartitions("_run", *KEY), "leaves")
    top, at, name = leaves, 1, "leaves"
    runs = (leaves.agg(F.max("_run")).first()[0] or 0) + 1
    while at < runs:
        at *= fan_in
        sent = top.withColumn("_run", F.col("_run") - F.col("_run") % at)
        top, last, name = merged(sent, f"round{at}"), name, f"round{at}"
        if last != "leaves":
            scratch.drop(last)
    root = top.select(*KEY, F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"))
    down = leaves.select("_run", *KEY).join(root, KEY)
    found = rows.repartition(width, "_run", *KEY).join(down.repartition(width, "_run", *KEY), ["_run", *KEY])
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def dedup(docs: DataFrame, keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """The rows that stay, one of each text, with all their columns."""
    marked = numbered(docs, Scratch(docs.sparkSession))
    # Rows by doc_id, null behind all others either way, then by their own numbers, the first before the rest.
    order = {"smallest": (F.col("_doc.doc_id").isNull(), F.col("_row")), "largest": (F.col("_doc.doc_id").isNotNull(), -F.col("_row"))}[keep]
    rows = marked.select(F.struct(order[0].alias("rank"), "_doc.doc_id", order[1].alias("row")).alias("doc_id"), F.col("_doc.text").alias("text"))
    kept = report(rows, keep, fan_in).where("kept").select(F.abs("doc_id.row").alias("_kept"))
    return marked.join(kept, marked["_row"] == kept["_kept"], "left_semi").select("_doc.*")
