"""Answers as tables: claims, their citations, what supports them, and what was disclosed to whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import checks

CLAIM = ["answer_id", "claim"]


def supported(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each claim: citations, invented (not among the evidence supplied for its answer), unfounded quantities, supported.

    ``claims``: answer_id, claim, text; ``citations``: answer_id, claim, chunk_id; ``evidence``: answer_id,
    chunk_id, text, all of it authorized.  A claim is supported if it cites something, nothing that is
    invented, each of its quantities is in a cited text, and some cited text agrees on negation.
    """
    ours = evidence.select(F.col("answer_id").alias("_a"), F.col("chunk_id").alias("_c"), F.col("text").alias("_text"))
    cited = citations.select(*CLAIM, "chunk_id").distinct()
    cited = cited.join(ours, (F.col("answer_id") == F.col("_a")) & (F.col("chunk_id") == F.col("_c")), "left")
    cited = cited.select(*CLAIM, F.col("_c").isNull().alias("_invented"), checks.quantities(F.col("_text")).alias("_has"), checks.negated(F.col("_text")).alias("_not"))
    rows = claims.select(*CLAIM, checks.quantities(F.col("text")).alias("_needs"), checks.negated(F.col("text")).alias("_negated")).join(cited, CLAIM, "left")
    # A quantity is unfounded if no cited text has it: counted by quantity, so that nothing is gathered a claim.
    needs = rows.select(*CLAIM, F.explode("_needs").alias("_q"), "_has").groupBy(*CLAIM, "_q").agg(
        F.max(F.coalesce(F.array_contains("_has", F.col("_q")), F.lit(False))).alias("_found"))
    missing = needs.where(~F.col("_found")).groupBy(*CLAIM).agg(F.count("*").alias("unfounded"))
    per = rows.groupBy(*CLAIM).agg(
        F.count("_invented").alias("citations"), F.count_if("_invented").alias("invented"),
        F.max(F.coalesce((F.col("_not") == F.col("_negated")) & ~F.col("_invented"), F.lit(False))).alias("_agrees"))
    out = per.join(missing, CLAIM, "left").withColumn("unfounded", F.coalesce("unfounded", F.lit(0)))
    good = (F.col("citations") > 0) & (F.col("invented") == 0) & (F.col("unfounded") == 0) & F.col("_agrees")
    return out.select(*CLAIM, "citations", "invented", "unfounded", good.alias("supported"))


def security_counters(returned: DataFrame, decided: DataFrame, users: list[str], modes: list[str]) -> DataFrame:
    """user_id, mode, returned, disclosed, mark, permitted, passed, a row for each user and mode, answers or none.

    ``returned``: user_id, mode, question_id, item_id, rank, the real output.  ``decided``: user_id, item_id, allowed, by
    other means than the retrieval's own filter; an item without a decision is forbidden.  ``disclosed`` counts
    forbidden rows; a user who may read something but gets nothing fails as well.  ``mark`` is a digest of the rows.
    """
    spark = returned.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, users))).alias("user_id")).select("user_id", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    rows = returned.join(decided, ["user_id", "item_id"], "left")
    found = rows.groupBy("user_id", "mode").agg(
        F.count("*").alias("returned"), F.count_if(~F.coalesce("allowed", F.lit(False))).alias("disclosed"), F.sum(F.col("item_id") * F.col("rank")).alias("mark"))
    may = decided.groupBy("user_id").agg(F.count_if("allowed").alias("permitted"))
    out = every.join(found, ["user_id", "mode"], "left").join(may, "user_id", "left").na.fill(0, ["returned", "disclosed", "mark", "permitted"])
    return out.withColumn("passed", (F.col("disclosed") == 0) & ((F.col("returned") > 0) == (F.col("permitted") > 0)))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that count at ``now``: begun, not expired, not revoked since.  ``sessions``: started_at, expires_at, revoked_at."""
    revoked = F.coalesce(F.col("revoked_at") <= now, F.lit(False))
    return sessions.where((F.col("started_at") <= now) & (now < F.col("expires_at")) & ~revoked)
