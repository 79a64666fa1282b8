"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.running import running_sum


def recall(retrieved: Column, acceptable: Column) -> Column:
    """The best covered share over several acceptable evidence sets; null (not applicable) without any."""
    got = F.array_distinct(retrieved)
    share = F.transform(acceptable, lambda s: F.size(F.array_intersect(got, s)) / F.size(F.array_distinct(s)))
    return F.when(F.size(acceptable) > 0, F.array_max(share))


def clause_recall(lists: DataFrame, clauses: DataFrame, by: list[str], ks: tuple[int, ...] = (5, 20)) -> DataFrame:
    """``by``, question_id, clauses, recall_5, recall_20: the share of a question's labelled clauses that its first items hold.

    ``lists``: ``by``, question_id, item_id, rank.  ``clauses``: what of ``by`` it has, question_id, item_id, clause: those
    that the principal may read.  A clause counts once, in however many items it is found.  Questions without
    a readable clause don't apply and have no row; one whose list is empty has recall 0.
    """
    own = [c for c in by if c in clauses.columns]
    every = clauses.groupBy(*own, "question_id").agg(F.count_distinct("clause").alias("clauses"))
    modes = lists.select(*by).distinct()
    cases = modes.join(every, own) if own else modes.crossJoin(F.broadcast(every))
    met = lists.join(clauses, [*own, "question_id", "item_id"]).groupBy(*by, "question_id").agg(
        *[F.count_distinct(F.when(F.col("rank") <= k, F.col("clause"))).alias(f"_{k}") for k in ks])
    out = cases.join(met, [*by, "question_id"], "left")
    return out.select(*by, "question_id", "clauses", *[(F.coalesce(f"_{k}", F.lit(0)) / F.col("clauses")).alias(f"recall_{k}") for k in ks])


def case_passes(status: Column, expected: Column, required: Column, prohibited: Column, answer: Column) -> Column:
    """The right status, every required fact, no prohibited one."""
    all_in = F.forall(required, lambda f: F.contains(answer, f))
    none_in = ~F.exists(prohibited, lambda f: F.contains(answer, f))
    return F.coalesce((status == expected) & all_in & none_in, F.lit(False))


def percentiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Runs and a column a share (p50, p95) for each group, by linear interpolation between exact ranks.

    Values are counted once each and ranked by ranges, so no task holds a group.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_sum(sizes, by, [value], "_n", "_upto")
    runs = df.groupBy(*by).agg(F.count(value).alias("runs"))
    runs = runs.select(*[F.col(c).alias(f"_of_{c}") for c in by], "runs")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))

    def at(rank: Column) -> Column:  # the value that has this rank, counted from 0
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col(value)))

    columns = []
    for share in shares:
        place = (F.col("runs") - 1) * F.lit(share)
        low, high = at(F.floor(place)), at(F.ceil(place))
        columns.append(F.round(low + (high - low) * F.max(place - F.floor(place)), 6).alias(f"p{round(share * 100)}"))
    return runs.join(ranked, same, "left").groupBy(*[F.col(f"_of_{c}").alias(c) for c in by]).agg(F.max("runs").alias("runs"), *columns)


def macro(cases: DataFrame, first: str, second: str, metric: str) -> DataFrame:
    """The metric's mean over cases by both columns, by the first, and over all; null marks "all"."""
    rows = cases.groupingSets([[first, second], [first], []], first, second)
    return rows.agg(F.count(metric).alias("cases"), F.round(F.avg(metric), 6).alias("mean"))


def status(matches: Column, permitted: Column, conflicting: Column, clear: Column) -> Column:
    """The answer's status from evidence counts; restricted-only evidence looks like none at all."""
    return (
        F.when(~clear, "needs_clarification")
        .when(F.coalesce(permitted, F.lit(0)) == 0, "insufficient_evidence")
        .when(conflicting > 0, "conflicting_sources")
        .when(matches > 0, "answered")
        .otherwise("unavailable")
    )


def lost_at(clean: DataFrame, damaged: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """``by``, lost_at: for the evidence that passes every stage of the clean run, the first stage of the damaged run that it doesn't, or ``kept``.

    Both tables have a row for each candidate, ``by`` and a boolean a stage; a candidate without a row passes none.
    """
    whole = clean.where(" and ".join(stages)).select(*by)
    other = damaged.select(*by, *[F.col(s).alias(f"_{s}") for s in stages])
    first = F.coalesce(*[F.when(~F.coalesce(f"_{s}", F.lit(False)), s) for s in stages], F.lit("kept"))
    return whole.join(other, by, "left").select(*by, first.alias("lost_at"))
