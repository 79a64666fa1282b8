"""Requests before and while they run: validation, budgets of runs, and access decided again before an answer goes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.running import running

# What a request may say, its modes, and the limits of a run.
FIELDS = {"question": "STRING", "corpora": "ARRAY<STRING>", "mode": "STRING", "as_of": "STRING", "top_k": "BIGINT"}
MODES = ("vector", "hybrid", "hybrid_rerank", "graph_rerank", "agentic")
MOST_QUESTION = 2000
CALLS, DEPTH, SUBAGENTS, SECONDS = 6, 1, 2, 120


def refusals(request: Column) -> Column:
    """Why a request (a JSON text) is refused, in a fixed order; empty for a good one.

    Fields that aren't known are refused by name, so that no role, tenant or permission can be slipped in;
    values must have their types, a question 1 to 2,000 characters, the mode must be known and the date be one.
    """
    parsed = F.try_parse_json(request)
    keys = F.json_object_keys(request)

    def typed(name: str, kind: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == kind

    def text(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "string")

    given = {n: F.array_contains(keys, n) for n in FIELDS}
    wrong = [F.when(given[n] & ~F.coalesce(typed(n, kind), F.lit(False)), F.lit(f"type: {n}")) for n, kind in FIELDS.items()]
    unknown = F.transform(F.array_sort(F.filter(keys, lambda k: ~k.isin(*FIELDS))), lambda k: F.concat(F.lit("unknown field: "), k))
    is_text = lambda n: given[n] & F.coalesce(typed(n, FIELDS[n]), F.lit(False))
    others = [
        F.when(~given["question"], F.lit("missing: question")),
        F.when(is_text("question") & ~F.length(F.trim(text("question"))).between(1, MOST_QUESTION), F.lit("length: question")),
        F.when(is_text("mode") & ~text("mode").isin(*MODES), F.lit("mode")),
        F.when(is_text("as_of") & F.try_to_date(text("as_of"), "yyyy-MM-dd").isNull(), F.lit("date: as_of"))]
    reasons = F.concat(unknown, F.filter(F.array(*wrong, *others), lambda x: x.isNotNull()))
    return F.when(parsed.isNull() | keys.isNull(), F.array(F.lit("not an object"))).otherwise(reasons)


def run_budgets(calls: DataFrame) -> DataFrame:
    """run, calls, over_calls, over_depth, over_subagents, over_seconds, allowed: for each run the first call that breaks each limit.

    ``calls``: run, call, at (timestamp), agent (null for the run itself), depth.  Limits hold for a run with all its
    subagents.  ``allowed`` counts the calls before the first that breaks any.  Runs are swept in order, and
    one of any length is spread over tasks.
    """
    first = calls.where("agent is not null").groupBy("run", "agent").agg(F.min(F.struct("at", "call")).alias("_first"))
    first = first.select(F.col("run").alias("_run"), F.col("agent").alias("_agent"), "_first")
    begun = calls.groupBy("run").agg(F.min("at").alias("_begun"))
    rows = calls.join(first, (F.col("run") == F.col("_run")) & (F.col("agent") == F.col("_agent")), "left").join(begun, "run")
    rows = rows.select("run", "call", "at", "depth", "_begun", F.lit(1).cast("long").alias("_one"), F.coalesce((F.col("_first") == F.struct("at", "call")).cast("long"), F.lit(0)).alias("_new"))
    swept = running(rows, ["run"], ["at", "call"], {"_calls": "_one", "_agents": "_new"})
    broken = {
        "over_calls": F.col("_calls") > CALLS, "over_depth": F.col("depth") > DEPTH, "over_subagents": F.col("_agents") > SUBAGENTS,
        "over_seconds": F.col("at").cast("double") - F.col("_begun").cast("double") > SECONDS}
    any_ = F.lit(False)
    for b in broken.values():
        any_ = any_ | b
    out = swept.groupBy("run").agg(
        F.count("*").alias("calls"), *[F.min_by("call", F.when(b, F.struct("at", "call"))).alias(n) for n, b in broken.items()],
        (F.coalesce(F.min(F.when(any_, F.col("_calls"))), F.count("*") + 1) - 1).alias("allowed"))
    return out


def recheck(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """request, user_id, revision_before, revision_after, allowed_before, allowed_after, status of each request.

    ``requests``: request, user_id, started, returned.  ``changes``: user_id, at, change (orders changes of one time),
    allowed.  A user's revision is the number of changes so far, the entitlement that of the last one, none
    before the first.  A request that lost its entitlement on the way returns nothing, one whose revision changed is
    decided again.
    """
    kind = changes.schema["change"].dataType
    mark = F.struct("at", "change", "allowed")
    points = changes.select("user_id", "at", F.lit(0).alias("_kind"), "change", F.lit(1).cast("long").alias("_one"), mark.alias("_mark"), F.lit(None).cast(requests.schema["request"].dataType).alias("request"), F.lit(0).alias("_end"))
    none = F.lit(None).cast(points.schema["_mark"].dataType)
    for end, column in enumerate(("started", "returned")):
        points = points.unionByName(requests.select("user_id", F.col(column).alias("at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("change"), F.lit(0).cast("long").alias("_one"), none.alias("_mark"), "request", F.lit(end).alias("_end")))
    swept = running(points, ["user_id"], ["at", "_kind", "change", "request", "_end"], {"revision": "_one"}, {"last": "_mark"}).where("_kind = 1")
    pick = lambda end, c: F.max(F.when(F.col("_end") == end, c))
    allowed = F.coalesce(F.col("last.allowed"), F.lit(False))
    out = swept.groupBy("request", "user_id").agg(
        pick(0, F.col("revision")).alias("revision_before"), pick(1, F.col("revision")).alias("revision_after"), pick(0, allowed).alias("allowed_before"), pick(1, allowed).alias("allowed_after"))
    status = F.when(~F.col("allowed_before"), "refused").when(~F.col("allowed_after"), "withheld").when(F.col("revision_before") != F.col("revision_after"), "decided_again").otherwise("answered")
    return out.withColumn("status", status)
