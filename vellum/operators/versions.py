"""Versions with effective dates, snapshots, and index generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.running import running


def as_of(versions: DataFrame, policy: str, effective_from: str, version: str, date: Column) -> DataFrame:
    """For each policy the version in force at ``date``: the last that started by then (ties: the largest)."""
    started = versions.where(F.col(effective_from) <= date)
    return started.groupBy(policy).agg(F.max(F.struct(effective_from, version)).alias("v")).select(policy, f"v.{version}", f"v.{effective_from}")


def in_force(effective_from: Column, effective_to: Column, date: Column, selected: Column | None = None) -> Column:
    """Whether an interval covers the date; unknown starts count only if the manifest selected the version."""
    known = (effective_from <= date) & (date <= F.coalesce(effective_to, F.to_date(F.lit("9999-12-31"))))
    return F.coalesce(known, selected if selected is not None else F.lit(False), F.lit(False))


def chain(versions: DataFrame, policy: str, order: list[str], version: str) -> DataFrame:
    """Adds ``supersedes`` and ``superseded_by``, the versions before and after in their policy."""
    by = Window.partitionBy(policy).orderBy(*order)
    return versions.withColumn("supersedes", F.lag(version).over(by)).withColumn("superseded_by", F.lead(version).over(by))


def conflicts(active: DataFrame, policy: str, version: str, value: str) -> DataFrame:
    """Pairs of active versions of one policy that disagree in ``value``: policy, first, second."""
    a, b = active.alias("a"), active.alias("b")
    pair = (F.col(f"a.{policy}") == F.col(f"b.{policy}")) & (F.col(f"a.{version}") < F.col(f"b.{version}")) & (F.col(f"a.{value}") != F.col(f"b.{value}"))
    return a.join(b, pair).select(F.col(f"a.{policy}").alias(policy), F.col(f"a.{version}").alias("first"), F.col(f"b.{version}").alias("second"))


def conflict_groups(active: DataFrame, policy: str, version: str, start: str, stop: str, value: str) -> DataFrame:
    """``policy``, ``start``, ``stop``, versions, values: runs of active versions whose intervals overlap and that disagree in ``value``.

    One sweep in the order of starts: a version belongs to the run before it if it starts by the latest stop so far.
    An interval without a stop never ends.  No pairs are made, and no policy is held by one task.
    """
    far = F.lit("9999-12-31").cast(active.schema[stop].dataType)
    rows = active.select(policy, version, start, F.coalesce(F.col(stop), far).alias(stop), value)
    order = [start, version]
    swept = running(rows, [policy], order, maxima={"_reach": stop}, current=False)
    swept = swept.withColumn("_new", F.when(F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)), 1).otherwise(0))
    groups = running(swept.drop("_reach"), [policy], order, {"_run": "_new"}).groupBy(policy, "_run")
    out = groups.agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("versions"), F.count_distinct(value).alias("values"))
    return out.where("values > 1").drop("_run")


def difference(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, removed, changed or same, between two snapshots."""
    b, a = before.select(key, F.col(digest).alias("_b")), after.select(key, F.col(digest).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def compare(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sections of two versions side by side: first, second, heading, section_ordinal, change.

    ``sections`` (readable ones): document_version_id, heading, body; equal headings are told apart by
    their order.  ``pairs``: first, second.  Only a digest of a body is compared.
    """
    place = F.row_number().over(Window.partitionBy("document_version_id", "heading").orderBy("section_ordinal")).alias("place")
    parts = sections.select("document_version_id", "heading", place, F.sha2("body", 256).alias("digest"))
    old = pairs.join(parts, F.col("first") == F.col("document_version_id")).select("first", "second", "heading", "place", F.col("digest").alias("a"))
    new = pairs.join(parts, F.col("second") == F.col("document_version_id")).select("first", "second", "heading", "place", F.col("digest").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return old.join(new, ["first", "second", "heading", "place"], "full").select("first", "second", "heading", "place", change.alias("change"))
