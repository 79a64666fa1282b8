"""URL rules by a sort-merge range join, in DataFrame functions only.

Canonical keys turn prefixes into intervals: a host's labels in reverse, each followed by a zero byte,
so that a host and all its subdomains are one key range; and below a rule's host the path, so that all
paths with one prefix are.  An interval goes from its key to its key followed by 0xFF, a byte that UTF-8
never has.  Intervals nest or are disjoint.

Sweep: interval ends and points are range-partitioned and sorted together.  An opening end pushes its
rule on a stack and a closing end pops it: the running sum of pushes less pops is the depth, and the
stack's entry at a level is what was pushed there last.  Depths and entries are carried from one
partition to the next, a row a partition and level.  Two sweeps: the first, over hosts, gives each url
the stack of rule hosts that enclose its own; the second, over the paths below each of these hosts, the
top of the stack.  A url that repeats millions of times is split over partitions, as a row number is
part of the order.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; of the
fitting rules the longest (host and path together) wins, then the longer host, then block; rules
given twice count once; without a rule the verdict is ``default``; repeated pages are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, shuffle_width


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _escaped(host: Column) -> Column:
    """Without NUL, which parts labels in keys: urls may hold any character."""
    return F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))


def host_key(host: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.reverse(F.split(_escaped(host), r"\.")), "\x00"), F.lit("\x00")), "UTF-8")


def path_key(host: Column, path: Column) -> Column:
    return F.encode(F.concat(_escaped(host), F.lit("\x00"), path), "UTF-8")


def sweep(scratch: Scratch, intervals: DataFrame, points: DataFrame, name: str, whole: bool) -> DataFrame:
    """row, note, value: for each point the values of the intervals around it, all of them or the innermost only.

    ``intervals``: key, value, with distinct keys.  ``points``: key, row, note.
    """
    value, note = intervals.schema["value"].dataType, points.schema["note"].dataType
    nothing = [F.lit(None).cast("long").alias("row"), F.lit(None).cast(note).alias("note")]
    opening = intervals.select("key", F.lit(0).alias("kind"), F.lit(1).alias("up"), "value", *nothing)
    closing = intervals.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("up"), F.lit(None).cast(value).alias("value"), *nothing)
    asking = points.select("key", F.lit(1).alias("kind"), F.lit(0).alias("up"), F.lit(None).cast(value).alias("value"), "row", "note")
    order = ["key", "kind", "row"]
    events = opening.union(closing).union(asking).repartitionByRange(shuffle_width(scratch.spark), *order)
    events = scratch.write(events.withColumn("pid", F.spark_partition_id()), f"{name}_events")

    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    depths = events.groupBy("pid").agg(F.sum("up").alias("up")).select("pid", F.coalesce(F.sum("up").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    deep = events.join(depths, "pid").withColumn("depth", (F.col("before") + F.sum("up").over(upto)).cast("int"))
    levels = F.sequence(F.lit(1), F.col("depth")) if whole else F.array("depth")
    placed = deep.where("up = 1 or (kind = 1 and depth > 0)").withColumn("level", F.explode(F.when(F.col("up") == 1, F.array("depth")).otherwise(levels)))
    placed = scratch.write(placed.select("pid", "level", *order, "value", "note"), f"{name}_placed")

    last = placed.groupBy("pid", "level").agg(F.max_by("value", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    before = Window.partitionBy("level").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("pid", "level", F.last("last", ignorenulls=True).over(before).alias("carried"))
    here = F.last("value", ignorenulls=True).over(Window.partitionBy("pid", "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = placed.join(carried, ["pid", "level"]).withColumn("value", F.coalesce(here, F.col("carried")))
    return found.where("kind = 1").select("row", "note", "value")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page.  ``rules`` has host, path and verdict."""
    scratch = Scratch(pages.sparkSession)
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = rules.select("host").distinct().select(host_key(F.col("host")).alias("key"), F.col("host").alias("value"))
    paths = rules.select(path_key(F.col("host"), F.col("path")).alias("key"), F.struct(
        F.octet_length(F.concat("host", "path")).alias("length"), F.octet_length("host").alias("host_length"),
        F.col("verdict"), F.concat("host", "path").alias("rule")).alias("value"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = scratch.write(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    within = sweep(scratch, hosts, urls.where("host <> ''").select(host_key(F.col("host")).alias("key"), "row", F.col("path").alias("note")), "hosts", True)
    below = within.select(path_key(F.col("value"), F.col("note")).alias("key"), "row", F.lit(None).cast("string").alias("note"))
    hits = sweep(scratch, paths, below, "paths", False).groupBy("row").agg(F.max("value").alias("top"))
    out = urls.join(hits, "row", "left")
    return out.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
