"""One-hop graph expansion and reporting trees over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.running import running
from vellum.functions.staging import staged


def one_hop(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, types: list[str], most: int = 10, permitted: Column | None = None) -> DataFrame:
    """seed, neighbour, type, position: validated edges of allowed types from seeds to permitted nodes.

    ``seeds``: seed; ``edges``: src, dst, type, validation_status; ``nodes``: id and what ``permitted``
    reads.  Both ends must be permitted; at most ``most`` additions a seed, by type and neighbour.
    """
    usable = edges.where(F.col("type").isin(*types) & (F.col("validation_status") == "validated"))
    open_nodes = nodes.where(permitted) if permitted is not None else nodes
    ids = open_nodes.select("id")
    start = seeds.join(ids, seeds["seed"] == ids["id"], "left_semi")
    out = start.join(usable, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("neighbour"), "type")
    out = out.join(ids, F.col("neighbour") == F.col("id"), "left_semi").where("neighbour <> seed").distinct()
    order = Window.partitionBy("seed").orderBy("type", "neighbour")
    return out.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def permitted_edges(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """src, dst: validated edges of the allowed types with both ends in ``nodes`` (id)."""
    usable = edges.where(F.col("type").isin(*types) & (F.col("validation_status") == "validated")).select("src", "dst")
    ends = nodes.select("id")
    return usable.join(ends, F.col("src") == F.col("id"), "left_semi").join(ends, F.col("dst") == F.col("id"), "left_semi").distinct()


def tree_labels(people: DataFrame) -> DataFrame:
    """user_id, depth, entry, exit: everyone's place in the reporting tree; all below a manager have entries in (entry, exit].

    ``people``: user_id, manager_id (null, or nobody in the table, at the top).  Paths to the top are found by
    doubling, in as many rounds as the logarithm of the depth; their order is the order of entries.  People
    whose managers go round in a circle have no place and are left out.
    """
    own = people.select(F.col("user_id").cast("string").alias("user_id"), F.col("manager_id").cast("string").alias("up")).dropDuplicates(["user_id"])
    known = own.select(F.col("user_id").alias("up"), F.lit(True).alias("_known"))
    state = own.join(known, "up", "left").select("user_id", F.when(F.col("_known"), F.col("up")).alias("up"), F.array("user_id").alias("path"))
    state = staged(state)
    most = max(1, state.count()).bit_length() + 1
    for _ in range(most):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col("user_id").alias("_u"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = state.join(above, F.col("up") == F.col("_u"), "left")
        # A path that meets itself has gone round a circle; so has one whose ancestor has.
        straight = F.col("_u").isNotNull() & ~F.coalesce(F.arrays_overlap("path", "_path"), F.lit(False))
        state = staged(joined.where(F.col("up").isNull() | straight).select("user_id", F.col("_up").alias("up"), F.when(F.col("_u").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")))
    placed = state.where("up is null").withColumn("_one", F.lit(1).cast("long"))
    sizes = placed.select(F.explode("path").alias("user_id")).groupBy("user_id").agg(F.count("*").alias("_size"))
    entries = running(placed.drop("up"), [], ["path"], {"entry": "_one"})
    return entries.join(sizes, "user_id").select("user_id", (F.size("path") - 1).alias("depth"), "entry", (F.col("entry") + F.col("_size") - 1).alias("exit"))


def below(labels: DataFrame, root: str) -> DataFrame:
    """user_id, depth of everyone below ``root`` (itself at 0): one range of entries."""
    top = labels.where(F.col("user_id") == root).select(F.col("entry").alias("_lo"), F.col("exit").alias("_hi"), F.col("depth").alias("_d")).limit(1)
    return labels.join(F.broadcast(top), F.col("entry").between(F.col("_lo"), F.col("_hi"))).select("user_id", (F.col("depth") - F.col("_d")).alias("depth"))


def sums_below(labels: DataFrame, amounts: DataFrame, value: str) -> DataFrame:
    """user_id, people, ``value``: for everyone, how many are below (without themselves), and what their rows of ``amounts`` add up to.

    An interval's total is a difference of two running totals, so that nobody's subtree is ever listed.
    """
    each = labels.join(amounts.groupBy("user_id").agg(F.sum(value).alias("_v")), "user_id", "left").withColumn("_v", F.coalesce("_v", F.lit(0)))
    upto = staged(running(each, [], ["entry"], {"_upto": "_v"}))
    ends = upto.select(F.col("entry").alias("exit"), F.col("_upto").alias("_end"))
    return upto.join(ends, "exit").select("user_id", (F.col("exit") - F.col("entry")).alias("people"), (F.col("_end") - F.col("_upto")).alias(value))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids that a uniqueness constraint forbids: (label, id) seen more than once."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")
