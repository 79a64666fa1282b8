"""Merkle manifest of a dataset, with coordinate lookup proofs.

A leaf is the hash of a row's fields.  Within a group (here a language) leaves are ordered; while several
nodes remain, every ``FANOUT`` consecutive ones become their hash.  What remains is the group's subroot,
and subroots, in the order of their groups, make the root in the same way.  H is SHA-256 in lowercase hex
of the concatenated inputs.

Building: leaves are hashed where rows are read, so that texts are never shuffled, and numbered by
distributed prefix sums, so that a group of any size spreads.  Each level is written as a table of runs:
the digests of up to eight siblings in order, and the hash they become.  That is the node table.

Proving: the position of a leaf and the size of its group give the coordinates (level, run) of all its
siblings.  The eight leaves of a run share those above their own level, so a run explodes them once for
its leaves; they are joined with the node table, ordered by level, and folded leaf by leaf.  High levels,
which every leaf needs, are small: as many as take less than ``MOST_BYTES`` are broadcast, and a run below
them is asked for by its own descendants only.

Defined cases: a null field is ``-``; null groups are one group, the first; a null key comes first and is
never chosen for tampering; rows with one key are ordered by their leaves, equal rows in either order; a
lone leaf is its subroot and a lone subroot the root; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, prefix_sums

FANOUT = 8
#: Bytes of the upper levels that go to every executor.
MOST_BYTES = 32 << 20
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree over subroots are counted from here.
_TOP = 100


def _h(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of the fields' values, each with its length in bytes before it."""
    shown = [c.cast("string") for c in fields]
    return _h(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]))


def tampered_key(key: Column, each: int = 3) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % each == 0, F.lit(False))


def _levels(size: Column) -> Column:
    """How often so many nodes are hashed into fewer, up to one."""
    steps = F.sequence(F.lit(0), F.lit(20))
    return F.size(F.filter(steps, lambda i: F.pow(F.lit(float(FANOUT)), i) < size))


def _runs(nodes: DataFrame, most: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """A written table a level: tree, run, digests, digest, size (of this level).  ``nodes``: tree, idx, digest, size."""
    tables = []
    while most > 1:
        both = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        run = nodes.where("size > 1").groupBy("tree", F.expr(f"idx div {FANOUT}").alias("run")).agg(both.alias("n"), F.first("size").alias("size"))
        run = run.select("tree", "run", F.col("n.digest").alias("digests"), _h(F.array_join("n.digest", "")).alias("digest"), "size")
        tables.append(scratch.write(run, f"{name}{len(tables)}"))
        nodes, most = _above(tables[-1]), -(-most // FANOUT)
    return tables


def _above(table: DataFrame) -> DataFrame:
    return table.select("tree", F.col("run").alias("idx"), "digest", F.ceil(F.col("size") / FANOUT).alias("size"))


def _last(lone: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """tree, digest of the node that remains of each tree; ``lone``: nodes of trees of one node."""
    done = [_above(t).where("size = 1").select("tree", "digest") for t in tables]
    return reduce(DataFrame.unionByName, done, lone.select("tree", "digest"))


class Manifest:
    """The tree of a table; all of it lies in written tables.

    ``changed``, if given, is the leaf a row has after tampering (null: untouched); it takes no part in the tree.
    """

    def __init__(self, docs: DataFrame, fields: list[str] | None = None, group: str = "lang", key: str = "doc_id", changed: Column | None = None):
        self.scratch = scratch = Scratch(docs.sparkSession)
        # Null first, then bytewise: the order of groups is that of this string.
        tree = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n")).alias("tree")
        changed = (F.lit(None) if changed is None else changed).cast("string").alias("changed")
        rows = docs.select(tree, F.col(key).alias("key"), leaf([F.col(c) for c in fields or FIELDS]).alias("leaf"), changed, F.lit(1).alias("one"))
        placed = prefix_sums(scratch, rows, ["tree"], [F.col("key").asc_nulls_first(), F.col("leaf")], "one", "idx", "leaves")
        rows = scratch.spark.read.schema("tree string").parquet(scratch.paths["leaves"])
        sizes = scratch.write(rows.groupBy("tree").agg(F.count("*").alias("size")), "sizes")
        most = sizes.agg(F.max("size")).first()[0] or 0
        # Runs of leaves; they carry the rows themselves.
        run = placed.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "key", "leaf", "changed"))).alias("rows"))
        self.leaves = scratch.write(run.select("tree", "run", "rows", _h(F.array_join("rows.leaf", "")).alias("digest")), "runs")
        ends = self.leaves.join(sizes, "tree")
        first = ends.select("tree", F.col("run").alias("idx"), F.when(F.col("size") > 1, F.col("digest")).otherwise(F.col("rows")[0]["leaf"]).alias("digest"),
                            F.ceil(F.col("size") / FANOUT).alias("size"))
        self.levels = _runs(first, -(-most // FANOUT), scratch, "level")
        subroots = _last(first.where("size = 1"), self.levels).withColumn("one", F.lit(1))
        ordered = prefix_sums(scratch, subroots, [], [F.col("tree")], "one", "idx", "subroots")
        self.trees = scratch.write(ordered.join(sizes, "tree").select("tree", F.col("digest").alias("subroot"), "idx", "size"), "trees")
        self.groups = self.trees.count()
        top = self.trees.select(F.lit("").alias("tree"), "idx", F.col("subroot").alias("digest"), F.lit(self.groups).cast("long").alias("size"))
        self.top = _runs(top, self.groups, scratch, "top")
        self.root = _last(top.where("size = 1"), self.top).select(F.col("digest").alias("root"))

    def node_table(self) -> list[tuple[int, DataFrame]]:
        """(level, tree, run, digests) for each level above the leaves, the levels over subroots from ``_TOP`` on."""
        every = [(i + 1, t) for i, t in enumerate(self.levels)] + [(_TOP + i, t) for i, t in enumerate(self.top)]
        return [(i, t.select("tree", F.lit(i).alias("level"), "run", "digests")) for i, t in every]

    def proofs(self) -> DataFrame:
        """key, leaf, changed, subroot, root, path: for each level its siblings with the own place among them, from the leaf up."""
        runs = self.leaves.join(self.trees, "tree").select(
            "tree", "run", "rows", "subroot", "size", F.col("idx").alias("_s"), _levels(F.col("size")).alias("_own"), _levels(F.lit(float(self.groups))).alias("_over"))

        def power(i: Column) -> Column:
            return F.pow(F.lit(float(FANOUT)), i).cast("long")

        def at(tree: Column, level: Column, node: Column) -> Column:
            """The coordinates of a node's siblings: the run they stand in, and the node's place in it."""
            return F.struct(tree.alias("tree"), level.cast("int").alias("level"), F.floor(node / FANOUT).cast("long").alias("run"), (node % FANOUT).cast("int").alias("place"))

        def node(x: Column, i: Column) -> Column:
            """The node above ``x``, ``i`` levels up."""
            return F.floor(x / power(i)).cast("long")

        none = F.array().cast("array<int>")
        own = F.when(F.col("_own") > 1, F.sequence(F.lit(1), F.col("_own") - 1)).otherwise(none)
        over = F.when(F.col("_over") > 0, F.sequence(F.lit(0), F.col("_over") - 1)).otherwise(none)
        asked = runs.select("tree", "run", F.explode(F.concat(
            F.transform(own, lambda i: at(F.col("tree"), i, node(F.col("run"), i - 1))),
            F.transform(over, lambda i: at(F.lit(""), i + _TOP, node(F.col("_s"), i)))).alias("c")).alias("c"))
        asked = asked.select("tree", "run", F.col("c.tree").alias("_tree"), F.col("c.level").alias("level"), F.col("c.run").alias("_run"), F.col("c.place").alias("place"))
        found = [
            asked.join(table, (F.col("_tree") == F.col("n.tree")) & (asked["level"] == F.col("n.level")) & (F.col("_run") == F.col("n.run")))
            .select(asked["tree"], asked["run"], F.struct(asked["level"].alias("level"), "place", "n.digests").alias("step"))
            for asked, table in self._lookups(asked)]
        kind = "struct<level:int,place:int,digests:array<string>>"
        gathered = reduce(DataFrame.unionByName, [x.withColumn("rows", F.lit(None).cast(runs.schema["rows"].dataType)).withColumn("rest", F.lit(None).cast("struct<subroot:string,size:bigint>")) for x in found],
                          runs.select("tree", "run", F.lit(None).cast(kind).alias("step"), "rows", F.struct("subroot", "size").alias("rest")))
        paths = gathered.groupBy("tree", "run").agg(
            F.array_sort(F.collect_list("step")).alias("path"), F.first("rows", ignorenulls=True).alias("rows"), F.first("rest", ignorenulls=True).alias("rest"))
        each = paths.select("path", "rest", F.col("rows.leaf").alias("_leaves"), F.explode("rows").alias("r"))
        own_step = F.struct(F.lit(0).alias("level"), (F.col("r.idx") % FANOUT).cast("int").alias("place"), F.col("_leaves").alias("digests"))
        path = F.concat(F.when(F.col("rest.size") > 1, F.array(own_step)).otherwise(F.array().cast(f"array<{kind}>")), F.col("path"))
        rows = each.select(F.col("r.key").alias("key"), F.col("r.leaf").alias("leaf"), F.col("r.changed").alias("changed"), F.col("rest.subroot").alias("subroot"), path.alias("path"))
        return rows.crossJoin(F.broadcast(self.root))  # one row

    def _lookups(self, asked: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        """The coordinates in two parts, each with its part of the node table: the lower levels, and the upper ones within the bound."""
        upper, lower, held = [], [], 0
        for level, table in reversed(self.node_table()):
            if not lower:
                held += table.agg(F.sum(F.octet_length("tree") + 80 + F.size("digests") * 72)).first()[0] or 0
            (upper if not lower and held <= MOST_BYTES else lower).append((level, table))
        out = []
        for part, hint in ((upper, F.broadcast), (lower, lambda t: t)):
            if part:
                out.append((asked.where(F.col("level").isin([i for i, _ in part])), hint(reduce(DataFrame.unionByName, [t for _, t in part])).alias("n")))
        return out


def _beside(p: Column, middle: Column | None) -> Column:
    """A run's digests in order, with another one in the own place, or without it."""
    before, after = F.slice(p["digests"], F.lit(1), p["place"]), F.slice(p["digests"], p["place"] + 2, F.lit(FANOUT))
    return F.concat(F.array_join(before, ""), *([] if middle is None else [middle]), F.array_join(after, ""))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf gives beside the siblings of its path."""
    return F.aggregate(path, start, lambda a, p: _h(_beside(p, a)))


def proof_digest(path: Column) -> Column:
    return _h(F.array_join(F.transform(path, lambda p: _beside(p, None)), ""))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's proof, checked after a third of the rows was tampered with."""
    tampered = [F.translate(F.col(c), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    proved = Manifest(docs, changed=F.when(tampered_key(F.col("doc_id")), leaf(tampered))).proofs()
    out = proved.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
