"""Evidence packs: what is put before an answer, as intervals of the sources.

Each selected chunk brings the exceptions it is linked with, which are mandatory, the sections it refers to,
and its parent.  All are intervals of source text that the principal may read; where they overlap, the text
belongs to the first that needs it, so that no byte is packed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.staging import staged
from vellum.functions.tokenizers import WORDS, Tokenizer

SECTION = ["document_version_id", "section_ordinal"]
KINDS = ("evidence", "exception", "reference", "parent")


def authorized_intervals(chunks: DataFrame) -> DataFrame:
    """document_version_id, section_ordinal, start, stop: what readable chunks cover of each section.

    Chunks in a row are one interval, with the white space between them; where one is missing, as it may not be
    read, the interval ends, and none crosses a section's bounds.
    """
    place = Window.partitionBy(*SECTION).orderBy("chunk_ordinal")
    rows = chunks.select(*SECTION, "source_start", "source_end", (F.col("chunk_ordinal") - F.row_number().over(place)).alias("_island"))
    return rows.groupBy(*SECTION, "_island").agg(F.min("source_start").alias("start"), F.max("source_end").alias("stop")).drop("_island")


def exception_runs(chunks: DataFrame) -> DataFrame:
    """chunk_id, ordinals: the chunks behind it in its section that it is linked with, one exception after the other."""
    after = Window.partitionBy(*SECTION).orderBy("chunk_ordinal").rowsBetween(0, Window.unboundedFollowing)
    last = F.min(F.when(F.size("exception_refs") == 0, F.col("chunk_ordinal"))).over(after)
    rows = chunks.select("chunk_id", *SECTION, "chunk_ordinal", last.alias("last")).where("last > chunk_ordinal")
    return rows.select("chunk_id", *SECTION, F.sequence(F.col("chunk_ordinal") + 1, F.col("last")).alias("ordinals"))


def _bit(kind: str, rank: Column, most: int) -> Column:
    """The order of needs: evidence and its exceptions by rank, then references, then parents."""
    if kind in KINDS[:2]:
        return 2 * (rank - 1) + KINDS.index(kind)
    return KINDS.index(kind) * most + rank - 1


def needs(selected: DataFrame, every: DataFrame, readable: DataFrame, edges: DataFrame, by: list[str], most: int) -> DataFrame:
    """``by``, bit, missing, document_version_id, start, stop: the intervals that each selected chunk needs, of readable chunks only.

    Exceptions come from ``every`` chunk: one that may not be read is ``missing``, with no text of its own.
    """
    chosen = selected.select(*by, "chunk_id", "rank").join(readable.select("chunk_id", *SECTION, "spans"), "chunk_id")
    out, no = [], F.lit(False).alias("missing")

    def add(rows: DataFrame, kind: str) -> None:
        out.append(rows.select(*by, _bit(kind, F.col("rank"), most).cast("int").alias("bit"), "missing", "document_version_id", "start", "stop"))

    add(chosen.select(*by, "rank", no, "document_version_id", F.explode("spans").alias("s")).select("*", F.col("s.start").alias("start"), F.col("s.end").alias("stop")), "evidence")
    linked = chosen.select(*by, "rank", "chunk_id").join(exception_runs(every), "chunk_id").select(*by, "rank", *SECTION, F.explode("ordinals").alias("chunk_ordinal"))
    own = readable.select(*SECTION, "chunk_ordinal", "spans")
    linked = linked.join(own, [*SECTION, "chunk_ordinal"], "left")
    add(linked.select(*by, "rank", F.col("spans").isNull().alias("missing"), "document_version_id", F.explode_outer("spans").alias("s")).select("*", F.col("s.start").alias("start"), F.col("s.end").alias("stop")), "exception")
    open_ = authorized_intervals(readable)
    ends = chosen.select(*by, "rank", *SECTION).join(edges.select(*SECTION, "dst_document", "dst_section").distinct(), SECTION)
    ends = ends.select(*by, "rank", F.col("dst_document").alias("document_version_id"), F.col("dst_section").alias("section_ordinal")).distinct()
    add(ends.join(open_, SECTION).withColumn("missing", F.lit(False)), "reference")
    add(chosen.select(*by, "rank", "document_version_id").distinct().join(open_, "document_version_id").withColumn("missing", F.lit(False)), "parent")
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def _owned(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, document_version_id, bit, start, stop: the text between two bounds, given to the first of the needs that cover it.

    Intervals of one need are merged first; then each need is a bit, which bounds switch on and off, and the
    running sum of these is the set of needs that cover the text behind a bound.
    """
    group = [*by, "document_version_id"]
    order = Window.partitionBy(*group, "bit").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.where("start < stop").withColumn("new", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*group, "bit", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    mask = F.expr("shiftleft(1L, bit)")
    bounds = merged.select(*group, F.explode(F.array(F.struct(F.col("start").alias("at"), mask.alias("on")), F.struct(F.col("stop").alias("at"), (-mask).alias("on")))).alias("e"))
    bounds = bounds.groupBy(*group, F.col("e.at").alias("start")).agg(F.sum("e.on").alias("on"))
    line = Window.partitionBy(*group).orderBy("start")
    spans = bounds.select(*group, "start", F.lead("start").over(line).alias("stop"), F.sum("on").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("on"))
    return spans.where("on <> 0").withColumn("bit", F.log2(F.expr("on & -on").cast("double")).cast("int")).drop("on")


def pack(selected: DataFrame, every: DataFrame, readable: DataFrame, edges: DataFrame, texts: DataFrame, by: list[str], budget: int = 3500, most: int = 5, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """``by``, status, kind, rank, document_version_id, start, stop, tokens, used, text: the packed intervals in the order of needs.

    ``selected``: ``by``, chunk_id, rank (1 to ``most``).  ``every``: all chunks, ``readable``: those the principal may
    read, ``edges``: visible ones, ``texts``: document_version_id, text.  Needs are taken whole, in order, as long as
    the budget lasts.  Where a chunk fits but its exceptions don't, or may not be read, or where nothing fits, the
    status is ``insufficient_evidence`` and the one row has no interval; else ``answered``.
    """
    if not 1 <= most <= 15:
        raise ValueError("1 to 15 chunks can be packed")
    # What is used more than once is small beside the chunks, and written.
    selected = staged(selected.where(F.col("rank") <= most).select(*by, "chunk_id", "rank"))
    rows = staged(needs(selected, every, readable, edges, by, most))
    missing = rows.groupBy(*by).agg(F.min(F.when(F.col("missing"), F.col("bit"))).alias("_missing"))
    owned = _owned(rows.where("not missing"), by)
    piece = F.struct("bit", "start", "stop")
    held = owned.groupBy(*by, "document_version_id").agg(F.collect_list(piece).alias("pieces")).join(texts.select("document_version_id", F.col("text").alias("_text")), "document_version_id")

    def cut(p: Column) -> Column:
        shown = F.substring("_text", p["start"] + 1, p["stop"] - p["start"])
        return F.struct(p["bit"].alias("bit"), p["start"].alias("start"), p["stop"].alias("stop"), shown.alias("text"), tokenizer.count(shown).cast("int").alias("tokens"))

    parts = staged(held.select(*by, "document_version_id", F.inline(F.transform("pieces", cut))).where("tokens > 0"))
    # A need's cost is what it adds; one that adds nothing still counts as met.
    costs = rows.select(*by, "bit").distinct().join(parts.groupBy(*by, "bit").agg(F.sum("tokens").alias("cost")), [*by, "bit"], "left")
    upto = Window.partitionBy(*by).orderBy("bit").rowsBetween(Window.unboundedPreceding, 0)
    costs = costs.select(*by, "bit", F.sum(F.coalesce("cost", F.lit(0))).over(upto).alias("used"))
    stops = costs.groupBy(*by).agg(F.min(F.when(F.col("used") > budget, F.col("bit"))).alias("_over")).join(missing, by)
    stop = F.least("_over", "_missing")  # the first need that can't be met; nulls are left out
    bad = F.coalesce((stop == 0) | ((stop < 2 * most) & (stop % 2 == 1)), F.lit(False))
    stops = stops.select(*by, stop.alias("_stop"), F.when(bad, "insufficient_evidence").otherwise("answered").alias("status"))
    good = stops.where("status = 'answered'").join(parts, by).join(costs, [*by, "bit"]).where("_stop is null or bit < _stop")
    early = F.col("bit") < 2 * most
    kind = F.when(early & (F.col("bit") % 2 == 0), KINDS[0]).when(early, KINDS[1]).when(F.col("bit") < 3 * most, KINDS[2]).otherwise(KINDS[3])
    rank = F.when(early, F.floor(F.col("bit") / 2)).otherwise(F.col("bit") % most) + 1
    columns = [*by, "status", kind.alias("kind"), rank.cast("int").alias("rank"), "document_version_id", "start", "stop", "tokens", "used", "text"]
    none = stops.where("status <> 'answered'").select(*by, "status", *[F.lit(None).cast(good.select(*columns).schema[c].dataType).alias(c) for c in ("kind", "rank", "document_version_id", "start", "stop", "tokens", "used", "text")])
    return good.select(*columns).unionByName(none)
