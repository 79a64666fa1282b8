"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as ``assistant``
and all others as named users; the loss mask covers the assistant's text and its end marker.  System
turns stay system turns and are never a participant.

A rendered dialogue is a sequence of segments, one a turn, each with its character offsets in the
whole: ``rendered`` concatenated by ``segment`` is the dialogue, and [mask_start, mask_end) the part
to train on.  No conversation is gathered into one row or task: offsets come from a distributed
prefix sum, so one conversation may hold a third of all rows.

Defined cases: a null or empty role is the speaker ``unknown``; a null text is empty; a null conv_id
is a conversation of its own; ties and repeated turns keep the order (turn, role, text); markers
inside a text are broken up (``<|`` becomes ``< |``), so that they can't end a turn; names are quoted,
with quotes, backslashes, line ends and markers escaped, so that a name can't end a turn either and
different speakers have different names; a conversation of system turns only has no participant,
hence no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, prefix_sums

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def quoted(name: Column) -> Column:
    """The name in quotes, on one line, without markers; no two names become equal."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("<|", "<\\|")):
        name = F.replace(name, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), name, F.lit('"'))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, segment, turn, speaker, role, rendered, seg_start, seg_end, mask_start, mask_end, trained."""
    scratch = Scratch(turns.sparkSession)
    clean = turns.select(
        "conv_id", "turn",
        F.when(F.coalesce(F.trim("role"), F.lit("")) == "", "unknown").otherwise(F.trim("role")).alias("speaker"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("_body"))
    people = (
        clean.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    )
    people = people.withColumnRenamed("conv_id", "_conv")
    pairs = clean.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise(
        F.concat(F.lit("user name="), quoted(F.col("speaker"))))
    seg = pairs.select(
        "conv_id", "perspective", "turn", "speaker",
        F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise("user").alias("role"),
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("_head"), "_body", own.alias("trained"))
    seg = seg.withColumn("rendered", F.concat("_head", "_body", F.lit(CLOSE)))
    order = [F.col("turn"), F.col("speaker"), F.col("_body")]
    # Characters and turns before a segment, by one range partitioning: a sum of pairs packed in a decimal.
    seg = seg.withColumn("_len", F.length("rendered").cast("long"))
    seg = seg.withColumn("_both", (F.col("_len").cast("decimal(38,0)") * F.lit(10**15).cast("decimal(16,0)") + 1).cast("decimal(36,0)"))
    placed = prefix_sums(scratch, seg, ["conv_id", "perspective"], order, "_both", "_sum", "segments")
    placed = placed.withColumn("seg_start", F.floor(F.col("_sum") / F.lit(10**15)).cast("long"))
    placed = placed.withColumn("segment", (F.col("_sum") % F.lit(10**15)).cast("long"))
    begin = F.col("seg_start") + F.length("_head")
    return placed.select(
        "conv_id", "perspective", "segment", "turn", "speaker", "role", "rendered", "seg_start",
        (F.col("seg_start") + F.col("_len")).alias("seg_end"),
        F.when(F.col("trained"), begin).alias("mask_start"),
        F.when(F.col("trained"), F.col("seg_start") + F.col("_len") - 1).alias("mask_end"), "trained")


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole rendered strings, for conversations known to fit a row: conv_id, perspective, text, masks."""
    part = F.struct("segment", "rendered", "mask_start", "mask_end")
    rows = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(part)).alias("_p"))
    masks = F.transform(F.filter("_p", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"], x["mask_end"]))
    return rows.select("conv_id", "perspective", F.array_join(F.col("_p.rendered"), "").alias("text"), masks.alias("masks"))
