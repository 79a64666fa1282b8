"""References found in text as a graph of sections.

A phrase such as "see section 7 in Manual 12" is resolved by its longest match with a section's heading or
number, in the document that its longest match with a title names, else in its own.  Matching is an equi-join:
a phrase is bounded, so its runs of words are few, and headings and titles are keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.chunking import source_spans

#: Words of a phrase, a title or a heading; section numbers are one word.
KEY_WORD = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"
#: The longest title has so many words, and a number before it.
MOST_WORDS = 14
SECTION = ["document_version_id", "section_ordinal"]


def key_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(KEY_WORD), F.lit(0))


def heading_keys(heading: Column) -> Column:
    """What a section may be called: its whole heading, "section" with its number, its title alone."""
    number = F.regexp_extract(heading, r"^(?:Section )?(\d+(?:\.\d+)*) ", 1)
    whole, title = F.array_join(key_words(heading), " "), F.array_join(key_words(F.regexp_replace(heading, r"^(?:Section )?\d+(?:\.\d+)* ", "")), " ")
    return F.filter(F.array_distinct(F.array(whole, F.when(number != "", F.concat(F.lit("section "), number)), title)), lambda k: k.isNotNull() & (k != ""))


def _runs(words: Column) -> Column:
    """All runs of a phrase's words, as key, its number of words and its place."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), F.greatest(F.size(words) - i + 1, F.lit(1)))),
        lambda n: F.struct(F.array_join(F.slice(words, i, n), " ").alias("key"), n.alias("n"), i.alias("i")))))


def _longest(found: DataFrame, by: list[str], target: list[str]) -> DataFrame:
    """Of all matches the longest, then the first, then the smallest target."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("i"), *target)).alias("m")
    return found.groupBy(*by).agg(best).select(*by, *[F.col(f"m.{c}").alias(c) for c in target])


def reference_edges(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """An edge a phrase: chunk_id, document_version_id, section_ordinal, phrase, dst_document, dst_section, start, stop, validation_status.

    ``chunks`` and ``sections`` are as the chunker gives them.  ``start`` and ``stop`` are the phrase's place in
    the source; where a chunk's text isn't its source (rows of a table), that of the chunk.  Phrases that name
    nothing keep a row without a target, ``unresolved``; a section that names itself is no reference.
    """
    phrases = chunks.select("chunk_id", *SECTION, "text", "spans", F.explode("reference_refs").alias("phrase"))
    local = F.position(F.col("phrase"), F.col("text")) - 1
    at = F.get(source_spans(F.col("spans"), local, local + F.length("phrase")), F.lit(0))
    whole = F.aggregate("spans", F.lit(-1), lambda a, s: a + s["end"] - s["start"] + 1) == F.length("text")
    start, stop = (F.when(whole, at[c]).otherwise(other) for c, other in (("start", F.get("spans", F.lit(0))["start"]), ("end", F.element_at("spans", -1)["end"])))
    phrases = phrases.select("chunk_id", *SECTION, "phrase", start.alias("start"), stop.alias("stop"))
    one = ["chunk_id", "phrase"]
    runs = phrases.select(*one, F.explode(_runs(key_words(F.col("phrase")))).alias("r")).select(*one, "r.*")
    titles = sections.groupBy("document_version_id").agg(F.min("document_title").alias("t")).select(F.array_join(key_words(F.col("t")), " ").alias("key"), F.col("document_version_id").alias("named"))
    named = _longest(runs.join(titles, "key"), one, ["named"])
    asked = phrases.join(named, one, "left").withColumn("dst_document", F.coalesce("named", "document_version_id"))
    # A title names a document, so the section that bears it is no match of its own.
    keys = sections.where("heading <> document_title").select(F.col("document_version_id").alias("dst_document"), F.col("section_ordinal").alias("dst_section"), F.explode(heading_keys(F.col("heading"))).alias("key"))
    met = asked.select(*one, "dst_document").join(runs, one).join(keys, ["dst_document", "key"])
    found = asked.join(_longest(met, one, ["dst_section"]), one, "left")
    # A phrase that names a document only means its first section.
    section = F.coalesce("dst_section", F.when(F.col("named").isNotNull(), 0))
    own = (F.col("dst_document") == F.col("document_version_id")) & (section == F.col("section_ordinal"))
    good = section.isNotNull() & ~F.coalesce(own, F.lit(False))
    return found.select(
        "chunk_id", *SECTION, "phrase", F.when(good, F.col("dst_document")).alias("dst_document"), F.when(good, section).alias("dst_section"),
        "start", "stop", F.when(good, "validated").when(section.isNotNull(), "self").otherwise("unresolved").alias("validation_status"))


def visible_edges(edges: DataFrame, readable: DataFrame) -> DataFrame:
    """Validated edges whose both ends and whose supporting chunk are in ``readable`` (chunks)."""
    ends = readable.select(F.col("document_version_id").alias("dst_document"), F.col("section_ordinal").alias("dst_section")).distinct()
    good = edges.where("validation_status = 'validated'").join(readable.select("chunk_id"), "chunk_id", "left_semi")
    return good.join(ends, ["dst_document", "dst_section"], "left_semi")


def with_referenced(ranked: DataFrame, edges: DataFrame, chunks: DataFrame, by: list[str], additions: int = 10, most: int = 30) -> DataFrame:
    """``by``, chunk_id, hop, rank: the ranked chunks, then those of sections that their sections refer to.

    ``edges`` are visible ones, ``chunks`` readable ones.  A hop goes from chunk to section, along an edge, and to
    the section's chunks in order; additions stand by their best seed, ``additions`` and ``most`` in all.  Only a
    section's first ``additions`` chunks can be added, so no more are looked up.
    """
    place = Window.partitionBy(*SECTION).orderBy("chunk_ordinal", "chunk_id")
    first = chunks.select("chunk_id", *SECTION, F.row_number().over(place).alias("_n")).where(F.col("_n") <= additions)
    seeds = ranked.join(chunks.select("chunk_id", *SECTION), "chunk_id").groupBy(*by, *SECTION).agg(F.min("rank").alias("seed"))
    hops = edges.select(*SECTION, "dst_document", "dst_section").distinct()
    near = seeds.join(hops, SECTION).groupBy(*by, F.col("dst_document").alias("document_version_id"), F.col("dst_section").alias("section_ordinal")).agg(F.min("seed").alias("seed"))
    near = near.join(first, SECTION).join(ranked.select(*by, "chunk_id"), [*by, "chunk_id"], "left_anti")
    order = Window.partitionBy(*by).orderBy("seed", *SECTION, "_n")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= additions)
    both = ranked.select(*by, "chunk_id", F.lit(0).alias("hop"), F.col("rank").alias("place")).unionByName(near.select(*by, "chunk_id", F.lit(1).alias("hop"), "place"))
    every = Window.partitionBy(*by).orderBy("hop", "place")
    return both.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= most).select(*by, "chunk_id", "hop", "rank")
