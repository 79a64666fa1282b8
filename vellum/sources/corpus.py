"""Reading a corpus by its manifest, and writing chunks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.ids import document_version_id

_ENTRY = "corpus_id string, policy_issuer string, path string, sha256 string, effective_from date, source_url string, classification string, access_policy_id string, source_type string"
MANIFEST = f"schema_version string, repository string, commit string, license string, tenant_id string, allowlist_only boolean, documents array<struct<{_ENTRY.replace(' string', ':string').replace(' date', ':date')}>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed document: the manifest's tenant_id and the entry's columns."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select("tenant_id", F.inline("documents"))


def documents(spark: SparkSession, listed: DataFrame, root: str) -> DataFrame:
    """The listed files under ``root``, verified: a file whose bytes don't match its checksum fails the job.

    Only listed files are opened.  Columns: those of the manifest, text, document_version_id.
    """
    base = root.rstrip("/") + "/"
    paths = [base + r["path"] for r in listed.select("path").distinct().toLocalIterator()]  # names only, as a listing has them
    if not paths:
        return listed.withColumn("text", F.lit(None).cast("string")).withColumn("document_version_id", F.lit(None).cast("string"))
    files = spark.read.format("binaryFile").load(paths)
    relative = F.substring_index(F.col("file"), base.split("://")[-1].lstrip("/"), -1)
    files = files.select(F.regexp_replace("path", r"^\w+:/*", "").alias("file"), "content").withColumn("path", relative).drop("file")
    found = listed.join(files, "path", "inner")
    actual = F.sha2(F.col("content"), 256)
    message = F.concat(F.lit("checksum mismatch: "), F.col("path"))
    checked = F.when(actual == F.col("sha256"), F.decode("content", "UTF-8")).otherwise(F.raise_error(message).cast("string"))
    return found.withColumn("text", checked).drop("content").withColumn("document_version_id", document_version_id(F.col("corpus_id"), F.col("sha256")))


def chunk_records(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks as records for the line-delimited sink: start and end instead of spans, corpus and issuer added."""
    named = docs.select("document_version_id", "corpus_id", "policy_issuer")
    return chunks.join(named, "document_version_id").select(
        "chunk_id", "parent_id", "document_version_id", "corpus_id", "policy_issuer", "heading_path", "text", "source_start", "source_end", "access_policy_id",
        "token_count", "overlap_tokens", "part_index", "continuation_of", "exception_refs", "reference_refs", "table_header", "embedding_input")


def write_jsonl(records: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; nulls are written, as readers expect every field."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def summary(chunks: DataFrame, docs: DataFrame, max_tokens: int = 400) -> DataFrame:
    """A row per corpus: issuer, sha256, characters, children, sections, max_child_tokens, over_max, headings."""
    per = chunks.groupBy("document_version_id").agg(
        F.count("*").alias("children"), F.countDistinct("parent_id").alias("sections"), F.coalesce(F.max("token_count"), F.lit(0)).alias("max_child_tokens"),
        F.array_sort(F.collect_list(F.when(F.col("token_count") > max_tokens, F.col("token_count")))).alias("over_max"),
        F.sort_array(F.collect_set("heading_path")).alias("headings"))
    left = docs.select("document_version_id", "corpus_id", F.col("policy_issuer").alias("issuer"), "sha256", F.length("text").alias("characters"))
    return left.join(per, "document_version_id", "left").na.fill(0, ["children", "sections", "max_child_tokens"]).drop("document_version_id")

