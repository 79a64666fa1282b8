"""The training-corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. language ID: documents without a letter, or on whose side no learned language is, go;
2. n-gram Jaccard join (five words, similarity 0.8): of each group the document with the smallest id stays;
3. benchmark decontamination: documents with a verbatim benchmark window go;
4. mixing sources to target weights: a document is repeated or, at its source's cut, shortened;
5. token-ID / binary output: the ids of every remaining row, in doc_id order, read back from the files.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, language_id, mixing, ngram_join, token_output
from vellum.llm.common import Scratch, scratch_root
from vellum.llm.queries import default_tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write(docs, path, default_tokenizer())
    return token_output.index(spark, path)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("token_output", tokens),
]

#: SQL can't express training, hash order and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        before = list(scratch.paths)
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)  # no later stage reads what came before
    return STAGES[-1][1](spark, docs, sf_dir)
