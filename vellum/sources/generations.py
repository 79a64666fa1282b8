"""Index generations: a directory each, and an append-only log whose last row names the current one.

Readers see a generation only once its log row is there, so a failed or unvalidated build is never
read; rolling back appends a row for an older generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG = "seq long, generation string, published timestamp"


class GenerationStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException:  # nothing published yet
            return self.spark.createDataFrame([], LOG)

    def current(self) -> str | None:
        row = self.log().agg(F.max(F.struct("seq", "generation")).alias("m")).select("m.generation").first()
        return row[0]

    def read(self, generation: str | None = None) -> DataFrame | None:
        name = generation or self.current()
        return self.spark.read.parquet(f"{self.path}/generation={name}") if name else None

    def publish(self, df: DataFrame, generation: str, valid: Callable[[DataFrame], bool] = lambda df: True) -> None:
        """Writes, reads back, validates, then points to the generation; an invalid one is left unnamed."""
        df.write.mode("overwrite").parquet(f"{self.path}/generation={generation}")
        if not valid(self.read(generation)):
            raise ValueError(f"generation {generation} is not valid")
        self._point(generation)

    def rollback(self, generation: str) -> None:
        if self.log().where(F.col("generation") == generation).isEmpty():
            raise ValueError(f"generation {generation} was never published")
        self._point(generation)

    def _point(self, generation: str) -> None:
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        row = self.spark.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(generation).alias("generation"), F.current_timestamp().alias("published"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")


def fingerprint(parts: DataFrame, column: str) -> str:
    """A generation's id: SHA-256 over its parts' fingerprints, summed so that no order or single task is needed."""
    pieces = [F.sum(F.conv(F.substring(F.sha2(F.col(column), 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    row = parts.agg(F.count("*").alias("n"), *pieces).select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", *[f"p{i}" for i in range(5)])]), 256)).first()
    return row[0]


def upsert(current: DataFrame | None, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Current rows with the incoming ones over them: for each key the last in ``order``.  Applying it twice changes nothing."""
    rows = incoming if current is None else current.unionByName(incoming)
    columns = [c for c in incoming.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*").select(*incoming.columns)


def retire(current: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """What stays when only ``active`` keys remain in the corpus."""
    return current.join(active.select(key).distinct(), key, "left_semi")


class BucketedStore:
    """A keyed table in buckets: a batch writes those it touches, and a log says which generation of each bucket counts."""

    LOG = "seq long, generation string, bucket int"

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log")
        except AnalysisException:  # nothing published yet
            return self.spark.createDataFrame([], self.LOG)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; a row a bucket of the log reaches the driver."""
        rows = self.log().groupBy("bucket").agg(F.max_by("generation", "seq").alias("generation")).collect()
        paths = [f"{self.path}/generation={r['generation']}/bucket={r['bucket']}" for r in rows if only is None or r["bucket"] in only]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, order: list[str], generation: str) -> None:
        """Puts the batch over the rows of its buckets; doing it again under the same name changes nothing."""
        if not self.log().where(F.col("generation") == generation).isEmpty():
            return
        touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]
        if not touched:
            return
        rows = upsert(self.read(touched), batch, self.key, order).withColumn("bucket", self.bucket())
        rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/generation={generation}")
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        named = self.spark.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(generation).alias("generation"), F.explode(F.array(*map(F.lit, touched)).cast("array<int>")).alias("bucket"))
        named.coalesce(1).write.mode("append").parquet(f"{self.path}/log")


CACHE_KEY = ["input_sha256", "model_digest", "dimension", "preprocessing"]


def missing_embeddings(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows of ``wanted`` whose embedding must be made: no cached one has the same input, model, dimension and preprocessing."""
    return wanted.join(cache.select(*CACHE_KEY).distinct(), CACHE_KEY, "left_anti")


def one_model(rows: DataFrame) -> DataFrame:
    """``rows`` if all were made by one model, dimension and preprocessing; else an error, before anything is published."""
    kinds = rows.select("model_digest", "dimension", "preprocessing").distinct().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError("a generation holds embeddings of one model, dimension and preprocessing only")
    return rows
