"""Incremental ingestion as a stream: each micro-batch is merged into the buckets of keys that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.staging import shared_folder  # noqa: F401
from vellum.sources.generations import BucketedStore


def merge_stream(stream: DataFrame, store: BucketedStore, checkpoint: str, order: list[str]):
    """Starts a query that merges every batch into the buckets it touches; a batch that is repeated changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(batch, order, f"batch-{number:08d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_user(spark: SparkSession, events_path: str, schema, work: str) -> DataFrame:
    """Runs the stream over a folder of event files to its end; the last event of every user."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(events_path).select("user_id", "event_id", "ts", "event_type")
    store = BucketedStore(spark, f"{work}/store", "user_id")
    merge_stream(events, store, f"{work}/checkpoint", ["ts", "event_id"]).awaitTermination()
    found = store.read()
    return found if found is not None else spark.createDataFrame([], events.schema)


def activity_windows(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by type and window with a watermark, for streams and tables alike."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
