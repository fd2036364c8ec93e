"""Resumable ingest as a stream: batches of embedded chunks land, are upserted, and documents
become ready when all their chunks are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import CHUNKS, Store


def ingest_stream(spark: SparkSession, landing: str, store: Store, checkpoint: str, schema: str = CHUNKS) -> StreamingQuery:
    """Drain ``landing`` (Parquet) into the store. A batch that is run again after a failure
    upserts the same keys, so nothing is counted twice; the checkpoint is the resume point.
    A batch rewrites the partitions of its own documents only, by one commit."""

    def land(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert_chunks(batch, finalise=True)

    source = spark.readStream.schema(schema).parquet(landing)
    return source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and type; a stream drops what comes later than ``late``."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return windowed.agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
