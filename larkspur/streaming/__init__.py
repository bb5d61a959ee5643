"""Streaming versions of filters, windowed sums and deduplication, for files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema: str, time: str, late: str = "10 minutes", files_at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder; ``time`` becomes an event time, rows later than ``late`` may be dropped."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return found.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, size: str, keys: tuple[str, ...] = (), slide: str | None = None, **aggregates) -> DataFrame:
    """Sums over windows of a fixed size, for streams and tables alike; with ``slide`` a new one begins that often."""
    grouped = events.groupBy(F.window(time, size, slide).alias("w"), *keys)
    return grouped.agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: tuple[str, ...], **aggregates) -> DataFrame:
    """Sums over runs of events with less than ``gap`` between them."""
    grouped = events.groupBy(F.session_window(time, gap).alias("w"), *keys)
    return grouped.agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def first_seen(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One event for each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def run_to_table(found: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what has arrived, into a table in memory (for tests)."""
    query = found.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
