"""Streams of events: the view counter, request windows and feed buckets, each also as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def view_counts(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, view_count, first_viewed_at, last_viewed_at); streaming in update or complete mode, or batch."""
    views = events.where(F.col("event_type").isin("view", "click"))
    return views.groupBy(key).agg(F.count("*").alias("view_count"), F.min("ts").alias("first_viewed_at"), F.max("ts").alias("last_viewed_at"))


def request_windows(events: DataFrame, key: str = "user_id", width: str = "60 seconds", most: int = 60, late: str | None = None) -> DataFrame:
    """(key, start, n, refused) a fixed window; with late, a watermark lets a stream drop old state."""
    rows = events.withWatermark("ts", late) if late else events
    counts = rows.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def feed_bucket(at, width_ms: int = 300_000):
    """The number of the five-minute bucket that a feed is built in."""
    return F.floor(F.unix_millis(at.cast("timestamp")) / width_ms)


def run_available(spark: SparkSession, path: str, query, out: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All events now under path through a streaming query into the memory sink named out; state survives in checkpoint."""
    stream = spark.readStream.schema(EVENTS).parquet(path)
    q = query(stream).writeStream.outputMode(mode).format("memory").queryName(out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(out)
