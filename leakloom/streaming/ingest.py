"""Structured Streaming: incremental ingest, windowed counters, keyed quota state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_candidates(stream: DataFrame, known: DataFrame, key: str, time: str, lateness: str = "1 day") -> DataFrame:
    """Stream rows that are neither known nor repeated within the watermark."""
    fresh = stream.join(known.select(key).distinct(), key, "left_anti")
    return fresh.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def flushed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Micro-batches to ``sink`` (an upsert); a batch that is replayed must give the same rows."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(events: DataFrame, key: str, time: str = "ts", width: str = "1 minute", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Requests of each key in tumbling (or sliding) windows."""
    source = events.withWatermark(time, lateness) if events.isStreaming else events
    return source.groupBy(F.window(time, width, slide), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    source = events.withWatermark(time, lateness) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
