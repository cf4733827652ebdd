"""Streams: windows over event time, sessions, deduplication and stateful counts, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which wants a time with zone; a batch as it is."""
    if not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Rows, and the sum of a value, per window and keys; batches and streams alike."""
    base = _timed(events, time, late)
    aggs = [F.count("*").alias("n"), *([F.round(F.sum(value), 4).alias("total")] if value else [])]
    out = base.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *(a for a in out.columns if a not in ("window", *keys)))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """One row per session of a key: runs of events less than the gap apart."""
    base = _timed(events, time, late)
    out = base.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *keys, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return _timed(events, time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def running_counts(events: DataFrame, key: str, key_type: str = "bigint") -> DataFrame:
    """(key, n): how many events each key has had so far, kept as state; a batch is counted before its keys meet their state."""

    return events.groupBy(F.col(f"`{key}`").cast(key_type).alias(key)).agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], Any], checkpoint: str, once: bool = True) -> StreamingQuery:
    """``fn`` over every micro-batch; its number lets a sink write each batch exactly once."""
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
