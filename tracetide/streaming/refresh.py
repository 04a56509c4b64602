"""Incremental refresh of derived tables, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracetide.operators.clock import to_rebuild


def refresh(wanted: DataFrame, built: DataFrame | None, keys: list[str], build: Callable[[DataFrame], DataFrame], path: str, force: bool = False) -> int:
    """Rebuilds keys whose version is missing or stale and replaces only their partitions; returns how many.

    `build` gets the keys to do and returns their rows with the key columns; the version is written beside.
    """
    todo = wanted if built is None else to_rebuild(wanted, built, keys, "version", force)
    todo = todo.persist()
    n = todo.count()
    if n:
        out = build(todo).join(todo.select(*keys, "version"), keys)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    todo.unpersist()
    return n


def windowed_rates(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Counts and means of a stream of events by key and window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def stream_rates(spark: SparkSession, path: str, schema, out: str, checkpoint: str, window: str = "6 hours", late: str = "1 hour") -> StreamingQuery:
    """Runs `windowed_rates` over the files of a folder until all are read, into Parquet."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    rates = windowed_rates(events, "ts", "event_type", window, late)
    flat = rates.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "mean_value")
    return flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
