"""Structured Streaming over a folder of changes or events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by tumbling window and keys; rows later than the watermark are dropped, and state for them is freed."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def new_only(changes: DataFrame, time: str, key: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark: files that a recompile hasn't seen."""
    return changes.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
