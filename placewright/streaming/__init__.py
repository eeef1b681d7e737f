"""Streams. Row functions run on a stream as they are; duplicates over time are an extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..core.expand import Options


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Addresses from files that arrive in a folder: (value)."""
    return spark.readStream.text(path)


def expanded_stream(lines: DataFrame, options: Options = Options()) -> DataFrame:
    return lines.select("value", fn.expand_address("value", options).alias("expansions"))


def first_seen(stream: DataFrame, time: str, keys: Column, watermark: str = "1 hour") -> DataFrame:
    """One event per blocking key within the watermark: keys whose state has expired may come again.
    State is one row per live key."""
    exploded = stream.withWatermark(time, watermark).withColumn("key", F.explode(keys))
    return exploded.dropDuplicatesWithinWatermark(["key"])


def counted_windows(stream: DataFrame, time: str, by: str, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Counts by value and time window; late events within the watermark are counted."""
    return stream.withWatermark(time, watermark).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
