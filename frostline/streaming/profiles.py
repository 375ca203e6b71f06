"""Running profile sums over a stream of interactions (an extension; the batch plans don't use it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, uid, events, items) of a stream with ts, uid, item; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", window), "uid").agg(F.count("*").alias("events"), F.approx_count_distinct("item").alias("items"))


def running_profiles(stream: DataFrame, vectors: DataFrame) -> DataFrame:
    """(uid, term, w): unnormalised sums of item vectors; a complete-mode aggregation joined to a static table."""
    return stream.join(vectors, "item").groupBy("uid", "term").agg(F.sum("w").alias("w"))
