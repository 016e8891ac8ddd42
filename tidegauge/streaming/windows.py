"""Counts over event-time batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, interval: str, lateness: str, ts: str = "ts") -> DataFrame:
    """Rows per batch; the watermark lets Spark drop the state of batches that can no longer change."""
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, interval).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_seconds("w.start").alias("batch_start_s"), "n")
    )


def newest_counts(kept: DataFrame) -> DataFrame:
    """Final count per batch from the updates of all micro-batches."""
    return kept.groupBy("batch_start_s").agg(F.max_by("n", "batch_id").alias("n"))
