"""Run time of an external job against the number of containers it ran on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_durations(rows: DataFrame) -> DataFrame:
    """Per run: total, preparation and net seconds, each from the first row with its label; runs without both drop out."""

    def first_with(file: str, topic: str):
        label = (F.col("file") == file) & (F.col("topic") == topic)
        return F.min_by(F.col("duration_secs").try_cast("double"), F.when(label, F.col("line_no")))

    return (
        rows.groupBy("run_id", "container_count")
        .agg(
            first_with("benchmark_full_pipeline", "full").alias("total"),
            first_with("simulator_no_flask", "prepared_to_stream").alias("prepare"),
        )
        .where(F.col("total").isNotNull() & F.col("prepare").isNotNull())
        .withColumn("net_sec", F.col("total") - F.col("prepare"))
    )


def printed_results(durations: DataFrame) -> DataFrame:
    """Each run as the printed record a results file holds."""
    text = F.format_string(
        "{'total': '%s', 'prepare': '%s', 'container_count': %d}",
        F.col("total").cast("string"),
        F.col("prepare").cast("string"),
        F.col("container_count"),
    )
    return durations.select("run_id", text.alias("line"))


def scaling_curve(results: DataFrame) -> DataFrame:
    """Per number of containers: runs, and mean, shortest and longest net seconds."""
    net = F.col("total") - F.col("prepare")
    return results.groupBy("container_count").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(net).alias("mean_sec"),
        F.min(net).alias("min_sec"),
        F.max(net).alias("max_sec"),
    )
