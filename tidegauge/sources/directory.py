"""A watched directory as one streaming source: which files count is decided by their name and time, before they are read.

The caller's predicate is a column over the file's name. A file it says neither yes nor no to has a name that cannot be read; such
names go to a second sink of the same query, so that a strange file neither stops the stream nor disappears unseen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidegauge.operators import files
from tidegauge.sources.readers import read_line_stream
from tidegauge.streaming import sinks

Predicate = Callable[[Column], Column]


def fresh_by_name(now: Column, **kwargs) -> Predicate:
    """The usual predicate: visible files whose name is not too old; NULL for a visible name without a time."""
    return lambda name: files.is_visible(name) & files.is_fresh(name, now, **kwargs)


def directory_lines(
    spark: SparkSession, path: str, accept: Predicate, start_s: int | None = None, **options: str
) -> DataFrame:
    """A stream of line, file_name, file_mtime_s and accepted, which is NULL for lines of files with an unreadable name.

    With ``start_s``, files written before that second do not count, whatever their name. Files that are not accepted
    are left out; the conditions are on ``_metadata``, so Spark does not read them.
    """
    stream = read_line_stream(spark, "text", path=path, **options)
    if start_s is not None:
        stream = stream.where(F.col("file_mtime_s") >= start_s)
    accepted = accept(F.col("file_name"))
    return stream.where(F.coalesce(accepted, F.lit(True))).withColumn("accepted", accepted)


def to_two_sinks(lines: DataFrame, accepted: str, unreadable: str) -> DataStreamWriter:
    """Writes the lines of accepted files to one folder, the names of unreadable ones to another, per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.where("accepted").select(F.col("file_name").alias("name"), "line")
        kept.write.mode("overwrite").parquet(f"{accepted}/batch_id={batch_id}")
        strange = batch.where(F.col("accepted").isNull()).select(F.col("file_name").alias("name")).distinct()
        strange.write.mode("overwrite").parquet(f"{unreadable}/batch_id={batch_id}")

    return sinks.for_each_batch(lines, write)
