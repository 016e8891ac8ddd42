"""Readers: message lines (batch and stream), batch and application records, logs, benchmark output, control messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import logs, times

BATCH_RECORDS = "array<struct<batchId bigint, batchTime string, status string, totalDelay bigint>>"
RUN_STATISTICS = (
    "struct<startTime string, batchDuration bigint, numReceivers bigint, numActiveReceivers bigint, "
    "numInactiveReceivers bigint, numTotalCompletedBatches bigint, numRetainedCompletedBatches bigint, "
    "numActiveBatches bigint, numProcessedRecords bigint, numReceivedRecords bigint, avgInputRate double, "
    "avgSchedulingDelay bigint, avgProcessingTime bigint, avgTotalDelay bigint>"
)
APPLICATIONS = (
    "array<struct<id string, name string, attempts array<struct<startTime string, endTime string, "
    "lastUpdated string, duration bigint, sparkUser string, completed boolean, startTimeEpoch bigint, "
    "endTimeEpoch bigint, lastUpdatedEpoch bigint>>>>"
)
PARAM_PATCH = "cpu_pause_ms int, message_bytes bigint, period_sec double"
RESULT_ROW = "total string, prepare string, container_count int"
BENCH_FIELDS = [
    "benchmarking",
    "file",
    "topic",
    "description",
    "started_at_time",
    "ended_time",
    "duration_secs",
    "number_of_bytes",
]


def read_line_stream(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A stream of text lines. ``kind`` is ``socket`` (host, port) or ``text`` (path, and file source options).

    A directory also gives the name and the modification time of the file of each line.
    """
    stream = spark.readStream.format(kind)
    if kind == "socket":
        return stream.options(**options).load().withColumnRenamed("value", "line")
    if kind != "text":
        raise ValueError(f"unknown kind of line stream: {kind}")
    path = options.pop("path")
    return (
        stream.options(**options)
        .load(path)
        .withColumnsRenamed({"value": "line"})
        .withColumns(
            {
                "file_name": F.col("_metadata.file_name"),
                "file_mtime_s": F.unix_seconds("_metadata.file_modification_time"),
            }
        )
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a directory of text files, with file name and modification time."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_name").alias("file_name"),
        F.unix_seconds("_metadata.file_modification_time").alias("file_mtime_s"),
    )


def batch_records(fetches: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per batch record of each fetched JSON list; other columns are kept.

    The outer form of explode is used because Spark repeats the argument of the plain form in a filter below it,
    which would read each payload three times. Times are read inside the list, so that filters on them do not read them again.
    """
    kept = [c for c in fetches.columns if c != payload]
    read = F.transform(
        F.from_json(payload, BATCH_RECORDS),
        lambda r: F.struct(
            r["batchId"].alias("batch_id"),
            times.batch_time_seconds(r["batchTime"]).alias("batch_ts"),
            r["status"].alias("status"),
            r["totalDelay"].alias("total_delay_ms"),
        ),
    )
    records = fetches.select(*kept, F.explode_outer(read).alias("r"))
    return records.where(F.col("r").isNotNull()).select(*kept, "r.*")


def statistics_records(fetches: DataFrame, payload: str = "payload") -> DataFrame:
    """The run statistics of each fetch as columns; a total delay that is absent is NULL."""
    kept = [c for c in fetches.columns if c != payload]
    return fetches.select(*kept, F.from_json(payload, RUN_STATISTICS).alias("s")).select(*kept, "s.*")


def app_records(fetches: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per attempt of the applications of each fetch, with the id of the first application."""
    kept = [c for c in fetches.columns if c != payload]
    return (
        fetches.select(*kept, F.from_json(payload, APPLICATIONS).alias("apps"))
        .withColumn("app_id", F.get("apps", 0).getField("id"))
        .select(*kept, "app_id", F.explode_outer("apps").alias("app"))
        .select(*kept, "app_id", F.col("app.id").alias("id"), F.col("app.name").alias("name"), F.inline("app.attempts"))
    )


def log_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds the fields of each log line; lines that do not match keep NULL fields. Line numbers stay text."""
    fields = {name: logs.log_field(F.col("_parts"), name) for name in logs.FIELDS}
    return (
        lines.withColumn("_parts", logs.log_parts(F.col(line)))
        .withColumns(fields)
        .withColumn("timestamp_unix", times.log_time_seconds(F.col("timestamp_str")))
        .drop("_parts")
    )


def log_tail(lines: DataFrame, order: list[Column], count: int) -> DataFrame:
    """The newest lines; Spark keeps ``count`` rows per task and merges them, with no full sort."""
    return lines.orderBy(*order).limit(count)


def bench_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Fields of the rows tagged ``benchmarking``; all other output is noise."""
    tagged = lines.where(F.col(line).startswith("benchmarking,")).withColumn("_f", F.split(line, ","))
    fields = {name: F.get("_f", i) for i, name in enumerate(BENCH_FIELDS)}
    return tagged.withColumns(fields).drop("_f", line)


def result_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a results file, each a printed record with single quotes."""
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, F.from_json(line, RESULT_ROW, {"allowSingleQuotes": "true"}).alias("r")).select(
        *kept,
        F.col("r.total").try_cast("double").alias("total"),
        F.col("r.prepare").try_cast("double").alias("prepare"),
        F.col("r.container_count").alias("container_count"),
    )


def param_patches(control: DataFrame, body: str = "body") -> DataFrame:
    """Parameter updates from JSON control messages; absent keys are NULL."""
    kept = [c for c in control.columns if c != body]
    return control.select(*kept, F.from_json(body, PARAM_PATCH).alias("p")).select(*kept, "p.*")
