"""The shapes the operators work on, derived from the ``events`` and ``documents`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import messages as msg
from tidegauge.functions import times
from tidegauge.operators.generate import with_line
from tidegauge.session import use_utc

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.schema(DOCUMENTS_SCHEMA).parquet(f"{sf_dir}/documents.parquet")


def tag_number() -> Column:
    """The number 0..99 every event carries in its properties."""
    return F.get_json_object("props", "$.k").cast("int")


def size_bytes() -> Column:
    """Message sizes 64..120, all longer than the 31-character header."""
    return F.lit(64) + F.lit(8) * (F.col("event_id") % 8)


def event_name() -> Column:
    return msg.file_name(times.seconds(F.col("ts")), F.col("event_id"))


def second_text() -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of an event."""
    return F.substring(F.col("ts").cast("string"), 1, 19)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, source_id, ts, cpu_pause_ms, message_bytes, line"""
    return with_line(
        events(spark, sf_dir).select(
            F.col("event_id").alias("msg_id"),
            F.col("user_id").alias("source_id"),
            "ts",
            tag_number().alias("cpu_pause_ms"),
            size_bytes().alias("message_bytes"),
            event_name().alias("name"),
        )
    ).drop("name")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, name, mtime_s: error events are files in progress, signups have a leading underscore."""
    prefix = (
        F.when(F.col("event_type") == "error", ".COPYING.")
        .when(F.col("event_type") == "signup", "_")
        .otherwise("")
    )
    return events(spark, sf_dir).select(
        "event_id",
        F.concat(prefix, event_name()).alias("name"),
        (times.seconds(F.col("ts")) + tag_number()).alias("mtime_s"),
    )


# A run has a batch at each multiple of this time; a poll lists the newest of them.
BATCH_EVERY_SEC = 14_400
LISTED_BATCHES = 4


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number and second in columns of their own, so that shapes that use them often read them once."""
    return events(spark, sf_dir).withColumns({"_k": tag_number(), "_sec": times.seconds(F.col("ts"))})


def _batch_time(sec: Column) -> Column:
    return F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss'.000GMT'")


def batch_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fetch_id, run_id, ts, payload: each event is a poll of its run that got a JSON list of batches.

    The newest four batches of the run are listed, so polls overlap, and a batch listed again has another delay, none, or a negative
    one (the delay key is absent when missing). Views also list a batch in progress, errors one or two queued ones.
    """
    kind, k, sec = F.col("event_type"), F.col("_k"), F.col("_sec")
    newest = F.floor(sec / BATCH_EVERY_SEC).cast("bigint")
    scale = F.element_at(F.array(F.lit(1.0), F.lit(10.0), F.lit(100.0)), (F.col("user_id") % 3 + 1).cast("int"))
    delay = F.floor(F.col("value") * 100 / scale).cast("bigint")

    def record(number: Column, start: Column, status: Column, delay_ms: Column) -> Column:
        return F.struct(
            number.alias("batchId"), _batch_time(start).alias("batchTime"), status.alias("status"), delay_ms.alias("totalDelay")
        )

    def listed(back: int) -> Column:
        queued = F.lit(back < 2) & (kind == "error") & (F.lit(back == 0) | (k < 50))
        turn = (k + 7 * back) % 20
        known = F.when(turn == 18, F.lit(-1).cast("bigint")).when(turn < 18, delay + 10 * back)
        return record(
            newest - back, (newest - back) * BATCH_EVERY_SEC, F.when(queued, "QUEUED").otherwise("COMPLETED"), known
        )

    grid = F.array(*[listed(i) for i in range(LISTED_BATCHES)])
    live = F.array(record(sec, sec - k % 40, F.lit("PROCESSING"), F.lit(None).cast("bigint")))
    records = F.when(kind == "view", F.concat(grid, live)).otherwise(grid)
    return _numbered(spark, sf_dir).select(
        F.col("event_id").alias("fetch_id"), F.col("user_id").alias("run_id"), "ts", F.to_json(records).alias("payload")
    )


def statistics_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fetch_id, run_id, payload: the run statistics a poll got, one object per event; the total delay may be absent."""
    k, number = tag_number().cast("bigint"), F.col("event_id")
    down = (F.col("event_type") == "error").cast("bigint")
    statistics = F.struct(
        _batch_time(times.seconds(F.col("ts"))).alias("startTime"),
        F.lit(5000).alias("batchDuration"),
        F.lit(1).alias("numReceivers"),
        (1 - down).alias("numActiveReceivers"),
        down.alias("numInactiveReceivers"),
        k.alias("numTotalCompletedBatches"),
        F.least(k, F.lit(50)).alias("numRetainedCompletedBatches"),
        (number % 3).alias("numActiveBatches"),
        size_bytes().alias("numProcessedRecords"),
        (size_bytes() + k).alias("numReceivedRecords"),
        (size_bytes() / 8.0).alias("avgInputRate"),
        (number % 7).alias("avgSchedulingDelay"),
        k.alias("avgProcessingTime"),
        F.when(k < 95, number % 7 + k).alias("avgTotalDelay"),
    )
    return events(spark, sf_dir).select(
        number.alias("fetch_id"), F.col("user_id").alias("run_id"), F.to_json(statistics).alias("payload")
    )


def app_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fetch_id, payload: a JSON list holding one application with one or two attempts, per signup."""
    us = times.micros(F.col("ts"))
    start_ms = F.floor(us / F.lit(1000)).cast("bigint")
    duration = tag_number().cast("bigint") * 1000

    def attempt(started: Column, done: Column) -> Column:
        text = F.date_format(F.timestamp_millis(started), "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'")
        return F.struct(
            text.alias("startTime"),
            duration.alias("duration"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("sparkUser"),
            done.alias("completed"),
            started.alias("startTimeEpoch"),
        )

    first = attempt(start_ms, F.lit(True))
    second = attempt(start_ms + duration, F.lit(False))
    app = F.struct(
        F.concat(F.lit("local-"), start_ms.cast("string")).alias("id"),
        F.concat(F.lit("run "), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("event_id") % 2 == 0, F.array(first, second)).otherwise(F.array(first)).alias("attempts"),
    )
    return (
        events(spark, sf_dir)
        .where(F.col("event_type") == "signup")
        .select(F.col("event_id").alias("fetch_id"), F.to_json(F.array(app)).alias("payload"))
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change_id, run_id, ts, frequency, message_bytes: each starts a new epoch of its run."""
    return (
        events(spark, sf_dir)
        .where(F.col("event_type") == "signup")
        .select(
            F.col("event_id").alias("change_id"),
            F.col("user_id").alias("run_id"),
            "ts",
            (tag_number() + 1).cast("bigint").alias("frequency"),
            size_bytes().alias("message_bytes"),
        )
    )


def control_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, run_id, ts, body: JSON parameter updates, mostly partial."""
    kind, k = F.col("event_type"), tag_number().cast("string")
    body = (
        F.when(kind == "purchase", F.concat(F.lit('{"cpu_pause_ms":'), k, F.lit("}")))
        .when(kind == "view", F.concat(F.lit('{"message_bytes":'), size_bytes().cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"cpu_pause_ms":'), k, F.lit(',"message_bytes":200,"period_sec":0.5}')))
    )
    return (
        events(spark, sf_dir)
        .where(kind.isin("purchase", "view", "signup"))
        .select("event_id", F.col("user_id").alias("run_id"), "ts", body.alias("body"))
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, run_id, ts, line: listing, progress and warning lines, and junk that must not parse."""
    kind, k = F.col("event_type"), tag_number()
    stamp = second_text()
    listing = F.concat(
        stamp,
        F.lit(" INFO  FileInputDStream:54 - Finding new files took "),
        (k * 60).cast("string"),
        F.lit(" ms"),
    )
    progress = F.concat(stamp, F.lit(" INFO  file-streaming-app:76 - processed: "), k.cast("string"))
    line = (
        F.when(kind.isin("click", "purchase"), listing)
        .when(kind == "view", progress)
        .when(kind == "signup", F.concat(stamp, F.lit(" WARN  JobScheduler:66 - slow")))
        .otherwise(" bla bla")
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("line_no"), F.col("user_id").alias("run_id"), "ts", line.alias("line")
    )


def bench_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, run_id, container_count, line: tagged comma rows among noise."""
    kind, k, sec = F.col("event_type"), tag_number(), times.seconds(F.col("ts"))

    def row(prefix: str, duration: Column) -> Column:
        return F.concat_ws(
            ",", F.lit(prefix), sec.cast("string"), (sec + duration).cast("string"), duration.cast("string"), F.lit("-1")
        )

    line = (
        F.when(kind == "click", row("benchmarking,benchmark_full_pipeline,full,", k + 100))
        .when(kind == "view", row("benchmarking,simulator_no_flask,prepared_to_stream,", k))
        .otherwise("noise")
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("line_no"),
        F.col("user_id").alias("run_id"),
        (F.col("user_id") % 10 + 1).cast("int").alias("container_count"),
        line.alias("line"),
    )
