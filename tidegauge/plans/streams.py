"""Streaming queries over the given tables.

A table is delivered in slices of time to a folder the stream watches; each slice becomes one micro-batch, so results
can be compared with the batch form. The number of slices is fixed, and each grows with the table.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.functions import messages as msg
from tidegauge.functions import times
from tidegauge.operators import words
from tidegauge.session import scratch_dir
from tidegauge.sources import directory, folders, readers, tables
from tidegauge.streaming import epochs, late, progress, runs, sinks, tail, windows, wins

SLICES = 4
# The batches of the tables are four hours long, not five seconds, so a span of state is longer too.
KNOWN_SPAN_SEC = 7 * 86_400
FRESH_FROM_S = 1_704_931_200  # 2024-01-11 00:00:00 UTC


def _message_slices(spark: SparkSession, sf_dir: str, count: int = SLICES) -> Iterator[DataFrame]:
    # Cut before the lines are made, so the cut reaches the scan.
    return runs.time_slices(tables.messages(spark, sf_dir), count)


def _deliver_lines(root: str):
    def deliver(part: DataFrame, number: int) -> None:
        sinks.publish_messages(part.select("line"), f"{root}/in/slice-{number}")

    return deliver


def _line_stream(spark: SparkSession, root: str, **options: str) -> DataFrame:
    return readers.read_line_stream(spark, "text", path=f"{root}/in/*", **options)


def foreach_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each micro-batch and the CPU time they ask for."""
    root = scratch_dir(spark, "batch-counts")
    runs.replay(
        _message_slices(spark, sf_dir),
        _deliver_lines(root),
        lambda: sinks.cost_per_batch(_line_stream(spark, root), f"{root}/out"),
        f"{root}/checkpoint",
    )
    return sinks.kept_batches(spark, f"{root}/out").select("batch_id", "n", "cost_ms")


def stream_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "line-count")
    runs.replay(
        _message_slices(spark, sf_dir, 2),
        _deliver_lines(root),
        lambda: sinks.count_batches(_line_stream(spark, root), f"{root}/out"),
        f"{root}/checkpoint",
    )
    return sinks.kept_batches(spark, f"{root}/out").agg(F.sum("n").alias("n"))


def stream_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each micro-batch of log lines; nothing is kept from one micro-batch to the next."""
    root = scratch_dir(spark, "word-count")

    def deliver(part: DataFrame, number: int) -> None:
        sinks.publish_messages(part.select("line"), f"{root}/in/slice-{number}")

    runs.replay(
        runs.time_slices(tables.log_lines(spark, sf_dir), 2),
        deliver,
        lambda: sinks.keep_batches(
            _line_stream(spark, root),
            f"{root}/out",
            lambda batch: words.word_count(batch, words.words_of(F.col("line"))),
        ),
        f"{root}/checkpoint",
    )
    return sinks.kept_batches(spark, f"{root}/out").select("batch_id", "word", "n")


def _watch_directory(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Files named by day, some with a name that has no time, some written before the stream began, through the directory source."""
    day = F.floor(times.seconds(F.col("ts")) / 86_400).cast("bigint")
    dated = msg.file_name(day * 86_400, day)
    name = F.when(F.col("cpu_pause_ms") % 10 == 0, F.concat(F.lit("notes-"), day.cast("string"))).otherwise(dated)
    started = int(time.time())

    def deliver(part: DataFrame, number: int) -> None:
        # a day that is cut by the slices has a file in each
        named = part.select("line", F.concat(name, F.lit(f"_{number}")).alias("name"))
        for file in sinks.publish_files(named, f"{root}/in"):
            if int(re.search(r"(\d+)_\d+$", file)[1]) % 5 == 0:  # the day
                folders.set_modified(spark, file, (started - 3600) * 1000)

    def start():
        lines = directory.directory_lines(
            spark, f"{root}/in", directory.fresh_by_name(F.lit(FRESH_FROM_S)), start_s=started - 60
        )
        return directory.to_two_sinks(lines, f"{root}/lines", f"{root}/unreadable")

    runs.replay(_message_slices(spark, sf_dir, 2), deliver, start, f"{root}/checkpoint")


def stream_fresh_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files that are fresh by the time in their own name and were written after the stream began."""
    root = scratch_dir(spark, "fresh-lines")
    _watch_directory(spark, sf_dir, root)
    return sinks.kept_batches(spark, f"{root}/lines").select("name", "line")


def stream_unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the files of the same stream that hold no time."""
    root = scratch_dir(spark, "unreadable-files")
    _watch_directory(spark, sf_dir, root)
    return sinks.kept_batches(spark, f"{root}/unreadable").select("name")


def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest log lines of all that arrived, after each micro-batch."""
    root = scratch_dir(spark, "log-tail")
    action = tail.NewestRows(f"{root}/kept", [F.desc("ts"), F.desc("line_no")])

    def deliver(part: DataFrame, number: int) -> None:
        part.write.parquet(f"{root}/in/slice-{number}")

    def start():
        stream = spark.readStream.schema("line_no bigint, run_id bigint, ts timestamp_ntz, line string").parquet(f"{root}/in/*")
        return sinks.for_each_batch(stream, action)

    runs.replay(runs.time_slices(tables.log_lines(spark, sf_dir), SLICES), deliver, start, f"{root}/checkpoint")
    return action.kept(spark).select(F.col("batch_id").cast("bigint").alias("batch_id"), "line_no", "run_id", "line")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour, those that came in time and those that came too late: errors arrive one slice after the others."""
    root = scratch_dir(spark, "late-rows")
    action = late.LateRows(f"{root}/out", 3600, 3600)
    slices = [s.select("ts", "event_type") for s in runs.time_slices(tables.events(spark, sf_dir), SLICES)]
    is_error = F.col("event_type") == "error"
    none = slices[0].limit(0)
    moved = [
        on_time.where(~is_error).unionByName(before.where(is_error))
        for on_time, before in zip([*slices, none], [none, *slices])
    ]

    def deliver(part: DataFrame, number: int) -> None:
        part.write.parquet(f"{root}/in/slice-{number}")

    def start():
        stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(f"{root}/in/*")
        return sinks.for_each_batch(stream, action)

    runs.replay(iter(moved), deliver, start, f"{root}/checkpoint")
    return action.totals(spark)


def stream_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per hour of event time, updated by each micro-batch."""
    root = scratch_dir(spark, "window-counts")

    def deliver(part: DataFrame, number: int) -> None:
        part.select("ts").write.parquet(f"{root}/in/slice-{number}")

    def start():
        stream = spark.readStream.schema("ts timestamp_ntz").parquet(f"{root}/in/*")
        counted = windows.windowed_counts(stream, "1 hour", lateness="1 hour")
        return sinks.keep_batches(counted, f"{root}/out", lambda batch: batch, mode="update")

    runs.replay(_message_slices(spark, sf_dir), deliver, start, f"{root}/checkpoint")
    return windows.newest_counts(sinks.kept_batches(spark, f"{root}/out"))


def stream_remember_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per micro-batch when files older than the remember window are ignored.

    The last slice arrives with files an hour older than the newest ones, outside a window of 60 seconds.
    """
    root = scratch_dir(spark, "remember")
    deliver_lines = _deliver_lines(root)

    def deliver(part: DataFrame, number: int) -> None:
        deliver_lines(part, number)
        if number == SLICES - 1:
            newest = folders.newest_modified(spark, f"{root}/in/slice-{number}")
            folders.set_modified(spark, f"{root}/in/slice-{number}", newest - 3_600_000)

    runs.replay(
        _message_slices(spark, sf_dir),
        deliver,
        lambda: sinks.count_batches(_line_stream(spark, root, maxFileAge=f"{settings.REMEMBER_SEC}s"), f"{root}/out"),
        f"{root}/checkpoint",
    )
    return sinks.kept_batches(spark, f"{root}/out").where(F.col("n") > 0).select("batch_id", "n")


def stream_clean_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines processed and lines still in the folder when files of finished micro-batches are deleted."""
    root = scratch_dir(spark, "clean-source")
    runs.replay(
        _message_slices(spark, sf_dir),
        _deliver_lines(root),
        lambda: sinks.count_batches(_line_stream(spark, root, cleanSource="delete"), f"{root}/out"),
        f"{root}/checkpoint",
    )
    none = F.lit(0).cast("bigint")
    processed = sinks.kept_batches(spark, f"{root}/out").select(F.col("n").alias("processed"), none.alias("still_there"))
    left = readers.read_lines(spark, f"{root}/in/*").agg(F.count(F.lit(1)).alias("still_there"))
    both = processed.unionByName(left.select(none.alias("processed"), "still_there"))
    return both.agg(F.sum("processed").alias("processed"), F.sum("still_there").alias("still_there"))


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch records of the micro-batches with messages of a stream over all messages; wall times are only checked to add up."""
    root = scratch_dir(spark, "progress")
    log = progress.ProgressLog(spark, f"{root}/events")
    spark.streams.addListener(log)
    try:
        queries = runs.replay(
            _message_slices(spark, sf_dir, 2),
            _deliver_lines(root),
            lambda: sinks.count_batches(_line_stream(spark, root), f"{root}/out"),
            f"{root}/checkpoint",
        )
        log.wait_for(queries)
    finally:
        spark.streams.removeListener(log)
    found = log.records(settings.BATCH_INTERVAL_SEC).where(F.col("run_id").isin([str(q.id) for q in queries]))
    adds_up = (F.col("total_delay_ms") == F.col("scheduling_ms") + F.col("processing_ms")) & (F.col("processing_ms") > 0)
    return found.where("records > 0").select("batch_id", "status", "records", adds_up.alias("adds_up"))


def stream_epoch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First decision of each epoch, found by a stream of changes, log lines and overlapping polls in the order of arrival."""
    root = scratch_dir(spark, "epochs")
    feed = epochs.observations(
        tables.changes(spark, sf_dir), tables.log_lines(spark, sf_dir), tables.batch_payloads(spark, sf_dir)
    )
    action = epochs.EpochOutcomes(f"{root}/state")

    def deliver(part: DataFrame, number: int) -> None:
        part.write.parquet(f"{root}/in/slice-{number}")

    def start():
        stream = spark.readStream.schema(epochs.OBSERVATIONS).parquet(f"{root}/in/*")
        return sinks.for_each_batch(epochs.timeline(stream, bucket_sec=KNOWN_SPAN_SEC), action)

    runs.replay(runs.time_slices(feed, 3), deliver, start, f"{root}/checkpoint")
    return action.outcomes(spark)


def stream_completed_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delay of each batch from a stream of overlapping polls."""
    root = scratch_dir(spark, "delays")
    schema = "fetch_id bigint, run_id bigint, ts timestamp_ntz, payload string"

    def deliver(part: DataFrame, number: int) -> None:
        part.select("fetch_id", "run_id", "ts", "payload").write.parquet(f"{root}/in/slice-{number}")

    def start():
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        return sinks.keep_batches(wins.first_delays(stream, bucket_sec=KNOWN_SPAN_SEC), f"{root}/out", lambda batch: batch)

    runs.replay(runs.time_slices(tables.batch_payloads(spark, sf_dir), SLICES), deliver, start, f"{root}/checkpoint")
    return sinks.kept_batches(spark, f"{root}/out").drop("batch_id")


STREAM_QUERIES = (
    foreach_batch_counts,
    stream_line_count,
    stream_word_count,
    stream_fresh_lines,
    stream_unreadable_files,
    stream_log_tail,
    stream_late_rows,
    stream_batch_counts,
    stream_remember_window,
    stream_clean_source,
    progress_log,
    stream_epoch_outcomes,
    stream_completed_delays,
)
