"""Batch delays and listing pauses of a run: clean series and summaries.

Delays and pauses are reduced to one value per run and second first, counted on the map side. After that a run
has at most one row per second of its life, however many records were fetched, and windows over a run stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.functions import logs, times


def is_known_delay(delay_ms: Column) -> Column:
    """A missing delay counts as -1, and negative ones are skipped."""
    return F.coalesce(delay_ms, F.lit(-1)) >= 0


def completed_delays(records: DataFrame) -> DataFrame:
    """run_id, batch_ts, delay_ms of completed batches; over repeated fetches the first value stays."""
    return (
        records.where((F.col("status") == "COMPLETED") & is_known_delay(F.col("total_delay_ms")))
        .where(F.col("batch_ts").isNotNull())  # times that don't parse belong to no batch
        .groupBy("run_id", "batch_ts")
        .agg(F.min_by("total_delay_ms", "fetch_id").alias("delay_ms"))
    )


def newest_records(records: DataFrame) -> DataFrame:
    """Each batch of a run once, as the last poll that listed it shows it."""
    shown = F.struct("status", "total_delay_ms")
    return (
        records.groupBy("run_id", "batch_id", "batch_ts")
        .agg(F.max_by(shown, "fetch_id").alias("r"))
        .select("run_id", "batch_id", "batch_ts", "r.*")
    )


def unfinished_batches(records: DataFrame, now: Column) -> DataFrame:
    """Per run, in its newest fetch: queued batches, whether they pile up, and the age of the oldest batch in progress.

    Earlier fetches say how things stood then; what they list as queued or in progress may be done by now.
    """
    age = F.when(F.col("status") == "PROCESSING", now - F.col("batch_ts"))
    fetches = records.groupBy("run_id", "fetch_id").agg(
        F.struct(F.count_if(F.col("status") == "QUEUED").alias("queued"), F.max(age).alias("age")).alias("found")
    )
    newest = fetches.groupBy("run_id").agg(F.max_by("found", "fetch_id").alias("found"))
    return newest.select(
        "run_id",
        F.col("found.queued").alias("queued"),
        (F.col("found.queued") > 1).alias("has_backlog"),
        F.greatest(F.lit(0).cast("bigint"), F.coalesce("found.age", F.lit(0))).alias("in_process_sec"),
    )


def _lines_of(lines: DataFrame, logger: str, text: str = "") -> DataFrame:
    """Lines of one logger with the time and the message; other lines are tested once and not taken apart.

    The line is tested in an explode, not in a filter: Spark would move a filter below the making of the line, and make the line
    again for each test in it and in later filters.
    """
    pattern = logs.message_pattern(logger, text)
    found = F.struct(
        times.log_time_seconds(F.substring("line", 1, 19)).alias("timestamp_unix"),
        F.regexp_extract("line", pattern, 1).alias("message"),
    )
    told = F.col("line").contains(text or logger) & F.col("line").rlike(pattern)
    tested = lines.withColumn("_found", F.explode_outer(F.array(F.when(told, found))))
    return tested.where(F.col("_found").isNotNull()).select(*lines.columns, "_found.*")


def listings(lines: DataFrame) -> DataFrame:
    """Adds sec and pause_ms to the lines that report a directory listing."""
    return (
        _lines_of(lines, settings.LISTING_LOGGER, settings.LISTING_TEXT)
        .withColumnRenamed("timestamp_unix", "sec")
        .withColumn("pause_ms", logs.first_integer(F.col("message")))
        .where(F.col("sec").isNotNull())
        .drop("message")
    )


def listing_pauses(lines: DataFrame) -> DataFrame:
    """run_id, ts, pause_ms of directory listings found in log lines; in one second the last line stays."""
    found = listings(lines).groupBy("run_id", F.col("sec").alias("ts"))
    return found.agg(F.max_by("pause_ms", "line_no").alias("pause_ms"))


def app_log_lines(lines: DataFrame) -> DataFrame:
    """Lines the application itself logged."""
    return _lines_of(lines, settings.APP_LOGGER)


def slow_listing_flags(pauses: DataFrame, limit_ms: int = settings.SLOW_LISTING_MS, allowed: int = 2) -> DataFrame:
    """Per run: slow listings, and whether there are more than allowed."""
    slow = F.count_if(F.col("pause_ms") > limit_ms)
    return pauses.groupBy("run_id").agg(slow.alias("slow_listings"), (slow > allowed).alias("listing_limit"))


def delay_stats(delays: DataFrame) -> DataFrame:
    """Per run: number, mean, sample variance and deviation of the delays, in seconds."""
    sec = F.col("delay_ms") / F.lit(1000.0)
    return delays.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("delay_ms") / F.count(F.lit(1)) / F.lit(1000.0)).alias("mean_sec"),
        F.round(F.var_samp(sec), 4).alias("variance"),
        F.round(F.stddev_samp(sec), 4).alias("stdev"),
    )


def longest_delays(delays: DataFrame) -> DataFrame:
    """Per run: the longest and the second longest delay (NULL for a single one)."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("delay_ms")))
    return (
        delays.withColumn("rank", rank)
        .where(F.col("rank") <= 2)
        .groupBy("run_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("delay_ms"))).alias("longest_ms"),
            F.max(F.when(F.col("rank") == 2, F.col("delay_ms"))).alias("second_longest_ms"),
        )
    )


def latest_delay(delays: DataFrame) -> DataFrame:
    return delays.groupBy("run_id").agg(
        F.max("batch_ts").alias("batch_ts"), F.max_by("delay_ms", "batch_ts").alias("delay_ms")
    )


def ordered_delays(delays: DataFrame) -> DataFrame:
    """Oldest first. Sorted by range, so a long run spreads over several tasks."""
    return delays.orderBy("run_id", "batch_ts")


def run_statistics(batches: DataFrame, batch_sec: int) -> DataFrame:
    """Per run: batch and record counts, records per second, and whole-millisecond averages of the known delays.

    Needs status, records, scheduling_ms, processing_ms; the total delay is the sum of the last two. A batch without
    a delay counts as a batch, but not in the averages.
    """
    done = F.col("status") == "COMPLETED"
    count = F.count_if(done)

    def average(column: Column) -> Column:
        known = F.when(done, column)
        return F.floor(F.try_divide(F.sum(known), F.count(known))).cast("bigint")

    records = F.coalesce(F.sum(F.when(done, F.col("records"))), F.lit(0))
    return batches.groupBy("run_id").agg(
        F.min("batch_ts").alias("start_s"),
        count.alias("completed_batches"),
        F.count_if(F.col("status") == "PROCESSING").alias("active_batches"),
        records.alias("processed_records"),
        F.try_divide(records.cast("double"), count * F.lit(batch_sec)).alias("avg_input_rate"),
        average(F.col("scheduling_ms")).alias("avg_scheduling_ms"),
        average(F.col("processing_ms")).alias("avg_processing_ms"),
        average(F.col("scheduling_ms") + F.col("processing_ms")).alias("avg_total_ms"),
    )
