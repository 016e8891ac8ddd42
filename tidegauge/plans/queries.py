"""Every operator as a query over the given tables: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.functions import messages as msg
from tidegauge.functions import times
from tidegauge.operators import counts, decisions, files, generate, lines, params, reduce, scaling, telemetry, words
from tidegauge.plans import streams
from tidegauge.session import scratch_dir
from tidegauge.sources import readers, tables
from tidegauge.streaming import sinks

# Moments the queries are asked for; results must not depend on the clock.
NOW_S = 1_704_931_200  # 2024-01-11 00:00:00 UTC

# The tables hold about one event in four minutes at the smallest useful size, so batches are longer than live ones.
BATCH_SEC = 300
HOUR = 3600
DAY = 86_400
CORES = 8

Query = Callable[[SparkSession, str], DataFrame]


def _batch_ts(ts: str = "ts"):
    return times.seconds(F.col(ts))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count(tables.documents(spark, sf_dir), words.words_of_text(F.col("text")))


def reduce_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same count by a function of the user's."""
    # A row group is read by one task, and may hold most documents; Python counts them in all tasks.
    spread = tables.documents(spark, sf_dir).select("doc_id", "text").repartition("doc_id", "text")
    found = spread.select(F.explode(words.words_of_text(F.col("text"))).alias("word"))
    ones = found.withColumn("n", F.lit(1).cast("bigint"))
    return reduce.reduce_by_key(ones, ["word"], "n", lambda a, b: a + b)


def reduce_cost_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bits the costs of each source have, by a function of the user's."""
    costs = tables.messages(spark, sf_dir).select("source_id", F.col("cpu_pause_ms").cast("bigint").alias("bits"))
    return reduce.reduce_by_key(costs, ["source_id"], "bits", lambda a, b: a | b)


def word_count_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count_per_batch(tables.log_lines(spark, sf_dir), HOUR)


# Messages and files


def generate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    setting = tables.changes(spark, sf_dir).select(
        "change_id",
        _batch_ts().alias("unix_sec"),
        F.lit(settings.DEFAULT_PARAMS["cpu_pause_ms"]).alias("cpu_pause_ms"),
        "message_bytes",
        msg.period_of(F.col("frequency")).alias("period_sec"),
    )
    return generate.one_second(setting).select("change_id", "seq", "name", "cpu_pause_ms", "message_bytes", "line")


def parse_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.parse_cost(tables.messages(spark, sf_dir).select("msg_id", "line"))
    return found.select("msg_id", "cpu_pause_ms", "pause_sec", "line_length")


def parse_cost_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.map_lines(
        tables.messages(spark, sf_dir).select("msg_id", "line"), lines.cost_by_slicing(), "int", "cpu_pause_ms"
    )
    return found.select(
        "msg_id",
        "cpu_pause_ms",
        msg.to_seconds(F.col("cpu_pause_ms")).alias("pause_sec"),
        F.length("line").alias("line_length"),
    )


def parse_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.parse_header(tables.messages(spark, sf_dir).select("msg_id", "line")).drop("line")


def roundtrip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.roundtrip_check(tables.messages(spark, sf_dir))


def message_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).select("event_id", tables.event_name().alias("name"))


def message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).select(
        "event_id", msg.message_id(times.micros(F.col("ts")), F.col("event_id")).alias("id")
    )


def params_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = (tables.tag_number() % 4 + 1) / F.lit(4.0)
    sent = tables.events(spark, sf_dir).select(
        F.col("event_id").alias("msg_id"),
        "ts",
        (tables.tag_number() % 5).alias("cpu_pause_ms"),
        tables.size_bytes().alias("message_bytes"),
        period.alias("period_sec"),
    )
    return generate.reuse_by_setting(sent, DAY)


def effective_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = msg.period_of(F.col("frequency"))
    return tables.changes(spark, sf_dir).select(
        "change_id", "frequency", period.alias("period_sec"), msg.whole_rate(period).alias("per_second")
    )


def visible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.visible_files(tables.files(spark, sf_dir)).select("event_id", "name")


def fresh_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = files.fresh_files(tables.files(spark, sf_dir), F.lit(NOW_S))
    return fresh.select("event_id", "name", msg.name_seconds(F.col("name")).alias("name_s"))


def unreadable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unreadable_names(tables.files(spark, sf_dir)).select("event_id", "name")


def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.expired_files(tables.files(spark, sf_dir), F.lit(NOW_S))


def new_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.new_files(tables.files(spark, sf_dir), F.lit(NOW_S))


# Counts per batch


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.batch_counts(tables.messages(spark, sf_dir), BATCH_SEC)


def batch_counts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.batch_counts_filled(tables.messages(spark, sf_dir), BATCH_SEC)


def running_message_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.running_message_count(tables.messages(spark, sf_dir), HOUR)


def interval_message_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.interval_message_count(tables.messages(spark, sf_dir))


def report_message_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a sender that writes files: all messages per report interval."""
    sent = tables.messages(spark, sf_dir)
    return counts.interval_message_count(sent, settings.FILE_REPORT_SEC, by=[])


def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.batch_preview(tables.messages(spark, sf_dir).select("msg_id", "ts", "line"), HOUR, "msg_id")
    return found.select("batch_start_s", "row_in_batch", "msg_id", "line")


def overrun_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = (F.col("cpu_pause_ms") + 1).cast("bigint") * 600_000_000
    sent = tables.messages(spark, sf_dir).select("msg_id", "source_id", "ts", "cpu_pause_ms")
    return counts.overrun_report(sent, target).select("msg_id", "source_id", "elapsed_us", "overrun_us")


def offered_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.offered_load(tables.messages(spark, sf_dir), BATCH_SEC, CORES)


# Telemetry


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.batch_records(tables.batch_payloads(spark, sf_dir))


def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.completed_delays(_records(spark, sf_dir))


def _pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.listing_pauses(tables.log_lines(spark, sf_dir))


def batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("fetch_id", "run_id", "batch_id", "batch_ts", "status", "total_delay_ms")


def statistics_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.statistics_records(tables.statistics_payloads(spark, sf_dir))


def app_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.app_records(tables.app_payloads(spark, sf_dir)).select(
        "fetch_id", "app_id", "name", "startTime", "duration", "sparkUser", "completed", "startTimeEpoch"
    )


def parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.log_records(tables.log_lines(spark, sf_dir)).drop("ts", "line")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest_first = [F.desc("ts"), F.desc("line_no")]
    found = readers.log_tail(tables.log_lines(spark, sf_dir), newest_first, settings.LOG_TAIL_LINES)
    return found.select("line_no", "run_id", "line")


def file_listing_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pauses(spark, sf_dir).withColumn("pause_sec", msg.to_seconds(F.col("pause_ms")))


def app_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.app_log_lines(tables.log_lines(spark, sf_dir)).select(
        "line_no", "run_id", "timestamp_unix", "message"
    )


def slow_listing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.slow_listing_flags(_pauses(spark, sf_dir))


def completed_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delays(spark, sf_dir)


def unfinished_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.unfinished_batches(_records(spark, sf_dir), F.lit(NOW_S).cast("bigint"))


def post_warmup_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.post_warmup_delays(tables.changes(spark, sf_dir), _delays(spark, sf_dir))


def delay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.delay_stats(_delays(spark, sf_dir))


def longest_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.longest_delays(_delays(spark, sf_dir))


def latest_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.latest_delay(_delays(spark, sf_dir))


def ordered_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.ordered_delays(_delays(spark, sf_dir))


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("total_delay_ms") >= 0, F.col("total_delay_ms"))
    scheduling = F.floor(known / 25).cast("bigint")
    timed = telemetry.newest_records(_records(spark, sf_dir)).withColumns(
        {"records": F.col("batch_id") % 100, "scheduling_ms": scheduling, "processing_ms": known - scheduling}
    )
    return telemetry.run_statistics(timed, settings.BATCH_INTERVAL_SEC)


# Parameters and decisions


def param_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = readers.param_patches(tables.control_messages(spark, sf_dir))
    return params.merged_params(patches).drop("ts")


def params_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = tables.messages(spark, sf_dir).select("msg_id", "source_id", "ts")
    return params.params_as_of(sent, tables.changes(spark, sf_dir)).drop("ts")


def params_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``params_as_of``, for a sender that looks for new settings once a day."""
    sent = tables.messages(spark, sf_dir).select("msg_id", "source_id", "ts")
    return params.params_as_of(sent, tables.changes(spark, sf_dir), hold_sec=DAY).drop("ts")


def throughput_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.throughput_decisions(
        tables.changes(spark, sf_dir), tables.log_lines(spark, sf_dir), tables.batch_payloads(spark, sf_dir)
    )


def full_run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``throughput_decisions``, for a full run, which waits for more batches after each change."""
    return decisions.throughput_decisions(
        tables.changes(spark, sf_dir),
        tables.log_lines(spark, sf_dir),
        tables.batch_payloads(spark, sf_dir),
        wait_batches=decisions.WAIT_BATCHES_FULL,
    )


def epoch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.epoch_outcomes(throughput_decisions(spark, sf_dir))


def max_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.max_throughput(epoch_outcomes(spark, sf_dir))


# Run time against number of containers


def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.bench_rows(tables.bench_lines(spark, sf_dir))


def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.run_durations(bench_rows(spark, sf_dir))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.result_rows(scaling.printed_results(run_durations(spark, sf_dir)))


def scaling_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.scaling_curve(result_rows(spark, sf_dir))


# Written and read back


def append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run durations appended under two run stamps and read back."""
    path = scratch_dir(spark, "results")
    found = run_durations(spark, sf_dir).select("run_id", "container_count", "net_sec")
    for day in (1, 2):
        sinks.append_results(found, path, sinks.run_stamp(datetime(2024, 1, day)))
    schema = "run_id bigint, container_count int, net_sec double, run_stamp string"
    return spark.read.schema(schema).json(path)


def publish_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "messages")
    sinks.publish_messages(tables.messages(spark, sf_dir).select("line"), path)
    return readers.read_lines(spark, path).select("line")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        word_count,
        word_count_per_batch,
        reduce_word_count,
        reduce_cost_bits,
        generate_messages,
        parse_cost,
        parse_cost_udf,
        parse_header,
        roundtrip_check,
        message_filenames,
        message_ids,
        params_key,
        effective_rate,
        visible_files,
        fresh_files,
        unreadable_names,
        expired_files,
        new_files_only,
        batch_counts,
        batch_counts_filled,
        running_message_count,
        interval_message_count,
        report_message_count,
        batch_preview,
        overrun_report,
        offered_load,
        batch_records,
        statistics_records,
        app_records,
        parse_log,
        log_tail,
        file_listing_pauses,
        app_log_lines,
        slow_listing_flags,
        completed_delays,
        unfinished_batches,
        post_warmup_delays,
        delay_stats,
        longest_delays,
        latest_delay,
        ordered_delays,
        run_statistics,
        param_patches,
        params_as_of,
        params_held,
        throughput_decisions,
        full_run_decisions,
        epoch_outcomes,
        max_throughput,
        bench_rows,
        run_durations,
        result_rows,
        scaling_curve,
        append_results,
        publish_messages,
        *streams.STREAM_QUERIES,
    )
}
