"""Counts per micro-batch. A batch is a tumbling window, so results can be replayed.

Every group is counted on the map side first, so a batch or source that holds most rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.functions import times
from tidegauge.functions.messages import cost_ms
from tidegauge.operators import ordered

# Batches of one span are laid out by one task: about a day of five-second batches.
_SPAN_BATCHES = 16_384


def batch_start(ts: str, interval_sec: int) -> Column:
    """Start of the batch of a row, in unix seconds. Batches start at multiples of their length."""
    sec = times.seconds(F.col(ts))
    return sec - F.pmod(sec, F.lit(interval_sec))


def batch_counts(rows: DataFrame, interval_sec: int, ts: str = "ts") -> DataFrame:
    """Rows per non-empty batch: batch_start_s, n."""
    return rows.groupBy(batch_start(ts, interval_sec).alias("batch_start_s")).agg(F.count(F.lit(1)).alias("n"))


def batch_counts_filled(rows: DataFrame, interval_sec: int, ts: str = "ts") -> DataFrame:
    """Rows per batch with zero for every empty batch between the first and the last.

    The batches are laid out in two steps (spans, then batches of a span), so no task writes them all. The number of
    tasks is given, because adaptive execution would merge the few bytes of the spans into one task again.
    """
    counted = batch_counts(rows, interval_sec, ts)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    bounds = rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(
        *[(F.floor(times.seconds(F.col(c)) / interval_sec).cast("bigint")).alias(c) for c in ("lo", "hi")]
    )
    spans = (
        bounds.where(F.col("lo").isNotNull())
        .select("hi", F.explode(F.sequence("lo", "hi", F.lit(_SPAN_BATCHES).cast("bigint"))).alias("first"))
        .repartition(tasks, "first")
    )
    last = F.least(F.col("hi"), F.col("first") + _SPAN_BATCHES - 1)
    spine = spans.select(F.explode(F.sequence("first", last)).alias("batch_no"))
    return (
        spine.select((F.col("batch_no") * interval_sec).alias("batch_start_s"))
        .join(counted, "batch_start_s", "left")
        .select("batch_start_s", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    )


def interval_message_count(
    messages: DataFrame, interval_sec: int = settings.TCP_REPORT_SEC, by: list[str] | None = None, ts: str = "ts"
) -> DataFrame:
    """Messages per report interval, for each source unless ``by`` says otherwise."""
    keys = ["source_id"] if by is None else by
    start = batch_start(ts, interval_sec).alias("interval_start_s")
    return messages.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("messages"))


def running_message_count(messages: DataFrame, interval_sec: int, ts: str = "ts") -> DataFrame:
    """Messages sent by each source from the start to the end of each interval it sent in.

    Counting comes first; the running sum sees one row per source and interval, whatever the traffic.
    """
    counted = interval_message_count(messages, interval_sec, ts=ts)
    window = (
        Window.partitionBy("source_id").orderBy("interval_start_s").rowsBetween(Window.unboundedPreceding, 0)
    )
    return counted.withColumn("messages_all_time", F.sum("messages").over(window))


def batch_preview(
    rows: DataFrame, interval_sec: int, order: str, limit: int = settings.PREVIEW_ROWS, ts: str = "ts"
) -> DataFrame:
    """The first rows of every batch. The limit is applied before the shuffle and again after it."""
    window = Window.partitionBy("batch_start_s").orderBy(order)
    return (
        rows.withColumn("batch_start_s", batch_start(ts, interval_sec))
        .withColumn("row_in_batch", F.row_number().over(window))
        .where(F.col("row_in_batch") <= limit)
    )


def overrun_report(messages: DataFrame, target_us: Column, span: int = ordered.HOUR_US) -> DataFrame:
    """Per message: time since the one before from the same source and by how much it missed the target.

    The first message of a source has no elapsed time and no overrun.
    """
    series = ordered.Series(["source_id"], "sent_us", ["msg_id"], span)
    sent = messages.withColumn("sent_us", times.micros(F.col("ts")))
    elapsed = F.col("sent_us") - F.col("previous_us")
    return (
        ordered.previous(sent, series, "previous_us")
        .withColumn("elapsed_us", elapsed)
        .withColumn("overrun_us", F.greatest(F.lit(0).cast("bigint"), F.col("elapsed_us") - target_us))
    )


def offered_load(messages: DataFrame, interval_sec: int, cores: int, ts: str = "ts", line: str = "line") -> DataFrame:
    """CPU time the messages of a batch ask for, against what ``cores`` can give in it."""
    start = batch_start(ts, interval_sec).alias("batch_start_s")
    return (
        messages.groupBy(start)
        .agg(F.sum(cost_ms(F.col(line)).cast("bigint")).alias("cost_ms"))
        .withColumn("load", F.col("cost_ms") / F.lit(float(interval_sec * 1000 * cores)))
    )
