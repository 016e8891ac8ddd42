"""Messages made from parameter settings, and the check that they read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.functions import messages as msg
from tidegauge.operators.counts import batch_start


def with_line(df: DataFrame) -> DataFrame:
    """Adds ``line`` from cpu_pause_ms, message_bytes and name; NULL where the size cannot hold the header."""
    return (
        df.withColumn("_header", msg.render_header(F.col("cpu_pause_ms"), F.col("name")))
        .withColumn("line", msg.pad_message(F.col("_header"), F.col("message_bytes")))
        .drop("_header")
    )


# Bytes of messages that one row of settings is made into at a time.
_BLOCK_BYTES = 64_000_000


def one_second(params: DataFrame, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """The messages of one second per setting: ``int(1 / period_sec)`` of each, with numbered names.

    Needs unix_sec, cpu_pause_ms, message_bytes, period_sec; settings that send none in a second give no rows.
    Settings are dealt out to all tasks in blocks of about ``block_bytes``, before the messages are made.
    """
    spark = params.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = params.withColumn("_count", msg.whole_rate(F.col("period_sec"))).where(F.col("_count") >= 1)
    size = F.greatest(F.col("message_bytes"), F.lit(1))
    step = F.greatest(F.lit(1), F.least(F.floor(F.lit(block_bytes) / size), F.col("_count"))).cast("int")
    blocks = counted.withColumn("_step", step).withColumn("_first", F.explode(F.sequence(F.lit(1), F.col("_count"), F.col("_step"))))
    last = F.least(F.col("_count"), F.col("_first") + F.col("_step") - 1)
    numbered = (
        blocks.repartition(tasks)
        .withColumn("seq", F.explode(F.sequence(F.col("_first"), last)))
        .drop("_count", "_step", "_first")
    )
    return with_line(numbered.withColumn("name", msg.file_name(F.col("unix_sec"), F.col("seq"))))


def sweep_settings(spark: SparkSession, sizes: list[int] | None = None, frequency: int = 1) -> DataFrame:
    """The settings a search starts from, one per message size, largest first: big messages are the likelier to work."""
    ordered = sorted(sizes or settings.MESSAGE_SIZES, reverse=True)
    rows = [(size, settings.DEFAULT_PARAMS["cpu_pause_ms"], 1.0 / frequency) for size in ordered]
    return spark.createDataFrame(rows, "message_bytes bigint, cpu_pause_ms int, period_sec double")


def numbered_messages(
    spark: SparkSession,
    count: int,
    start_sec: int,
    cpu_pause_ms: int = settings.DEFAULT_PARAMS["cpu_pause_ms"],
    message_bytes: int = settings.DEFAULT_PARAMS["message_bytes"],
    period_sec: float = settings.DEFAULT_PARAMS["period_sec"],
) -> DataFrame:
    """``count`` messages at a fixed setting, spread evenly over time from ``start_sec``."""
    sent = F.lit(start_sec) + F.floor(F.col("id") * F.lit(period_sec)).cast("bigint")
    return _at_setting(spark.range(count), F.col("id"), sent, cpu_pause_ms, message_bytes)


def message_stream(
    spark: SparkSession,
    rows_per_batch: int,
    cpu_pause_ms: int = settings.DEFAULT_PARAMS["cpu_pause_ms"],
    message_bytes: int = settings.DEFAULT_PARAMS["message_bytes"],
    interval_sec: int = settings.BATCH_INTERVAL_SEC,
    partitions: int | None = None,
) -> DataFrame:
    """The same messages as an endless stream, ``rows_per_batch`` for every interval of stream time."""
    source = spark.readStream.format("rate-micro-batch").options(
        rowsPerBatch=rows_per_batch, advanceMillisPerBatch=interval_sec * 1000
    )
    if partitions:
        source = source.option("numPartitions", partitions)
    sent = F.unix_seconds("timestamp")
    return _at_setting(source.load(), F.col("value"), sent, cpu_pause_ms, message_bytes)


def _at_setting(df: DataFrame, counter, sent, cpu_pause_ms: int, message_bytes: int) -> DataFrame:
    return with_line(
        df.select(
            counter.alias("seq"),
            F.lit(cpu_pause_ms).alias("cpu_pause_ms"),
            F.lit(message_bytes).cast("bigint").alias("message_bytes"),
            msg.file_name(sent, counter).alias("name"),
        )
    )


def rejected_settings(df: DataFrame) -> DataFrame:
    """Settings whose size cannot hold the header or cannot be padded in full."""
    return with_line(df).where(F.col("line").isNull()).drop("line")


def roundtrip_check(messages: DataFrame) -> DataFrame:
    """Per size: messages, and how many have a wrong number of bytes or a wrong cost on reading back."""
    checked = messages.select(
        "message_bytes",
        (F.octet_length("line") == F.col("message_bytes")).alias("length_ok"),
        msg.cost_ms(F.col("line")).eqNullSafe(F.col("cpu_pause_ms")).alias("cost_ok"),
    )
    return checked.groupBy("message_bytes").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(~F.col("length_ok")).alias("bad_length"),
        F.count_if(~F.col("cost_ok")).alias("bad_cost"),
    )


def reuse_by_setting(messages: DataFrame, interval_sec: int = settings.FILE_REPORT_SEC, ts: str = "ts") -> DataFrame:
    """Per report interval and parameter setting: the first message and how many may reuse its content."""
    key = msg.params_key(F.col("cpu_pause_ms"), F.col("message_bytes"), F.col("period_sec"))
    return (
        messages.withColumn("params_key", key)
        .groupBy(batch_start(ts, interval_sec).alias("interval_start_s"), "params_key")
        .agg(F.min("msg_id").alias("first_msg_id"), (F.count(F.lit(1)) - 1).alias("reused"))
    )
