"""Decisions on a stream: what each run knew at each poll, kept from micro-batch to micro-batch.

Two kinds of state are kept. Which delays and listings are known already lies in Spark's state store (``streaming.wins``), so a batch that
overlapping polls list again counts once, whenever it arrives. The totals of each run since its last change are a table that each
micro-batch writes under its number: a run may hold a large part of a micro-batch, so its rows are not handed to one Python
function but reduced with the batch operators, and its totals enter as one more row at the front of its series. A micro-batch
that is repeated after a failure reads the totals before it again and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.operators import decisions as dec
from tidegauge.sources import folders
from tidegauge.streaming import wins

OBSERVATIONS = (
    "run_id bigint, ts timestamp_ntz, kind string, id bigint, frequency bigint, message_bytes bigint, line string, payload string"
)

_TOTALS = ["delays", "delay_ms", "slow", "newest_sec", "newest_ms"]
STATE = "run_id bigint, " + ", ".join(f"{c} bigint" for c in [*dec.EPOCH, *_TOTALS]) + ", decided boolean"
OUTCOMES = (
    "run_id bigint, change_us bigint, change_id bigint, frequency bigint, message_bytes bigint, poll_us bigint, fetch_id bigint, "
    "rule int, new_frequency bigint, reason string"
)


def observations(changes: DataFrame, log_lines: DataFrame, fetches: DataFrame) -> DataFrame:
    """Changes, log lines and polls as one raw feed in the order of ``ts``, their time of arrival."""
    shape = dict(part.split() for part in OBSERVATIONS.split(", "))

    def rows(df: DataFrame, kind: str, number: str) -> DataFrame:
        given = {c: F.col(c) for c in df.columns if c in shape} | {"kind": F.lit(kind), "id": F.col(number)}
        return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in shape.items()])

    return (
        rows(changes, "change", "change_id")
        .unionByName(rows(log_lines, "log", "line_no"))
        .unionByName(rows(fetches, "fetch", "fetch_id"))
    )


def timeline(
    feed: DataFrame, keep_sec: int = dec.KEEP_SEC, lateness: str = wins.LATENESS, bucket_sec: int = wins.BUCKET_SEC
) -> DataFrame:
    """The stream of observations as a stream of timeline rows; telemetry that was known before is left out."""
    kind = F.col("kind")
    changes = feed.where(kind == "change").withColumnRenamed("id", "change_id")
    logs = feed.where(kind == "log").select("run_id", "ts", F.col("id").alias("line_no"), "line")
    fetches = feed.where(kind == "fetch").select("run_id", "ts", F.col("id").alias("fetch_id"), "payload")
    seen = (
        dec.delay_sightings(fetches, keep_sec)
        .withColumn("kind", F.lit(dec.DELAY))
        .unionByName(dec.slow_sightings(logs, keep_sec=keep_sec).withColumn("kind", F.lit(dec.PAUSE)))
    )
    known = wins.newly_known(seen, keep_sec, lateness, bucket_sec)
    is_delay = F.col("kind") == dec.DELAY
    sec, value = F.col("of_sec"), F.col("value")
    told = dec.timeline_rows(
        known,
        dec.DELAY,
        us=F.col("us"),
        tie=F.col("tie"),
        of_sec=sec,
        delays=is_delay.cast("bigint"),
        delay_ms=F.when(is_delay, value),
        newest_sec=F.when(is_delay, sec),
        newest_ms=F.when(is_delay, value),
        slow=F.when(is_delay, 0).otherwise(value),
        **{"kind": F.col("kind"), "class": F.when(is_delay, dec.DELAY).otherwise(dec.PAUSE)},
    )
    return told.unionByName(dec.change_rows(changes)).unionByName(dec.poll_rows(fetches))


def _carried(state: DataFrame) -> DataFrame:
    """The totals of each run as a timeline row at the time of its last change."""
    columns = {c: F.col(c) for c in [*dec.EPOCH, *_TOTALS]}
    return dec.timeline_rows(state, dec.CARRIED, us=F.col("change_us"), tie=F.col("change_id"), **columns)


def _next_state(rows: DataFrame, decided: DataFrame, warmup_sec: int) -> DataFrame:
    """Totals of the newest epoch of each run, and whether the epoch has its outcome. ``rows`` have epochs; the totals before are among them."""
    settled = dec.is_settled(warmup_sec)

    def total(column: str):
        return F.sum(F.when(settled, F.col(column))).alias(column)

    newest = F.max(F.when(settled & F.col("newest_sec").isNotNull(), F.struct("newest_sec", "newest_ms")))
    epochs = (
        rows.groupBy("run_id", *dec.EPOCH)
        .agg(total("delays"), total("delay_ms"), total("slow"), newest.alias("n"))
        .select("run_id", *dec.EPOCH, "delays", "delay_ms", "slow", "n.*")
    )
    state = epochs.groupBy("run_id").agg(F.max(F.struct(*dec.EPOCH, *_TOTALS)).alias("s")).select("run_id", "s.*")
    flag = decided.distinct().withColumn("decided", F.lit(True))
    epoch = ["run_id", "change_us", "change_id"]
    return state.join(flag, epoch, "left").withColumn("decided", F.coalesce("decided", F.lit(False)))


@contextmanager
def _adaptive(spark: SparkSession) -> Iterator[None]:
    """Turns adaptive execution on: Spark keeps it off in the session of a stream, since its state needs a fixed number of partitions.

    What an action reads from written tables holds no such state. Without it, every shuffle of a micro-batch takes all shuffle partitions.
    """
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class EpochOutcomes:
    """Action for each micro-batch of timeline rows: writes the outcomes it finds and the totals it leaves.

    Rows of a run count in the order of their arrival. One that comes in a later micro-batch than its time of arrival suggests counts
    from there on, if its epoch still lasts.
    """

    def __init__(
        self, folder: str, warmup_sec: int = settings.WARMUP_SEC, wait_batches: int = dec.WAIT_BATCHES
    ):
        self.folder = folder
        self.warmup_sec = warmup_sec
        self.wait_batches = wait_batches

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/batch_id={batch_id}"

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        # Written once: the stream is read a single time.
        rows.write.mode("overwrite").parquet(self._path("timeline", batch_id))
        with _adaptive(spark):
            self._reduce(spark.read.schema(dec.TIMELINE).parquet(self._path("timeline", batch_id)), batch_id)

    def _reduce(self, rows: DataFrame, batch_id: int) -> None:
        """Outcomes and totals of one micro-batch, from its written rows and the totals before it."""
        spark = rows.sparkSession
        epoch = ["run_id", "change_us", "change_id"]
        before = None
        if batch_id > 0:
            if not folders.exists(spark, self._path("state", batch_id - 1)):
                raise FileNotFoundError(f"the state of micro-batch {batch_id - 1} is missing: {self.folder}")
            before = spark.read.schema(STATE).parquet(self._path("state", batch_id - 1))
            if rows.isEmpty():  # Spark also runs batches that only move the watermark
                self._finish(before, batch_id)
                return
            rows = rows.unionByName(_carried(before))

        # Written once: outcomes and totals both start from the rows with their epochs.
        known = dec.with_epochs(rows).where(F.col("change_us").isNotNull())
        known.write.mode("overwrite").parquet(self._path("epochs", batch_id))
        rows = spark.read.schema(known.schema).parquet(self._path("epochs", batch_id))
        decided = dec.decision_columns(dec.decide(dec.totals_since_change(rows, self.warmup_sec), self.wait_batches))
        outcomes = dec.epoch_outcomes(decided)
        if before is not None:
            done = before.where("decided").select(*epoch)
            outcomes = outcomes.join(done, epoch, "left_anti")
        outcomes.write.mode("overwrite").parquet(self._path("outcomes", batch_id))

        found = spark.read.schema(OUTCOMES).parquet(self._path("outcomes", batch_id)).select(*epoch)
        if before is not None:
            found = found.unionByName(done)
        self._finish(_next_state(rows, found, self.warmup_sec), batch_id)

    def _finish(self, state: DataFrame, batch_id: int) -> None:
        spark = state.sparkSession
        state.write.mode("overwrite").parquet(self._path("state", batch_id))
        for table in ("state", "timeline", "epochs"):
            folders.remove(spark, self._path(table, batch_id - 2))

    def outcomes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(OUTCOMES).parquet(f"{self.folder}/outcomes").drop("batch_id")
