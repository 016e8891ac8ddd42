"""Raise, lower or stop: what a run should do with its rate, decided at every poll from what was known by then.

A run is replayed in two times. Its series is ordered by arrival: changes of rate, polls, and the moments at which something
became known (a delay with the first poll that listed it, a listing pause with its log line). The other time is
the batch's or line's own: it decides whether that piece of telemetry is late enough after the change to count. So a later poll
never alters an earlier decision, and a poll that lists only a hanging batch is a decision too.

The series of a run is never in one window: ``operators.ordered`` cuts it into spans of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.functions import times
from tidegauge.operators import ordered
from tidegauge.operators.telemetry import is_known_delay, listings
from tidegauge.sources.readers import BATCH_RECORDS, batch_records

# Kinds of rows of a run. At one moment a change comes first, then what a poll made known, then the poll.
CARRIED, CHANGE, PAUSE, DELAY, POLL = -1, 0, 1, 2, 3

# Fixed thresholds in milliseconds of mean delay, and what each leads to.
_OVERLOAD_MS = 25_000
_EARLY_CUT_MS, _EARLY_CUT_COUNT = 10_000, 5
_STEPS_MS = {"x50": 50, "x5": 500, "x1.75": 2_500, "x1.03": 4_500, "limit": 5_000}

WAIT_BATCHES = 3
WAIT_BATCHES_FULL = 13

# Telemetry that arrives later than this after its own time is left out, so streams may forget what they have seen.
KEEP_SEC = 86_400

TIMELINE = (
    "run_id bigint, us bigint, class int, tie bigint, kind int, change_us bigint, change_id bigint, frequency bigint, "
    "message_bytes bigint, of_sec bigint, delays bigint, delay_ms bigint, slow bigint, newest_sec bigint, newest_ms bigint, "
    "in_process_ms bigint"
)
_COLUMNS = [part.split()[0] for part in TIMELINE.split(", ")]
_TYPES = dict(part.split() for part in TIMELINE.split(", "))
_ORDER = ["class", "tie", "kind"]
# Runs are cut into spans of a day: most runs have few polls in an hour, and every span adds a row to the series.
_SPAN_US = 86_400_000_000
EPOCH = ["change_us", "change_id", "frequency", "message_bytes"]


def timeline_rows(df: DataFrame, kind: int, /, **columns: Column) -> DataFrame:
    """Rows in timeline shape; columns not named are NULL, and the counters 0."""
    given = {"run_id": F.col("run_id"), "kind": F.lit(kind), "delays": F.lit(0), "slow": F.lit(0)}
    # the changes of a moment, then its log lines, then what its polls tell
    given["class"] = F.lit(min(kind, DELAY))
    given |= columns
    return df.select(*[given.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in _COLUMNS])


def change_rows(changes: DataFrame) -> DataFrame:
    """Every change of rate; of several at one moment the last one stays in force."""
    us = times.micros(F.col("ts"))
    return timeline_rows(
        changes,
        CHANGE,
        us=us,
        tie=F.col("change_id"),
        change_us=us,
        change_id=F.col("change_id"),
        frequency=F.col("frequency"),
        message_bytes=F.col("message_bytes"),
    )


def poll_rows(fetches: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each poll, whatever it listed, with the age of the oldest batch in progress at its time."""
    us = times.micros(F.col("ts"))
    # most polls list nothing in progress; a plain text test spares them the reading
    listed = F.when(F.col(payload).contains("PROCESSING"), F.from_json(payload, BATCH_RECORDS))
    busy = F.filter(listed, lambda r: r["status"] == "PROCESSING")
    oldest = F.array_min(F.transform(busy, lambda r: times.batch_time_seconds(r["batchTime"])))
    age_us = F.greatest(F.lit(0), F.coalesce(us - oldest * 1_000_000, F.lit(0)))
    # rounded up, so that it is over a limit of whole milliseconds exactly if the age is
    return timeline_rows(fetches, POLL, us=us, tie=F.col("fetch_id"), in_process_ms=-F.floor(-age_us / F.lit(1000)))


def _in_time(us: Column, keep_sec: int) -> Column:
    return us <= (F.col("of_sec") + keep_sec) * 1_000_000


def delay_sightings(fetches: DataFrame, keep_sec: int = KEEP_SEC) -> DataFrame:
    """run_id, of_sec, us, tie, value, ts: each known delay of a completed batch, as often as polls list it."""
    us = times.micros(F.col("ts"))
    return (
        batch_records(fetches)
        .where((F.col("status") == "COMPLETED") & is_known_delay(F.col("total_delay_ms")) & F.col("batch_ts").isNotNull())
        .select(
            "run_id",
            F.col("batch_ts").alias("of_sec"),
            us.alias("us"),
            F.col("fetch_id").alias("tie"),
            F.col("total_delay_ms").alias("value"),
            "ts",
        )
        .where(_in_time(F.col("us"), keep_sec))
    )


def slow_sightings(
    lines: DataFrame, limit_ms: int = settings.SLOW_LISTING_MS, keep_sec: int = KEEP_SEC
) -> DataFrame:
    """run_id, of_sec, us, tie, value, ts: each listing, 1 for a slow one; in one second the last line stays."""
    slow = F.coalesce((F.col("pause_ms") > limit_ms).cast("bigint"), F.lit(0))
    return (
        listings(lines)
        .select(
            "run_id",
            F.col("sec").alias("of_sec"),
            times.micros(F.col("ts")).alias("us"),
            F.col("line_no").alias("tie"),
            slow.alias("value"),
            "ts",
        )
        .where(_in_time(F.col("us"), keep_sec))
    )


def delay_rows(known: DataFrame) -> DataFrame:
    """From run_id, of_sec, us, tie, value, once for each batch: the delay, from when it was known."""
    sec, delay = F.col("of_sec"), F.col("value")
    return timeline_rows(
        known, DELAY, us=F.col("us"), tie=F.col("tie"), of_sec=sec, delays=F.lit(1), delay_ms=delay, newest_sec=sec, newest_ms=delay
    )


def pause_rows(altered: DataFrame) -> DataFrame:
    """From run_id, of_sec, us, tie, value: by how much a line alters the number of slow listings."""
    return timeline_rows(altered, PAUSE, us=F.col("us"), tie=F.col("tie"), of_sec=F.col("of_sec"), slow=F.col("value"))


def first_known(sightings: DataFrame) -> DataFrame:
    """The first sighting of each batch; counted on the map side first."""
    first = F.min(F.struct("us", "tie", "value")).alias("f")
    return sightings.groupBy("run_id", "of_sec").agg(first).select("run_id", "of_sec", "f.*")


def alterations(sightings: DataFrame) -> DataFrame:
    """Lines whose second was not slow and is now, or the other way round. A window holds the lines of one second."""
    before = F.lag("value", 1, 0).over(Window.partitionBy("run_id", "of_sec").orderBy("us", "tie"))
    changed = sightings.withColumn("value", F.col("value") - before)
    return changed.where(F.col("value") != 0)


def timeline(changes: DataFrame, lines: DataFrame, fetches: DataFrame, keep_sec: int = KEEP_SEC) -> DataFrame:
    return (
        change_rows(changes)
        .unionByName(poll_rows(fetches))
        .unionByName(delay_rows(first_known(delay_sightings(fetches, keep_sec))))
        .unionByName(pause_rows(alterations(slow_sightings(lines, keep_sec=keep_sec))))
    )


def with_epochs(rows: DataFrame) -> DataFrame:
    """Gives every row the newest change up to it, which names its epoch."""
    change = F.when(F.col("change_us").isNotNull(), F.struct(*EPOCH))
    series = ordered.Series(["run_id"], "us", _ORDER, _SPAN_US)
    return ordered.carry_last(rows, series, {"_epoch": change}).drop(*EPOCH).select("*", "_epoch.*").drop("_epoch")


def is_settled(warmup_sec: int = settings.WARMUP_SEC) -> Column:
    """True for carried state, and for telemetry whose own time is late enough after the change to show the new rate."""
    return (F.col("kind") == CARRIED) | (F.col("of_sec") * 1_000_000 > F.col("change_us") + warmup_sec * 1_000_000)


def since_change(rows: DataFrame, warmup_sec: int = settings.WARMUP_SEC) -> DataFrame:
    """Polls with n, sum, latest delay and slow listings since the change, after the warm-up, as known by then."""
    return totals_since_change(with_epochs(rows), warmup_sec)


def totals_since_change(rows: DataFrame, warmup_sec: int = settings.WARMUP_SEC) -> DataFrame:
    """``since_change`` of rows that have their epochs."""
    counting = rows.where(F.col("change_us").isNotNull() & ((F.col("kind") == POLL) | is_settled(warmup_sec)))
    # in_process_ms is NULL beside a delay. With it the ends of the spans need the same columns as the rows, so Spark orders the rows
    # of a run by epoch once for both; else it would drop that column for one of them and make the whole series again.
    newest = F.when(F.col("newest_sec").isNotNull(), F.struct("newest_sec", "newest_ms", "in_process_ms"))
    return (
        ordered.running(
            counting,
            ordered.Series(["run_id", "change_us", "change_id"], "us", _ORDER, _SPAN_US),
            sums={"n": F.col("delays"), "total_ms": F.col("delay_ms"), "slow_listings": F.col("slow")},
            greatest={"_newest": newest},
        )
        .where((F.col("kind") == POLL) & (F.col("n") > 0))
        .drop("newest_ms")
        .withColumn("newest_ms", F.col("_newest.newest_ms"))
    )


def _cut(frequency: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(frequency / 2)).cast("bigint")


def _grow(frequency: Column, factor: float) -> Column:
    return (F.floor(frequency * F.lit(factor)) + 1).cast("bigint")


def decide(points: DataFrame, wait_batches: int = WAIT_BATCHES) -> DataFrame:
    """Adds rule (1..10, the first that holds), new_frequency, reason (only for a stop) and whether it ends the epoch."""
    f, n, total = F.col("frequency"), F.col("n"), F.col("total_ms")

    def mean_below(ms: int) -> Column:
        return total < n * ms

    waited = n > wait_batches
    overload = ((f > 1) & (F.col("newest_ms") > _OVERLOAD_MS)) | (
        F.coalesce("in_process_ms", F.lit(0)) > _OVERLOAD_MS
    )
    rule = (
        F.when(overload, 1)
        .when((f > 1) & (F.col("slow_listings") > 2), 2)
        .when((n > _EARLY_CUT_COUNT) & (total > n * _EARLY_CUT_MS), 3)
        .when(waited & mean_below(_STEPS_MS["x50"]), 4)
        .when(waited & mean_below(_STEPS_MS["x5"]), 5)
        .when(waited & mean_below(_STEPS_MS["x1.75"]), 6)
        .when(waited & mean_below(_STEPS_MS["x1.03"]), 7)
        .when(waited & mean_below(_STEPS_MS["limit"]), 8)
        .when(waited, 9)
        .otherwise(10)
    )
    r = F.col("rule")
    new = (
        F.when(r.isin(1, 3, 9), _cut(f))
        .when(r == 4, f * 50)
        .when(r == 5, f * 5)
        .when(r == 6, _grow(f, 1.75))
        .when(r == 7, _grow(f, 1.03))
        .otherwise(f)
    )
    reason = F.when(r == 2, settings.LIMIT_FILE_LISTING).when(r == 8, settings.LIMIT_TOTAL_DELAY)
    return (
        points.withColumn("rule", rule)
        .withColumns({"new_frequency": new, "reason": reason})
        .withColumn("ends_epoch", F.col("reason").isNotNull() | (F.col("new_frequency") != f))
    )


def throughput_decisions(
    changes: DataFrame,
    lines: DataFrame,
    fetches: DataFrame,
    warmup_sec: int = settings.WARMUP_SEC,
    wait_batches: int = WAIT_BATCHES,
    keep_sec: int = KEEP_SEC,
) -> DataFrame:
    """A decision for each poll that knows at least one delay since the last change.

    ``changes`` hold change_id, run_id, ts, frequency, message_bytes; ``lines`` line_no, run_id, ts, line; ``fetches`` fetch_id, run_id, ts,
    payload. A payload that cannot be read is a poll that listed nothing.
    """
    points = since_change(timeline(changes, lines, fetches, keep_sec), warmup_sec)
    return decision_columns(decide(points, wait_batches))


def decision_columns(decided: DataFrame) -> DataFrame:
    return decided.select(
        "run_id",
        F.col("tie").alias("fetch_id"),
        F.col("us").alias("poll_us"),
        *EPOCH,
        "n",
        "total_ms",
        F.col("newest_ms").alias("latest_ms"),
        "slow_listings",
        "in_process_ms",
        "rule",
        "new_frequency",
        "reason",
        "ends_epoch",
    )


def epoch_outcomes(decisions: DataFrame) -> DataFrame:
    """The first decision of each epoch that stops or changes the rate."""
    taken = F.min(F.struct("poll_us", "fetch_id", "rule", "new_frequency", "reason"))
    epoch = [c for c in EPOCH if c in decisions.columns]
    return (
        decisions.where("ends_epoch").groupBy("run_id", *epoch).agg(taken.alias("d")).select("run_id", *epoch, "d.*")
    )


def max_throughput(outcomes: DataFrame) -> DataFrame:
    """Best rate at which a run stopped, for each message size, largest size first."""
    best = F.max(F.struct("frequency", "reason"))
    return (
        outcomes.where(F.col("reason").isNotNull())
        .groupBy("message_bytes")
        .agg(best.alias("b"))
        .select("message_bytes", "b.reason", "b.frequency", (F.col("b.frequency") * F.col("message_bytes")).alias("bytes_per_sec"))
        .orderBy(F.desc("message_bytes"))
    )


def post_warmup_delays(changes: DataFrame, delays: DataFrame, warmup_sec: int = settings.WARMUP_SEC) -> DataFrame:
    """Delays late enough after the last change of their run, with that change."""
    sec, delay = F.col("batch_ts"), F.col("delay_ms")
    points = timeline_rows(delays, DELAY, us=sec * 1_000_000, of_sec=sec, delays=F.lit(1), delay_ms=delay)
    return (
        with_epochs(change_rows(changes).unionByName(points))
        .where(is_settled(warmup_sec) & (F.col("kind") == DELAY))
        .select("run_id", F.col("of_sec").alias("batch_ts"), "delay_ms", "change_us", "frequency")
    )
