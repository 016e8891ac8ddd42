"""Parameters over time: merging partial updates, and the setting in force at a message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.functions import times
from tidegauge.operators import ordered


def merged_params(patches: DataFrame, defaults: dict = settings.DEFAULT_PARAMS, span: int = ordered.HOUR_US) -> DataFrame:
    """Full parameters after each update: given keys overwrite, absent ones keep their value or the default."""
    series = ordered.Series(["run_id"], "_us", ["event_id"], span)
    names = {f"_{name}": F.col(name) for name in defaults}
    merged = ordered.carry_last(patches.withColumn("_us", times.micros(F.col("ts"))), series, names)
    full = {n: F.coalesce(f"_{n}", F.lit(v)) for n, v in defaults.items()}
    return merged.withColumns(full).drop("_us", *names)


_SETTING = {"frequency": "frequency", "setting_bytes": "message_bytes"}


def params_as_of(
    messages: DataFrame, changes: DataFrame, hold_sec: int | None = None, span: int = ordered.HOUR_US
) -> DataFrame:
    """Adds to each message the newest setting of its source at its time (frequency, setting_bytes, since_us).

    Messages and changes become one ordered series per source, so no message is matched with more than one change.
    A change at the same moment as a message counts. With ``hold_sec``, a sender looks for new settings only at its
    first message in each span of that many seconds.
    """
    if hold_sec:
        return _held_params(messages, changes, hold_sec, span)
    series = ordered.Series(["source_id"], "_us", ["_kind", "_id"], span)
    us = times.micros(F.col("ts"))
    changed = changes.select(
        F.col("run_id").alias("source_id"),
        us.alias("_us"),
        F.lit(0).alias("_kind"),
        F.col("change_id").alias("_id"),
        F.struct(*[F.col(c).alias(n) for n, c in _SETTING.items()], us.alias("since_us")).alias("_set"),
    )
    sent = messages.withColumns({"_us": us, "_kind": F.lit(1), "_id": F.col("msg_id")})
    both = sent.unionByName(changed, allowMissingColumns=True)
    found = ordered.carry_last(both, series, {"_now": F.col("_set")}).where(F.col("_kind") == 1)
    return found.select(*messages.columns, "_now.*")


def _held_params(messages: DataFrame, changes: DataFrame, hold_sec: int, span: int) -> DataFrame:
    """Looks up one message per source and span, then joins: each span has one setting, however full it is."""
    sec = times.seconds(F.col("ts"))
    spans = messages.withColumn("_span", sec - F.pmod(sec, F.lit(hold_sec)))
    first = spans.groupBy("source_id", "_span").agg(F.min("ts").alias("ts")).withColumn("msg_id", F.lit(0).cast("bigint"))
    found = params_as_of(first, changes, span=span).drop("ts", "msg_id")
    return spans.join(found, ["source_id", "_span"], "left").select(*messages.columns, *_SETTING, "since_us")
