"""What a stream of telemetry makes known: the first delay of each batch, the last word of each second's listings.

Polls overlap, so the same batch arrives again and again, in one micro-batch or in many. Which sighting was the first is kept in
Spark's state store: a key is a share of the runs and a span of batch (or log) time, its state the moments seen with their
values. A run that holds most rows is thus spread over its spans of time. State goes once the watermark has passed the last
arrival that counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators import decisions as dec

BUCKET_SEC = 3600
SHARES = 64  # of the runs; each share of a span is one call of the function below
LATENESS = "1 hour"
# Numbers without nulls, so that whole columns are numpy arrays: ``no_run`` is 1 for a null run, ``_NO_TIE`` stands for a null tie.
KNOWN = "no_run bigint, run bigint, of_sec bigint, us bigint, tie bigint, value bigint, kind int"
_COLUMNS = [c.split()[0] for c in KNOWN.split(", ")]
_STATE = _COLUMNS[:-1]  # a row of the state; the kind is part of the key
_NO_TIE = -(1 << 63)


def _standing(held: np.ndarray, rows: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands for each run and second after ``rows``, and the rows that alter it, with the change as their value.

    Both hold a row of ``_STATE`` columns for each sighting. Of delays the first stands, of listings the last.
    """
    both = np.concatenate([held, rows])
    order = np.lexsort([both[:, i] for i in (4, 3, 2, 1, 0)])  # stable: what is held comes first among equals
    both, old = both[order], order < len(held)
    first = np.ones(len(both), bool)
    first[1:] = (both[1:, :3] != both[:-1, :3]).any(axis=1)
    group = np.cumsum(first) - 1
    held_at = np.full(group[-1] + 1 if len(group) else 0, -1)
    held_at[group[old]] = np.flatnonzero(old)
    at = np.arange(len(both))
    if kind == dec.DELAY:
        stands = old | first & (held_at[group] < 0)
        return both[stands], both[stands & ~old]
    # what came before the line that stands is known already; of lines with one time and number the first counts
    counts = at >= held_at[group]
    counts[1:] &= (both[1:, :5] != both[:-1, :5]).any(axis=1)
    both, old, group = both[counts], old[counts], group[counts]
    same = np.zeros(len(both), bool)
    same[1:] = group[1:] == group[:-1]
    last = np.ones(len(both), bool)
    last[:-1] = ~same[1:]
    told = both.copy()
    told[1:, 5] -= np.where(same[1:], both[:-1, 5], 0)
    return both[last], told[~old & (told[:, 5] != 0)]


def _updated(
    key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState, keep_sec: int, bucket_sec: int
) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    _, kind, bucket = (int(k) for k in key)
    held = np.frombuffer(state.get[0] if state.exists else b"", np.int64).reshape(-1, len(_STATE))
    rows = [np.column_stack([part[c].to_numpy(np.int64) for c in _STATE]) for part in parts]
    held, found = _standing(held, np.concatenate([held[:0], *rows]), kind)
    state.update((held.tobytes(),))
    state.setTimeoutTimestamp(((bucket + 1) * bucket_sec + keep_sec) * 1000 + 1)
    if len(found):
        yield pd.DataFrame(found, columns=_STATE).assign(kind=kind)


def newly_known(
    sightings: DataFrame, keep_sec: int = dec.KEEP_SEC, lateness: str = LATENESS, bucket_sec: int = BUCKET_SEC
) -> DataFrame:
    """A stream of run_id, kind, of_sec, us, tie, value: each first delay, and each change of whether a second was slow.

    ``sightings`` hold these columns and ts, the time of arrival; rows that arrive more than ``lateness`` out of order are dropped by
    Spark. ``keep_sec`` must be what the sightings were cut with: later ones would meet a forgotten state.
    """
    return (
        sightings.select(
            F.col("run_id").isNull().cast("bigint").alias("no_run"),
            F.coalesce("run_id", F.lit(0)).cast("bigint").alias("run"),
            F.col("of_sec").cast("bigint"),
            F.col("us").cast("bigint"),
            F.coalesce("tie", F.lit(_NO_TIE)).cast("bigint").alias("tie"),
            F.col("value").cast("bigint"),
            "kind",
            F.col("ts").cast("timestamp").alias("ts"),
            F.pmod(F.xxhash64("run_id"), F.lit(SHARES)).alias("share"),
            F.floor(F.col("of_sec") / bucket_sec).cast("bigint").alias("bucket"),
        )
        .withWatermark("ts", lateness)
        .groupBy("share", "kind", "bucket")
        .applyInPandasWithState(
            lambda key, parts, state: _updated(key, parts, state, keep_sec, bucket_sec),
            KNOWN,
            "held binary",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
        .select(
            F.when(F.col("no_run") == 0, F.col("run")).alias("run_id"),
            "kind",
            "of_sec",
            "us",
            F.nullif("tie", F.lit(_NO_TIE)).alias("tie"),
            "value",
        )
    )


def first_delays(
    fetches: DataFrame, keep_sec: int = dec.KEEP_SEC, lateness: str = LATENESS, bucket_sec: int = BUCKET_SEC
) -> DataFrame:
    """A stream of the first known delay of each completed batch: run_id, batch_ts, delay_ms."""
    sightings = dec.delay_sightings(fetches, keep_sec).withColumn("kind", F.lit(dec.DELAY))
    return newly_known(sightings, keep_sec, lateness, bucket_sec).select(
        "run_id", F.col("of_sec").alias("batch_ts"), F.col("value").alias("delay_ms")
    )
