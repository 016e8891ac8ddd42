"""Running streams: live on a trigger, or replayed from tables delivered in slices of time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidegauge import settings
from tidegauge.functions import times


def start_live(
    writer: DataStreamWriter, checkpoint: str, interval_sec: int = settings.BATCH_INTERVAL_SEC
) -> StreamingQuery:
    """One micro-batch per interval until stopped; sockets usually run at ``settings.TCP_BATCH_INTERVAL_SEC``."""
    return (
        writer.option("checkpointLocation", checkpoint).trigger(processingTime=f"{interval_sec} seconds").start()
    )


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived since the last run of this checkpoint, then stops."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def time_slices(rows: DataFrame, count: int, ts: str = "ts") -> Iterator[DataFrame]:
    """``rows`` in ``count`` equal spans of time between the first and the last row, cut at whole seconds."""
    sec = times.seconds(F.col(ts))
    lo, hi = rows.agg(F.min(sec), F.max(sec)).first()
    if lo is None:
        lo = hi = 0
    edges = [lo + (hi + 1 - lo) * i // count for i in range(count + 1)]
    for start, end in zip(edges, edges[1:]):
        # Compared as timestamps, so the scan can skip files and row groups outside the slice.
        bounds = [F.lit(F.timestamp_seconds(F.lit(e)).cast("timestamp_ntz")) for e in (start, end)]
        yield rows.where((F.col(ts) >= bounds[0]) & (F.col(ts) < bounds[1]))


def replay(
    slices: Iterator[DataFrame],
    deliver: Callable[[DataFrame, int], None],
    start: Callable[[], DataStreamWriter],
    checkpoint: str,
) -> list[StreamingQuery]:
    """Delivers slice after slice and lets the stream catch up after each, so every slice is one micro-batch.

    Each slice restarts the query from its checkpoint, as after a loss of the driver.
    """
    queries = []
    for number, part in enumerate(slices):
        deliver(part, number)
        queries.append(run_available(start(), checkpoint))
    return queries
