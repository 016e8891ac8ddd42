"""Progress of running queries as rows in the shape of batch records."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidegauge.sources import folders

PROGRESS = (
    "id string, runId string, name string, batchId bigint, timestamp timestamp, numInputRows bigint, "
    "durationMs map<string, bigint>"
)
EVENTS = "kind string, run_id string, body string"


def progress_records(events: DataFrame, interval_sec: float | None = None) -> DataFrame:
    """Batch records from progress JSON (``body``): total delay = scheduling (lag behind the trigger) + processing.

    ``interval_sec`` is the trigger interval: a batch is due one interval after the slot in which the one before it
    started, and lags by what it starts later. Without an interval, batches start when data is there and have no lag.
    """
    p = events.select(F.from_json("body", PROGRESS).alias("p")).select("p.*")
    started_ms = F.unix_millis("timestamp")
    lag = F.lit(0).cast("bigint")
    if interval_sec:
        interval_ms = F.lit(int(interval_sec * 1000)).cast("bigint")
        # one row for each micro-batch of a query
        before = F.lag(started_ms - started_ms % interval_ms).over(Window.partitionBy("id").orderBy("batchId", "timestamp"))
        lag = F.greatest(F.lit(0).cast("bigint"), F.coalesce(started_ms - before - interval_ms, F.lit(0)))
    processing = F.coalesce(F.get(F.map_values(F.map_filter("durationMs", lambda k, _: k == "triggerExecution")), 0), F.lit(0))
    return p.select(
        F.col("id").alias("run_id"),
        F.col("batchId").alias("batch_id"),
        F.unix_seconds("timestamp").alias("batch_ts"),
        F.lit("COMPLETED").alias("status"),
        F.col("numInputRows").alias("records"),
        lag.alias("scheduling_ms"),
        processing.alias("processing_ms"),
        (lag + processing).alias("total_delay_ms"),
    )


class ProgressLog(StreamingQueryListener):
    """Writes every event of all queries of a session to a folder: started, progress, idle, terminated (with its error)."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._ended: set[str] = set()

    def _add(self, kind: str, event, body: str | None) -> None:
        row = json.dumps({"kind": kind, "run_id": str(event.runId), "body": body})
        folders.write_text(self._spark, f"{self._folder}/{uuid.uuid4().hex}.json", row + "\n")

    def onQueryStarted(self, event) -> None:
        self._add("started", event, event.timestamp)

    def onQueryProgress(self, event) -> None:
        self._add("progress", event.progress, event.progress.json)

    def onQueryIdle(self, event) -> None:
        self._add("idle", event, event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._add("terminated", event, event.exception)
        self._ended.add(str(event.runId))

    def wait_for(self, queries: Iterable[StreamingQuery], seconds: float = 60) -> None:
        """Waits until the end of every one of these queries is written; events arrive a little later than they happen."""
        runs, until = {str(q.runId) for q in queries}, time.monotonic() + seconds
        while runs - self._ended:
            if time.monotonic() > until:
                raise TimeoutError(f"no event of the end of {runs - self._ended}")
            time.sleep(0.05)

    def events(self) -> DataFrame:
        return self._spark.read.schema(EVENTS).json(self._folder)

    def records(self, interval_sec: float | None = None) -> DataFrame:
        return progress_records(self.events().where("kind = 'progress'"), interval_sec)
