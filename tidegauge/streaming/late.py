"""Rows that come after the watermark: Spark leaves them out of windowed counts unseen, here they are kept in a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import times
from tidegauge.operators.counts import batch_start
from tidegauge.sources import folders

_COUNTS = "batch_start_s bigint, is_late boolean, n bigint, newest_us bigint"


class LateRows:
    """Action for each micro-batch: counts rows per batch of event time, and sets those aside that are too late.

    The watermark is that of Spark's windows: the newest time of earlier micro-batches less ``lateness_sec``, and a row is late if its whole
    window lies at or before it. Rows without a time belong to no window and are late. Counts, late rows and the newest
    time are written under the number of the micro-batch, so a repeated one replaces itself.
    """

    def __init__(self, folder: str, interval_sec: int, lateness_sec: int, ts: str = "ts"):
        self.folder = folder
        self.interval_sec = interval_sec
        self.lateness_sec = lateness_sec
        self.ts = ts

    def _watermark(self, spark: SparkSession, batch_id: int) -> int | None:
        """From the counts of earlier micro-batches, which are one row for each of their windows."""
        if batch_id == 0:
            return None
        if not folders.exists(spark, f"{self.folder}/counts/batch_id={batch_id - 1}"):
            raise FileNotFoundError(f"the counts of micro-batch {batch_id - 1} are missing: {self.folder}")
        earlier = self.counts(spark).where(F.col("batch_id") < batch_id)
        newest = earlier.agg(F.max("newest_us")).first()[0]
        return None if newest is None else newest - self.lateness_sec * 1_000_000

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        watermark = self._watermark(batch.sparkSession, batch_id)
        start = batch_start(self.ts, self.interval_sec)
        end_us = (start + self.interval_sec) * 1_000_000
        late = F.col(self.ts).isNull() if watermark is None else F.coalesce(end_us <= watermark, F.lit(True))
        counted = batch.groupBy(start.alias("batch_start_s"), late.alias("is_late")).agg(
            F.count(F.lit(1)).alias("n"), F.max(times.micros(F.col(self.ts))).alias("newest_us")
        )
        batch.where(late).write.mode("overwrite").parquet(f"{self.folder}/late/batch_id={batch_id}")
        counted.write.mode("overwrite").parquet(f"{self.folder}/counts/batch_id={batch_id}")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_COUNTS}, batch_id bigint").parquet(f"{self.folder}/counts")

    def totals(self, spark: SparkSession) -> DataFrame:
        """batch_start_s, is_late, n over all micro-batches; both together are all rows."""
        return self.counts(spark).groupBy("batch_start_s", "is_late").agg(F.sum("n").alias("n"))

    def late_rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late")
