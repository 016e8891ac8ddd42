"""The newest rows of everything a stream has brought so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tidegauge import settings
from tidegauge.sources import folders


class NewestRows:
    """Action for each micro-batch: keeps the ``count`` first rows in ``order`` of all rows so far.

    What is kept never exceeds ``count`` rows; a micro-batch is cut to as many in each task before the two are merged. Each
    micro-batch writes its own table, so one that is repeated starts from the table before it and replaces its own.
    """

    def __init__(self, folder: str, order: list[Column], count: int = settings.LOG_TAIL_LINES):
        self.folder = folder
        self.order = order
        self.count = count

    def _path(self, batch_id: int) -> str:
        return f"{self.folder}/batch_id={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.orderBy(*self.order).limit(self.count)
        if batch_id > 0:
            if not folders.exists(spark, self._path(batch_id - 1)):
                raise FileNotFoundError(f"the rows kept by micro-batch {batch_id - 1} are missing: {self.folder}")
            before = spark.read.schema(batch.schema).parquet(self._path(batch_id - 1))
            newest = newest.unionByName(before).orderBy(*self.order).limit(self.count)
        newest.write.mode("overwrite").parquet(self._path(batch_id))

    def kept(self, spark: SparkSession) -> DataFrame:
        """The rows kept after each micro-batch, with its ``batch_id``."""
        return spark.read.parquet(self.folder)
