"""Where results go: console previews, per-batch actions, published messages, result files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidegauge import settings
from tidegauge.functions import messages as msg
from tidegauge.sources import folders


def console_preview(stream: DataFrame, rows: int = settings.PREVIEW_ROWS, mode: str = "append") -> DataStreamWriter:
    """Prints the first rows of every batch."""
    return stream.writeStream.format("console").option("numRows", rows).outputMode(mode)


def for_each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], mode: str = "append") -> DataStreamWriter:
    """Runs a user's action on every batch. A batch may run again after a failure, with the same number."""
    return stream.writeStream.outputMode(mode).foreachBatch(action)


def keep_batches(stream: DataFrame, table: str, change: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataStreamWriter:
    """Writes ``change`` of every batch to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return for_each_batch(stream, write, mode)


def count_batches(stream: DataFrame, table: str) -> DataStreamWriter:
    """Number of rows of each batch, zero for a batch whose rows were all filtered out."""
    return keep_batches(stream, table, lambda batch: batch.agg(F.count(F.lit(1)).alias("n")))


def cost_per_batch(stream: DataFrame, table: str, line: str = "line") -> DataStreamWriter:
    """Number of messages and the CPU time they ask for, per batch.

    The cost is summed because a plain count would let Spark leave out the parsing of the lines.
    """
    return keep_batches(
        stream,
        table,
        lambda batch: batch.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(msg.cost_ms(F.col(line)).cast("bigint")), F.lit(0)).alias("cost_ms"),
        ),
    )


def publish_messages(lines: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Appends lines as text files. Readers see a file only once it is complete.

    With ``by``, rows are rebalanced by those columns first, so each name gets few files and one that holds most lines is split
    over several; without, every task writes its own lines.
    """
    if by:
        lines.hint("rebalance", *[F.col(c) for c in by]).write.mode("append").partitionBy(*by).text(path)
    else:
        lines.write.mode("append").text(path)


def publish_files(lines: DataFrame, path: str, name: str = "name") -> list[str]:
    """Writes the lines of each name to one file with that name. Readers see a file only once it is complete.

    Files are written to a hidden folder first; renaming them is one step for each and moves no data. Gives their paths.
    """
    spark = lines.sparkSession
    staged = f"{path}/{settings.HIDDEN_PREFIX}staged-{uuid.uuid4().hex}"
    lines.repartition(name).write.partitionBy(name).text(staged)
    published = []
    for part in folders.files_below(spark, staged):
        folder, file = part.split("/")[-2:]
        if folder.startswith(f"{name}=") and not file.startswith(("_", ".")):
            published.append(f"{path}/{unquote(folder.split('=', 1)[1])}")
            folders.move(spark, part, published[-1])
    return published


def run_stamp(started: datetime) -> str:
    """The name a run's results are kept under."""
    return started.strftime(settings.RUN_STAMP_FORMAT)


def append_results(results: DataFrame, path: str, stamp: str) -> None:
    """Adds result rows as JSON lines in the folder of the run's stamp; a repeat under the same stamp replaces them."""
    results.write.mode("overwrite").json(f"{path}/run_stamp={stamp}")


def kept_batches(spark: SparkSession, table: str) -> DataFrame:
    """All batches ``keep_batches`` wrote, with their ``batch_id``."""
    return spark.read.parquet(table).withColumn("batch_id", F.col("batch_id").cast("bigint"))


