"""What the operators of this folder share: tables written between steps, ranks inside groups, fixed-size bit sets."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import scratch_dir

BATCH_ROWS = 500  # of whole texts, about 1 MB of common documents
BITMAP_BITS = 15  # bitmap_construct_agg builds bit sets of 2^15 bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the plan, and a lost executor costs a read only."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    release_jvm(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_jvm(spark: SparkSession) -> bool:
    """Gives what the driver's JVM has freed outside its heap back to the system; whether the JVM could.

    Each job leaves some in the C library's pools, one for each few threads, and the driver of many jobs would keep it all. What is in use
    stays. A JVM without this operation (before JDK 17.0.9, or not on glibc) goes on as it is.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return False
    try:
        # by the interface: the class behind it is not open to others
        kinds, values = spark.sparkContext._gateway.new_array(jvm.Class, 4), spark.sparkContext._gateway.new_array(jvm.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs that run inside hand whole texts to Python in batches of at most ``rows`` rows; no row is left out.

    A batch lies in memory several times, in the executor and in its Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def use_small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """As :func:`small_batches`, for the rest of the session: for results that a caller runs later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    if not 0 < before <= rows:
        spark.conf.set(name, str(rows))


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, per_key: DataFrame | None = None, dealt_by: Sequence[str] = ()
) -> DataFrame:
    """Adds ``rank``, from 0 without gaps inside each group of ``keys`` (not null), also where one group holds most rows.

    Groups are cut by a hash of ``dealt_by``, or else of ``order``, into about sqrt(rows) buckets. The counts of the buckets give each its first
    rank, so no task sees a group whole. ``order`` decides the ranks inside a bucket; rows that agree in all of
    it must be equal in what the caller keeps. Columns of ``per_key`` (one row for each group) are added on the way.
    """
    keys, buckets = list(keys), max(1, math.isqrt(rows))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*(dealt_by or order)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if per_key is not None:
        firsts = firsts.join(per_key, keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = dealt.join(firsts, [*keys, "_bucket"])
    return out.withColumn("rank", F.col("_first") + F.row_number().over(inside) - 1).drop("_bucket", "_first")


def bit_set(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of longs folded onto ``2**bits`` bits, as bytes: its size is fixed, whatever the number of values.

    A value is in the set if its bit is set; other values may share the bit, so users check hits exactly or need no
    exact answer.
    """
    position = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    blocks = (
        values.select(
            F.shiftright(position, BITMAP_BITS).alias("block"),
            position.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).alias("bit"),
        )
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << BITMAP_BITS) // 8
    # the driver runs one job for each partition it reads, so blocks come in parts of 8 MB at most, not in all shuffle partitions
    for row in blocks.repartition(max(1, (1 << bits) >> 26)).toLocalIterator():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def in_bit_set(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values (64-bit integers) have their bit set."""
    position = values.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(position >> np.uint64(3)).astype(np.int64)] >> (position & np.uint64(7)).astype(np.uint8)) & 1 > 0


def word_count(text: Column) -> Column:
    """The number of words: runs of anything but space and the five ASCII white-space controls."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
