"""Exact top-k search by a vector-approximation file.

Every vector is kept as one byte for each dimension, the number of its cell. A scan of the bytes bounds each score from below and
above; only vectors whose upper bound reaches the k-th lower bound can be among the best, and of those the exact vectors are
read in the order of their bounds until the k-th score is certain. Equal vectors are searched as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

SCALE = 1024
CELLS = 256
QUERY_BLOCK = 1024  # query vectors that are sent to every task at a time
SCAN_ROWS = 2048
MOST = 2.0**62  # squares of a vector add up to less, so scores lie between -MOST and MOST
FIRST_READS = 4  # times k vectors are read before the bounds of the others are looked at again


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: floor(1024 * x) of each component as 64-bit integers.

    Null vectors and such with null or non-finite components go, and vectors whose squares add up to 2^62 or more: without
    those every score and all its partial sums fit a long.
    """
    usable = F.col("embedding").isNotNull() & ~F.exists(
        F.coalesce(F.col("embedding"), F.array()),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    floors = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    whole = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), floors.alias("v"))
    return whole.filter(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")) < MOST)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``class, v, ids``: each distinct vector with the k + 1 least ids that have it, repeated ids included.

    More are never needed: equal vectors have equal scores, the least ids win, and a query leaves out one row only.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))), lambda x: x["vec_id"])
    grouped = few.groupBy("v").agg(ids.alias("ids"))
    # two numbers from the vector name the class
    return grouped.select(F.xxhash64("v").alias("c1"), F.hash("v").alias("c2"), "v", "ids")


def _cells(approximated: DataFrame) -> DataFrame:
    """One row for each number of dimensions: least and largest value of each dimension, which lay out the cells."""
    each = approximated.select(F.size("v").alias("dims"), F.posexplode("v").alias("at", "x"))
    bounds = each.groupBy("dims", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return bounds.groupBy("dims").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("bounds"))


def _widths(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whole widths of cells, so that CELLS of them cover each dimension."""
    return (high - low) // CELLS + 1


def approximations(found: DataFrame, layout: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``c1, c2, dims, cells``: each class with the numbers of its cells, a byte for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            dims = vectors.value_lengths().to_numpy()
            out = [
                ((np.asarray(x.values.to_numpy(), np.int64) - layout[n][0]) // layout[n][1]).astype(np.uint8).tobytes() if n else b""
                for n, x in zip(dims.tolist(), vectors, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("c1"), batch.column("c2"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                ["c1", "c2", "dims", "cells"],
            )

    return found.select("c1", "c2", "v").mapInArrow(run, "c1 long, c2 int, dims int, cells binary")


def _best(lower: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or the least number where a row is shorter."""
    if lower.shape[1] < k:
        return np.full(len(lower), np.iinfo(np.int64).min)
    return np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]


def _scan(approximated: DataFrame, queries: list[tuple[int, int, list[int]]], layout: dict, k: int) -> DataFrame:
    """``q1, q2, c1, c2, low, high``: for each query vector the classes of a task that may be among its best, with bounds.

    A class is left out once k others of the same task have lower bounds above its upper bound.
    """
    by_dims: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for n in {len(v) for *_, v in queries}:
        of = [x for x in queries if len(x[2]) == n]
        by_dims[n] = tuple(np.array([x[i] for x in of], np.int64) for i in range(3))
    held = approximated.sparkSession.sparkContext.broadcast(by_dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, np.ndarray] = {}
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for n, (q1, q2, q) in held.value.items():
                rows = np.flatnonzero(dims == n)
                if not n or not len(rows):
                    continue
                low0, width = layout[n]
                best = tops.setdefault(n, np.full((len(q), k), np.iinfo(np.int64).min))
                # sums below 2^53 are exact as floats, whose products are far faster
                up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
                reach = np.linalg.norm(q.astype(float), axis=1)
                for first in range(0, len(rows), SCAN_ROWS):
                    part = rows[first : first + SCAN_ROWS]
                    cells = np.frombuffer(b"".join(batch.column("cells").take(pa.array(part)).to_pylist()), np.uint8)
                    least = low0 + cells.reshape(-1, n).astype(np.int64) * width
                    most = (least + width - 1).astype(float)
                    least = least.astype(float)
                    lower = up @ least.T + down @ most.T
                    upper = up @ most.T + down @ least.T
                    sums = np.linalg.norm(np.maximum(np.abs(least), np.abs(most)), axis=1)
                    if reach.max() * sums.max() >= 2.0**52:
                        # larger ones are rounded, so the bounds give way by all that rounding can do
                        slack = np.outer(reach, sums) * (n + 4) * 2.0**-51
                        lower, upper = np.floor(lower - slack), np.ceil(upper + slack)
                    lower, upper = (np.clip(x, -MOST, MOST).astype(np.int64) for x in (lower, upper))
                    best = np.sort(np.concatenate([best, lower], axis=1), axis=1)[:, -k:]
                    i, j = np.nonzero(upper >= best[:, :1])
                    kept.append((np.full(len(i), n), i, part[j] * 0, lower[i, j], upper[i, j], batch.column("c1").to_numpy()[part[j]], batch.column("c2").to_numpy()[part[j]]))
                tops[n] = best
        if kept:
            n, i, _, low, high, c1, c2 = (np.concatenate(x) for x in zip(*kept, strict=True))
            for dim in np.unique(n).tolist():
                q1, q2, _ = held.value[dim]
                at = np.flatnonzero(n == dim)
                at = at[high[at] >= tops[dim][i[at], 0]]
                for part in np.array_split(at, len(at) // 100_000 + 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in ((q1[i[part]], pa.int64()), (q2[i[part]], pa.int32()), (c1[part], pa.int64()), (c2[part], pa.int32()), (low[part], pa.int64()), (high[part], pa.int64()))],
                        ["q1", "q2", "c1", "c2", "low", "high"],
                    )

    return approximated.mapInArrow(run, "q1 long, q2 int, c1 long, c2 int, low long, high long")


def _exact(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``score`` and ``ids`` of the class to pairs of query and class."""
    query = found.select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x)
    return pairs.join(found, ["c1", "c2"]).join(query, ["q1", "q2"]).withColumn("score", product).drop("q", "v")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by ``every`` its ``k`` best other rows.

    The score is the inner product of whole-number vectors; ties go to the smaller id. Vectors that are null or hold null or
    non-finite components take no part, nor do those whose scores may not fit a long (see :func:`whole_numbers`); a null id is no query and comes after all ids; vectors meet only those of their
    own number of dimensions. Repeated rows count each: a query leaves out one row of its id and vector, so its own repeats are
    candidates, and each repeat is a query. An empty table gives no rows.
    """
    rows = written(whole_numbers(vectors), "vectors")
    found = written(classes(rows, k), "vector-classes")
    layout = {
        r["dims"]: tuple(np.array([b[name] for b in r["bounds"]], np.int64) for name in ("low", "high")) for r in _cells(found).collect()
    }
    layout = {n: (low, _widths(low, high)) for n, (low, high) in layout.items()}
    approximated = written(approximations(found, layout), "approximations")
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("v").alias("q1"), F.hash("v").alias("q2"), "v")
    asked = written(asked, "queries")
    distinct = written(asked.select("q1", "q2", "v").distinct(), "query-vectors")
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    blocked = written(distinct.withColumn("block", F.pmod("q1", F.lit(blocks))), "query-blocks")
    parts = []
    for block in range(blocks):
        # about QUERY_BLOCK vectors: a block of fixed size goes to every task, and all approximations pass it
        queries = [(r["q1"], r["q2"], r["v"]) for r in blocked.filter(F.col("block") == block).collect()]
        parts.append(written(_scan(approximated, queries, layout, k + 1), "bounds"))
    bounds = parts[0]
    for more in parts[1:]:
        bounds = bounds.union(more)
    query = ["q1", "q2"]
    by_bound = Window.partitionBy(*query).orderBy(F.col("low").desc(), "c1", "c2")
    kth = bounds.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= k + 1)
    least = kth.groupBy(*query).agg(F.count("*").alias("n"), F.min("low").alias("least"))
    least = least.select(*query, F.when(F.col("n") > k, F.col("least")).alias("least"))
    near = bounds.join(least, query).filter(F.col("least").isNull() | (F.col("high") >= F.col("least")))
    order = Window.partitionBy(*query).orderBy(F.col("high").desc(), "c1", "c2")
    near = written(near.withColumn("nth", F.row_number().over(order)), "candidates")
    # first the vectors with the highest bounds; of the others only those whose bound reaches the k-th score so far
    first = written(_exact(near.filter(F.col("nth") <= FIRST_READS * k), found), "first-reads")
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.col("score").desc()))
    so_far = first.withColumn("r", rank).filter(F.col("r") == k + 1).select(*query, F.col("score").alias("certain"))
    others = near.filter(F.col("nth") > FIRST_READS * k).join(so_far, query).filter(F.col("high") >= F.col("certain"))
    read = first.select(*query, "score", "ids").union(_exact(others.drop("certain"), found).select(*query, "score", "ids"))
    # the k + 1 best rows of each query vector, then for each query without its own row
    rows_of = read.select(*query, "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy(*query).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = rows_of.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k + 1)
    lists = best.groupBy(*query).agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    answered = asked.select("vec_id", "v", *query).join(lists, query)
    own_score = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0).cast("long"), lambda total, x: total + x)
    own = F.expr("array_position(transform(best, x -> x.vec_id = vec_id and x.score = own), true)")
    cut = answered.withColumn("own", own_score).withColumn("at", own).withColumn(
        "best", F.slice(F.filter("best", lambda x, i: i + 1 != F.col("at")), 1, k)
    )
    listed = cut.select(F.col("vec_id").alias("query_id"), F.posexplode("best").alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
