"""Lloyd's rounds over vectors that are cut by dimension.

Vectors are dealt into groups, and each group is cut into tiles: one for each block of columns. The tiles of one block are a
shard; they lie in partitions of their own and stay there for all rounds. In a round every tile gives the exact distances of
its columns to its slice of the centroids, ``reduceByKey`` adds the blocks of a group and takes the nearest centroid, and the
numbers of the nearest go back to the tiles, where each shard sums its own columns and finds its own slice anew. What the
driver holds are the centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.rdd import portable_hash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import written

LONG_MAX = (1 << 63) - 1
TILE_ROWS = 4096
TILES_PER_TASK = 64

_CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_TILE = "part int, nth int, block int, ids array<long>, cells binary"


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of vectors with ``dims`` components, none null or non-finite.

    A vector with a component beyond +-sqrt(2^63 / (4 * dims)) after scaling takes no part: its distances may not fit a long.
    """
    limit = float(math.isqrt(LONG_MAX // (4 * dims)) - 1)
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    fits = F.forall(scaled, lambda x: F.coalesce(F.abs(x) <= limit, F.lit(False)))  # false for null, NaN and infinity
    return vectors.where((F.size("embedding") == dims) & fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda x: F.floor(x)).alias("v")
    )


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``salt`` and their id, in the order of the hashes; null ids come last."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = kept.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def tiles(kept: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``part, nth, block, ids, cells``: each group of at most TILE_ROWS vectors as one tile for each block of columns.

    (part, nth) names the group; ids are in the tile of block 0 only.
    """
    dims = bounds[-1][1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, TILE_ROWS):
                rows = batch.slice(first, TILE_ROWS)
                x = rows.column("v").flatten().to_numpy().reshape(-1, dims)
                ids = [rows.column("vec_id").to_pylist()] + [None] * (len(bounds) - 1)
                cells = [np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in bounds]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(bounds), pa.int32()),
                        "nth": pa.array([nth] * len(bounds), pa.int32()),
                        "block": pa.array(range(len(bounds)), pa.int32()),
                        "ids": pa.array(ids, pa.list_(pa.int64())),
                        "cells": pa.array(cells, pa.binary()),
                    }
                )
                nth += 1

    return kept.mapInArrow(cut, _TILE)


def _cells(cells: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cells, np.int64).reshape(-1, width)


def _distances(cells: bytes, centers: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a tile to a slice of the centroids, a column for each centroid."""
    x = _cells(cells, centers.shape[1])
    out = np.empty((len(x), len(centers)), np.int64)
    for j, c in enumerate(centers):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class _Shards:
    """The tiles as pairs ((block, part, nth), cells), each block in partitions of its own."""

    def __init__(self, cut: DataFrame, bounds: list[tuple[int, int]], count: int):
        self.bounds = bounds
        cores = cut.sparkSession.sparkContext.defaultParallelism
        self.groups = groups = max(-(-cores // len(bounds)), -(-count // (TILES_PER_TASK * len(bounds))))
        # one function object: data dealt by it twice lies in the same partitions
        self.place = lambda key: key[0] * groups + portable_hash(key[1:]) % groups
        self.partitions = groups * len(bounds)
        self.tiles = self.dealt(
            cut.select("part", "nth", "block", "cells").rdd.map(lambda r: ((r["block"], r["part"], r["nth"]), bytes(r["cells"])))
        )

    def dealt(self, pairs: RDD) -> RDD:
        return pairs.partitionBy(self.partitions, self.place)

    def nearest(self, centers: np.ndarray) -> RDD:
        """((part, nth), (number of the nearest centroid, its squared distance)) for each group."""
        slices = [centers[:, a:b] for a, b in self.bounds]
        partial = self.tiles.map(lambda t: (t[0][1:], _distances(t[1], slices[t[0][0]])))
        return partial.reduceByKey(np.add, self.groups).mapValues(lambda d: (d.argmin(1).astype(np.int32), d.min(1)))

    def updated(self, centers: np.ndarray) -> np.ndarray:
        """The centroids after one round: floors of the means; those without vectors stay."""
        k, blocks = len(centers), len(self.bounds)
        widths = [b - a for a, b in self.bounds]
        numbers = self.dealt(self.nearest(centers).flatMap(lambda g: [((b, *g[0]), g[1][0]) for b in range(blocks)]))
        # both are dealt alike, so this moves nothing: a partition gives its numbers first, then its tiles one by one
        both = numbers.union(self.tiles)
        if both.getNumPartitions() != self.tiles.getNumPartitions():
            raise RuntimeError("tiles and nearest centroids are not dealt alike")

        def sums(pairs: Iterator) -> Iterator:
            near: dict = {}
            found: dict = {}
            for key, value in pairs:
                if isinstance(value, np.ndarray):
                    near[key] = value
                    continue
                x, label = _cells(value, widths[key[0]]), near.pop(key)
                of_tile = [[int(s) for s in x[label == j].sum(0)] for j in range(k)]
                counted = [int(n) for n in np.bincount(label, minlength=k)]
                found[key[0]] = _added(found[key[0]], (of_tile, counted)) if key[0] in found else (of_tile, counted)
            yield from found.items()

        slices = both.mapPartitions(sums).reduceByKey(_added, blocks)
        old = [centers[:, a:b].tolist() for a, b in self.bounds]
        moved = slices.map(lambda s: (s[0], _floors(*s[1], old[s[0]]))).collectAsMap()
        return np.concatenate([np.array(moved[b], np.int64).reshape(k, -1) for b in range(blocks)], axis=1)


def _added(a: tuple, b: tuple) -> tuple:
    """Sums and counts of two parts of a shard; Python's integers, so no number of vectors is too large."""
    sums = [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a[0], b[0], strict=True)]
    return sums, [x + y for x, y in zip(a[1], b[1], strict=True)]


def _floors(sums: list[list[int]], counts: list[int], old: list[list[int]]) -> list[list[int]]:
    return [[s // n for s in row] if n else was for row, n, was in zip(sums, counts, old, strict=True)]


def clustered(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    salt: str = "3:",
    blocks: int = 4,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector after ``rounds`` rounds.

    Vectors with another number of components, null or non-finite ones, or components too large (``whole_vectors``) take
    no part. Fewer than ``k`` vectors are a centroid each. Rows may repeat: each counts. A null id is kept; its vector
    is a first centroid only after all others. Equal vectors may be first centroids together: the one with the greater number
    stays without vectors, and where it is. Sums of distances that do not fit a long are null. An empty table
    gives no rows. Other columns of the table are not looked at.
    """
    spark = vectors.sparkSession
    kept = written(whole_vectors(vectors, dims, scale), "kept-vectors")
    centers = first_centroids(kept, k, salt)
    if not len(centers):
        return spark.createDataFrame([], _CLUSTERED)
    edges = [dims * i // blocks for i in range(blocks + 1)]
    bounds = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
    cut = written(tiles(kept, bounds), "tiles")
    shards = _Shards(cut, bounds, cut.count())
    for _ in range(rounds):
        centers = shards.updated(centers)

    found = shards.nearest(centers).map(lambda g: (*g[0], g[1][0].tolist(), g[1][1].tolist()))
    found = spark.createDataFrame(found, "part int, nth int, cluster array<int>, distance array<long>")
    members = cut.where("block = 0").select("part", "nth", F.col("ids").alias("vec_id")).join(found, ["part", "nth"])
    rows = members.select(F.inline(F.arrays_zip("vec_id", "cluster", "distance")))
    rows = written(rows, "clustered")
    # one row for each centroid
    total = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    named = [
        (r["cluster"], _long(r["s"]), _long(sum(x["s"] for x in total)), centroid_digest(centers[r["cluster"]])) for r in total
    ]
    totals = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(totals), "cluster").select(*[c.split()[0] for c in _CLUSTERED.split(", ")])


def _long(total) -> int | None:
    return int(total) if int(total) <= LONG_MAX else None


def centroid_digest(center: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in center).encode()).hexdigest()
