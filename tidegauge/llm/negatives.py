"""Hard negatives for anchors: rows of another label that score close below a positive, by Kronecker-packed products.

Components become whole numbers. A task packs one component of many candidates into a single wide integer: each is biased to be
no less than zero and has a field of its own, wide enough for a whole inner product. The integer is multiplied once by the
anchor's component (biased too), and the sum of these products over all components holds every candidate's score in its
field, from which the biases are taken off again.

Candidates are dealt into slots by row. Anchors, in a table, go to every slot and pass its packed candidates one
by one, so a task holds the candidates of one slot and never the anchors; it answers with the best few for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

SLOT_ROWS = 1 << 16
SLOT_NUMBERS = 1 << 22  # components a task holds, in all its rows
PACK_ROWS = 512  # fields of one wide integer
FIELD_BITS = (32, 64, 128)
ANSWER_ROWS = 8192

_SENT = "slot int, is_anchor boolean, row long, vec_id long, label long, v array<long>, bars array<long>"
_ANSWER = "anchor long, nth int, score long, row long, vec_id long"


class Pack:
    """Up to PACK_ROWS candidates with one wide integer for each component."""

    def __init__(self, values: np.ndarray):
        self.rows, self.dims = values.shape
        low = int(values.min(initial=0))
        self.bias = -low
        self.most = int(values.max(initial=0)) + self.bias
        self.sums = values.astype(np.uint64).sum(1, dtype=np.uint64)  # modulo 2^64, as all corrections
        self.values = values
        self.wide: dict[int, list[int]] = {}

    def _packed(self, bits: int) -> list[int]:
        if bits not in self.wide:
            fields = np.zeros((self.dims, self.rows, max(1, bits // 64)), np.uint32 if bits == 32 else np.uint64)
            fields[:, :, 0] = (self.values + self.bias).T
            self.wide[bits] = [int.from_bytes(row.tobytes(), "little") for row in fields]
        return self.wide[bits]

    def scores(self, anchor: list[int], total: int, bias: int, most: int) -> np.ndarray:
        """The exact inner product of each candidate with an anchor, whose components have this sum, and with
        ``bias`` added lie in 0..most."""
        need = (self.dims * most * self.most).bit_length()
        bits = next(b for b in FIELD_BITS if need <= b)
        product = 0
        for a, wide in zip(anchor, self._packed(bits), strict=True):
            product += (a + bias) * wide
        fields = np.frombuffer(product.to_bytes(self.rows * bits // 8, "little"), np.uint32 if bits == 32 else np.uint64)
        found = fields.reshape(self.rows, -1)[:, 0].astype(np.uint64)
        # sum((a + bias) * (c + own)) = score + bias * sum(c) + own * (sum(a) + bias * dims)
        off = (self.bias * (total + bias * self.dims)) & (1 << 64) - 1
        return (found - self.sums * np.uint64(bias) - np.uint64(off)).view(np.int64)


def best_first(score: np.ndarray, ids: np.ndarray, has_id: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``at`` the k with the highest scores, ties by the smaller id, rows without an id last."""
    if len(at) > k:
        kth = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= kth]
    return at[np.lexsort((ids[at], ~has_id[at], -score[at]))[:k]]


class Slot:
    """The candidates of one slot, those of one number of components together."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.packs: dict[int, list[Pack]] = {}
        self.held: dict[int, tuple[np.ndarray, ...]] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        column = batch.column("v")
        dims = column.value_lengths().to_numpy()
        flat, starts = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)[:-1]]).astype(np.int64)
        row, label = batch.column("row").to_numpy(), batch.column("label").to_numpy()
        has_id = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        vec_id = batch.column("vec_id").fill_null(0).to_numpy()
        for n in np.unique(dims).tolist():
            at = np.flatnonzero(dims == n)
            values = flat[starts[at][:, None] + np.arange(n)].astype(np.int64).reshape(len(at), n)
            self.parts.setdefault(n, []).append((values, row[at], vec_id[at], has_id[at], label[at]))

    def of(self, dims: int) -> tuple[list[Pack], tuple[np.ndarray, ...]] | None:
        if dims in self.parts:
            values, *rest = (np.concatenate(x) for x in zip(*self.parts.pop(dims), strict=True))
            self.packs[dims] = [Pack(values[i : i + PACK_ROWS]) for i in range(0, len(values), PACK_ROWS)]
            self.held[dims] = tuple(rest)
        return (self.packs[dims], self.held[dims]) if dims in self.packs else None

    def answers(self, anchor: dict, few: Callable) -> list[tuple]:
        """What ``few`` picks for the anchor: tuples of (number of the list, score, row, id)."""
        v = anchor["v"]
        found = self.of(len(v))
        if found is None:
            return []
        packs, (row, vec_id, has_id, label) = found
        bias = -min(0, min(v, default=0))
        most, total = max(0, max(v, default=0)) + bias, sum(v)
        score = np.concatenate([p.scores(v, total, bias, most) for p in packs])
        out = []
        for nth, at in few(anchor, score, row, vec_id, has_id, label):
            out += [(anchor["row"], nth, int(score[i]), int(row[i]), int(vec_id[i]) if has_id[i] else None) for i in at.tolist()]
        return out


def _scan(few: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads rows in the order of slots, in each the candidates first, and gives the answers of each slot's anchors."""
    names = [c.split()[0] for c in _ANSWER.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, slot, rows = None, Slot(), []
        for batch in batches:
            numbers = batch.column("slot").to_numpy()
            anchors = batch.column("is_anchor").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(anchors.astype(np.int8)) != 0)) + 1
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if first == end:
                    continue
                if numbers[first] != current:
                    current, slot = numbers[first], Slot()
                part = batch.slice(first, end - first)
                if not anchors[first]:
                    slot.add(part)
                    continue
                for i in range(part.num_rows):
                    rows += slot.answers({c: part.column(c)[i].as_py() for c in ("row", "label", "v", "bars")}, few)
                    if len(rows) >= ANSWER_ROWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return run


def _best_of(candidates: DataFrame, anchors: DataFrame, slots: int, few: Callable, k: int) -> DataFrame:
    """``anchor, nth, rank, score, row, vec_id``: the first ``k`` answers of all slots for each anchor and list."""
    slot = F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int")
    columns = [c.split()[0] for c in _SENT.split(", ")]
    held = candidates.withColumns({"slot": slot, "is_anchor": F.lit(False), "bars": F.lit(None).cast("array<long>")})
    asked = anchors.withColumns({"slot": F.explode(F.sequence(F.lit(0), F.lit(slots - 1))), "is_anchor": F.lit(True)})
    sent = held.select(*columns).unionByName(asked.select(*columns))
    ordered = sent.repartitionById(slots, "slot").sortWithinPartitions("slot", "is_anchor", "row")
    answers = ordered.mapInArrow(_scan(few), _ANSWER)
    place = Window.partitionBy("anchor", "nth").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return answers.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _positives(k: int) -> Callable:
    def few(anchor, score, row, vec_id, has_id, label):
        yield 0, best_first(score, vec_id, has_id, np.flatnonzero((label == anchor["label"]) & (row != anchor["row"])), k)

    return few


def _negatives(k: int, low: int, high: int) -> Callable:
    def few(anchor, score, row, vec_id, has_id, label):
        other = label != anchor["label"]
        for nth, bar in enumerate(anchor["bars"]):
            # low * bar <= 100 * score <= high * bar, in whole numbers
            least, most = -(-low * bar // 100), high * bar // 100
            if least <= most:
                yield nth, best_first(score, vec_id, has_id, np.flatnonzero(other & (score >= least) & (score <= most)), k)

    return few


def whole_rows(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """``row, vec_id, label, v``: floor(scale * x) of the rows that take part, each with a number of its own."""
    size = F.size("embedding")
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    # false for null, NaN and infinity; within the limit every inner product fits a long
    fits = F.forall(scaled, lambda x: F.coalesce(x * x * size <= float(1 << 62), F.lit(False)))
    return vectors.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & fits).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(scaled, lambda x: F.floor(x)).alias("v"),
    )


def mined(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    every: int = 100,
    scale: int = 256,
    moved: int = 7,
    labels: int = 10,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Their positives are the best other rows of their label, and
    the negatives of each positive the best rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    The label of rows whose id is divisible by ``moved`` goes up by one, modulo ``labels``, before anything else.

    No part take rows with a null label, a null vector, null or non-finite components, or a component whose square times the
    number of components exceeds 2^62 after scaling, as scores may not fit a long. Vectors meet only those with as many
    components; an empty vector scores 0 with other empty ones. A null id is no anchor and comes after all ids. Repeated
    rows count each: an anchor leaves out one row, itself, so its repeats are positives, and each repeat is an anchor. A positive score
    of 0 admits scores of 0, one below 0 none. An empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = written(whole_rows(vectors, scale, label), "whole-rows")
    held = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    slots = max(spark.sparkContext.defaultParallelism, math.ceil(held["n"] / SLOT_ROWS), math.ceil(held["numbers"] / SLOT_NUMBERS))
    anchors = rows.where(F.col("vec_id") % every == 0)
    none = F.lit(None).cast("array<long>")
    near = written(_best_of(rows, anchors.withColumn("bars", none), slots, _positives(positives), positives), "positives")

    # at most ``positives`` for each anchor
    bars = near.groupBy(F.col("anchor").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("bars")
    )
    hard = _best_of(rows, anchors.join(bars, "row"), slots, _negatives(negatives, low, high), negatives)
    pairs = near.select(
        "anchor", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    named = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        hard.select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["anchor", "nth"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
