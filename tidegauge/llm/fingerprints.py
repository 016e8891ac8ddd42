"""Quartile bucket digests of whole texts, and a bounded score of how far two of them differ.

Six byte triplets are taken from every window of five bytes of a text. Each is hashed into one of 256 buckets, and the digest
says for every bucket in which quarter of all buckets its count lies, besides the length on a logarithmic scale, the spread of
the quarters, and a check byte. Texts that share much of their bytes have buckets in the same quarters.

To compare each document with the next one, documents are ordered by ranges of their ids: a task sees its range as a stream and
holds two texts at a time, and only the first and the last text of each range meet in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

BUCKETS = 256
WINDOW = 5
CHUNK_BYTES = 1 << 16
END = 0xFF  # follows a text so that each byte starts a window; no byte of UTF-8 has this value

# Offsets in a window of the triplets, which all begin with its first byte.
_TRIPLETS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
_TABLES = np.random.default_rng(20241103).permuted(np.tile(np.arange(256, dtype=np.uint8), (3, 1)), axis=1)
# A hash means another bucket for each kind of triplet.
_PLACES = np.random.default_rng(20241104).permuted(np.tile(np.arange(BUCKETS), (len(_TRIPLETS), 1)), axis=1)

# What two buckets add to a difference, by how many quarters they lie apart.
_APART = np.array([0, 1, 2, 6])
# The mean over two independent digests: quarters lie 0, 1, 2 or 3 apart in 4, 6, 4 and 2 of 16 cases.
_UNRELATED = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) // 16
_LENGTH_STEPS, _LENGTH_WEIGHT, _SPREAD_WEIGHT = 16, 2, 2

_PAIR = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ROWS = f"doc_id long, {_PAIR}, part int, edge string, text string"
_RESULT = ["doc_id", *[c.split()[0] for c in _PAIR.split(", ")]]


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of the text fall into each bucket; long texts pass in chunks."""
    counts = np.zeros(BUCKETS, np.int64)
    whole = np.frombuffer(data + bytes([END] * (WINDOW - 1)), np.uint8)
    for first in range(0, len(data), CHUNK_BYTES):
        part = whole[first : first + CHUNK_BYTES + WINDOW - 1]
        n = len(part) - (WINDOW - 1)
        a, b, c = (t[part] for t in _TABLES)
        for places, (i, j) in zip(_PLACES, _TRIPLETS, strict=True):
            counts[places] += np.bincount(a[:n] ^ b[i : i + n] ^ c[j : j + n], minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Eight steps for each doubling of the number of bytes; 0 for an empty text."""
    if not n:
        return 0
    bits = n.bit_length()
    return min(255, 8 * bits + ((n << 3 >> bits - 1) & 7))


def digest(data: bytes) -> str:
    """The fingerprint in hexadecimal: check byte, length, spread of the quarters, two bits for each bucket."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    quarters = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    body = quarters @ np.array([64, 16, 4, 1], np.uint8)
    spread = (15 * q1 // q3 << 4 | 15 * q2 // q3) if q3 else 0
    check = hashlib.sha256(data).digest()[0]
    return (bytes([check, length_code(len(data)), spread]) + body.astype(np.uint8).tobytes()).hex()


def difference(a: str, b: str) -> int:
    """0 for equal fingerprints, at most ``BOUND``."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    total = int(x[0] != y[0]) + _LENGTH_WEIGHT * min(_LENGTH_STEPS, abs(int(x[1]) - int(y[1])))
    for shift in (4, 0):
        total += _SPREAD_WEIGHT * abs((int(x[2]) >> shift & 15) - (int(y[2]) >> shift & 15))
    shifts = np.array([[6], [4], [2], [0]], np.uint8)
    apart = np.abs((x[3:] >> shifts & 3).astype(np.int8) - (y[3:] >> shifts & 3).astype(np.int8))
    return min(BOUND, total + int(_APART[apart].sum()))


BOUND = _UNRELATED + 1 + _LENGTH_WEIGHT * _LENGTH_STEPS


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 for such as are no closer than fingerprints of unrelated texts."""
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(text: str, own: str, following: str, other: str) -> tuple:
    new = edited(text, following).encode()
    of_new = digest(new)
    return len(text), hashlib.sha256(new).hexdigest(), own, of_new, likeness(own, of_new), likeness(own, other)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_ARROW_ROWS = _ARROW.append(pa.field("part", pa.int32())).append(pa.field("edge", pa.string())).append(pa.field("text", pa.string()))
_OPEN = (None,) * 6


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the documents of one range in their order; its first and last text go out as they are."""
    part = TaskContext.get().partitionId()
    last: tuple | None = None  # id, text, fingerprint
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            now = (doc_id.as_py(), text.as_py(), digest(text.as_py().encode()))
            if last is None:
                rows.append((*now[:1], *_OPEN, part, "first", now[1]))
            else:
                rows.append((last[0], *_compared(last[1], last[2], now[1], now[2]), part, None, None))
            last = now
        if rows:
            yield _batch(rows, _ARROW_ROWS)
    if last is not None:
        yield _batch([(last[0], *_OPEN, part, "last", last[1])], _ARROW_ROWS)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the last document of a range with the first of the next one."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc_id, text, following = (batch.column(c)[i].as_py() for c in ("doc_id", "text", "following"))
            made = _compared(text, digest(text.encode()), following, digest(following.encode()))
            yield _batch([(doc_id, *made)], _ARROW)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs``.

    The next document is that with the next greater id, after the last one the first; null ids come after all others. Rows of
    one id follow each other by a hash of their texts, so repeated rows are next to each other and each is a row of
    the result. A null text is empty. An empty text has a fingerprint of its own, and is at 1 from another empty
    one. A single document is its own next one. An empty table gives no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # the row's number only deals out equal rows, of which any order is the same
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.withColumns({"_hash": order[1], "_row": order[2]})
    by = [F.col("doc_id").asc_nulls_last(), "_hash", "_row"]
    ranges = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    found = written(ranges.mapInArrow(_stream, _ROWS), "fingerprints")

    edges = found.where(F.col("edge").isNotNull()).select("doc_id", "part", "edge", "text")
    # one row for each range that is not empty
    turn = Window.orderBy("part")
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = edges.where("edge = 'first'").select(
        "part", F.coalesce(F.lead("part").over(turn), F.first("part").over(around)).alias("next")
    )
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = edges.where("edge = 'last'").select("doc_id", "part", "text")
    closed = lasts.join(parts, "part").join(firsts, "next").select("doc_id", "text", "following")
    closed = closed.mapInArrow(_across, f"doc_id long, {_PAIR}")
    return found.where(F.col("edge").isNull()).select(*_RESULT).unionByName(closed.select(*_RESULT))
