"""A user's own reduce function over the values of each key.

Every task first reduces the rows it has, so a key with most rows sends one partial result per task, not its rows. Partial results are
merged in two steps: first in shares of the tasks, then the shares of a key, so no task merges the results of all
tasks. Merging reads sorted rows one by one and holds a single value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SHARES = 64
HELD_KEYS = 100_000  # keys a task holds before it passes its partial results on
_BATCH_ROWS = 10_000
_CHUNK_ROWS, _CHUNK_BYTES = 100_000, 16 << 20  # rows whose keys are looked up together
_SHARE = "_share"

Reduce = Callable[[Any, Any], Any]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == _BATCH_ROWS:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Several batches at once, so that a frequent key is looked up once for many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _CHUNK_ROWS or sum(b.nbytes for b in held) >= _CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _reduced(chunk: pa.Table, by: int, value: int, function: Reduce) -> dict[tuple, Any]:
    """The first ``by`` columns of the rows -> their values in column ``value``, reduced. Arrow finds the rows of each key."""
    if not chunk.num_rows:
        return {}
    names = [f"k{i}" for i in range(by)]
    keys = pa.table([*chunk.columns[:by], pa.array(range(chunk.num_rows), pa.int64())], names=[*names, "row"])
    groups = keys.group_by(names, use_threads=False).aggregate([("row", "list")])
    rows = groups["row_list"].combine_chunks()
    values = chunk.column(value).take(rows.flatten()).to_pylist()
    found: dict[tuple, Any] = {}
    start = 0
    for *key, size in zip(*(groups[n].to_pylist() for n in names), pc.list_value_length(rows).to_pylist()):
        key, one = tuple(key), reduce(function, values[start : start + size])
        found[key] = function(found[key], one) if key in found else one  # 0.0 and -0.0 are one key
        start += size
    return found


def _partial(function: Reduce, schema: pa.Schema, held_keys: int):
    by = len(schema) - 2

    def reduced(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[tuple]:
        found: dict[tuple, Any] = {}
        for chunk in _chunks(batches):
            for key, value in _reduced(chunk, by, by, function).items():
                found[key] = function(found[key], value) if key in found else value
                if len(found) >= held_keys:
                    yield from ((*k, v, share) for k, v in found.items())
                    found.clear()
        yield from ((*k, v, share) for k, v in found.items())

    return lambda batches: _batches(reduced(batches, TaskContext.get().partitionId() % SHARES), schema)


def _merge(function: Reduce, schema: pa.Schema, by: int, value: int):
    """Rows with the same first ``by`` columns follow each other; ``value`` is the place of the value, behind them."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last: dict[tuple, Any] = {}  # the key that the next chunk may go on with
        for chunk in _chunks(batches):
            found = _reduced(chunk, by, value, function)
            for key, one in last.items():
                if key in found:
                    found[key] = function(one, found[key])
                else:
                    yield *key, one
            end = tuple(c[-1].as_py() for c in chunk.columns[:by]) if found else None
            last = {end: found.pop(end)} if end in found else {}
            yield from ((*key, one) for key, one in found.items())
        yield from ((*key, one) for key, one in last.items())

    return lambda batches: _batches(merged(batches), schema)


def reduce_by_key(rows: DataFrame, keys: list[str], value: str, function: Reduce, held_keys: int = HELD_KEYS) -> DataFrame:
    """``keys`` and ``value``: the values of each key, combined two by two by ``function`` in any order.

    ``function`` must be associative and commutative, and its result of the type of the values. Null values take no part; a key
    with no other has no row. Null keys are a key. An empty table gives no rows.
    """
    given = rows.select(*keys, value).where(rows[value].isNotNull())
    share = T.StructField(_SHARE, T.IntegerType())
    # keys, value, share for the partial results; keys, share, value while the shares are merged
    partial = T.StructType([*given.schema.fields, share])
    shared = T.StructType([*given.schema.fields[:-1], share, given.schema.fields[-1]])
    n = len(keys)
    found = given.mapInArrow(_partial(function, to_arrow_schema(partial), held_keys), partial)
    found = found.select(*keys, _SHARE, value).repartition(*keys, _SHARE).sortWithinPartitions(*keys, _SHARE)
    found = found.mapInArrow(_merge(function, to_arrow_schema(shared), n + 1, n + 1), shared).select(*keys, value)
    found = found.repartition(*keys).sortWithinPartitions(*keys)
    return found.mapInArrow(_merge(function, to_arrow_schema(given.schema), n, n), given.schema)
