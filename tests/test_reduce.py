"""A user's reduce function against a plain dictionary."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import reduce


def plain(rows, function):
    found = {}
    for key, value in rows:
        if value is not None:
            found[key] = function(found[key], value) if key in found else value
    return found


FUNCTIONS = {
    "sum": (lambda a, b: a + b, "bigint", lambda rng: rng.randrange(100)),
    "gcd": (math.gcd, "bigint", lambda rng: 6 * rng.randrange(1, 50)),
    "greatest text": (max, "string", lambda rng: "x" * rng.randrange(9) + str(rng.randrange(9))),
    "union": (lambda a, b: sorted(set(a) | set(b)), "array<bigint>", lambda rng: sorted({rng.randrange(20) for _ in range(3)})),
}


@pytest.mark.parametrize("name", FUNCTIONS)
@pytest.mark.parametrize("held_keys", [1, 3, 100_000])
def test_equals_a_dictionary(spark, name, held_keys):
    function, kind, value = FUNCTIONS[name]
    rng = random.Random(name)
    # a third of the rows have one key; some have none, some no value
    keys = [None if i % 50 == 0 else 0 if i % 3 == 0 else rng.randrange(60) for i in range(900)]
    rows = [(k, None if rng.random() < 0.05 else value(rng)) for k in keys] + [(999, None)]
    df = spark.createDataFrame(rows, f"k bigint, v {kind}").withColumn("_share", F.lit("x")).repartition(9)
    found = reduce.reduce_by_key(df, ["k"], "v", function, held_keys)
    assert found.columns == ["k", "v"]
    got = [(r.k, r.v) for r in found.collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == plain(rows, function)


def test_several_keys_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "a", 4), (None, "a", 5), (None, "a", 6)], "k int, t string, v int")
    found = reduce.reduce_by_key(df, ["k", "t"], "v", lambda a, b: a * b)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "a", 8), (1, "b", 3), (None, "a", 30)]
    assert reduce.reduce_by_key(df.limit(0), ["k", "t"], "v", max).count() == 0


def test_a_hot_key_sends_one_row_per_task(spark):
    df = spark.range(0, 50_000, numPartitions=8).select(F.lit(7).alias("k"), F.col("id").alias("v"))
    found = reduce.reduce_by_key(df, ["k"], "v", max)
    assert [tuple(r) for r in found.collect()] == [(7, 49_999)]
    schema = reduce.to_arrow_schema(reduce.T.StructType([*df.schema.fields, reduce.T.StructField("_share", reduce.T.IntegerType())]))
    partial = df.mapInArrow(reduce._partial(max, schema, 10), "k int, v bigint, _share int")
    assert partial.count() == 8 and partial.select("_share").distinct().count() == 8


def test_an_error_of_the_function_is_shown(spark):
    def broken(a, b):
        raise ValueError("no way to reduce this")

    with pytest.raises(Exception, match="no way to reduce this"):
        reduce.reduce_by_key(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int").coalesce(1), ["k"], "v", broken).collect()


def test_a_frequent_key_is_looked_up_once_for_many_rows(spark):
    batch = reduce.pa.RecordBatch.from_pydict({"k": [1, 2] * 5_000, "v": list(range(10_000))})
    chunk = reduce.pa.Table.from_batches([batch] * 4)
    assert reduce._reduced(chunk, 1, 1, lambda a, b: a + b) == {(1,): 4 * sum(range(0, 10_000, 2)), (2,): 4 * sum(range(1, 10_000, 2))}


def test_keys_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(reduce, "_CHUNK_ROWS", 4)
    schema = reduce.pa.schema([("k", "double"), ("v", "int64")])
    rows = [(None, 1), (None, 2), (-0.0, 3), (0.0, 4), (0.0, 5), (1.0, 6), (1.0, 7), (1.0, 8), (1.0, 9), (1.0, 10), (2.0, 11)]
    batches = [reduce.pa.RecordBatch.from_arrays([reduce.pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 2]), schema)], schema=schema) for i in range(0, 11, 2)]
    merged = reduce._merge(lambda a, b: a + b, schema, 1, 1)(iter(batches))
    assert sorted((r["k"] or 0.5 if r["k"] is None else r["k"], r["v"]) for b in merged for r in b.to_pylist()) == [(0.0, 12), (0.5, 3), (1.0, 40), (2.0, 11)]


def test_words_of_one_row_group_are_counted_in_all_tasks(spark):
    from tidegauge.plans.queries import QUERIES

    plan = QUERIES["reduce_word_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("Exchange hashpartitioning(doc_id")
