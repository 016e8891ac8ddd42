"""Ordered columns: cut into spans they must equal the plain window over a whole series, whatever the skew."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import ordered

KEPT = ["k", "at", "id", "v"]


def series(span):
    return ordered.Series(["k"], "at", ["id"], span)


def skewed(spark, seed, burst=False):
    """One key with most rows; with ``burst`` most of those fall at two moments. Some rows have no key or no time."""
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        key = 0 if rng.random() < 0.6 else rng.randrange(1, 40)
        at = rng.randrange(-200_000, 1_000_000)
        if burst and rng.random() < 0.8:
            at = 500_000 + rng.randrange(2)
        rows.append((None if i % 97 == 0 else key, None if i % 83 == 0 else at, i, rng.randrange(100) if rng.random() < 0.3 else None))
    return spark.createDataFrame(rows, "k bigint, at bigint, id bigint, v bigint").repartition(6)


def rows_of(df):
    return sorted((str(tuple(r)) for r in df.collect()))



def whole():
    return Window.partitionBy("k").orderBy("at", "id")


def so_far(column):
    return column.over(whole().rowsBetween(Window.unboundedPreceding, Window.currentRow))


# each as the operator gives it, and as a plain window gives it
FORMS = {
    "carry_last": (
        lambda df, s: ordered.carry_last(df, s, {"x": F.col("v")}),
        lambda df: df.withColumn("x", so_far(F.last("v", ignorenulls=True))),
    ),
    "carry_struct": (
        lambda df, s: ordered.carry_last(df, s, {"x": F.when(F.col("v").isNotNull(), F.struct("v", "id"))}),
        lambda df: df.withColumn("x", so_far(F.last(F.when(F.col("v").isNotNull(), F.struct("v", "id")), ignorenulls=True))),
    ),
    "previous": (
        lambda df, s: ordered.previous(df.where("at is not null"), s, "x"),
        lambda df: df.where("at is not null").withColumn("x", F.lag("at").over(whole())),
    ),
    "running": (
        lambda df, s: ordered.running(df, s, {"x": F.col("v"), "n": F.lit(1)}, {"y": F.when(F.col("v").isNotNull(), F.struct("v", "at"))}),
        lambda df: df.withColumns({"x": so_far(F.sum("v")), "n": so_far(F.sum(F.lit(1))), "y": so_far(F.max(F.when(F.col("v").isNotNull(), F.struct("v", "at"))))}),
    ),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("span", [7, 100_000, ordered.HOUR_US])
@pytest.mark.parametrize("burst", [False, True])
def test_spans_equal_the_whole_series(spark, form, span, burst):
    df = skewed(spark, seed=len(form) + burst, burst=burst).cache()
    ours, plain = FORMS[form]
    assert rows_of(ours(df, series(span))) == rows_of(plain(df))


def test_no_rows(spark):
    df = skewed(spark, 1).where("k = 99")
    assert [ours(df, series(10)).count() for ours, _ in FORMS.values()] == [0] * len(FORMS)


@pytest.mark.parametrize("form", FORMS)
def test_only_the_ends_of_spans_are_ordered_by_key_alone(spark, form):
    plan = FORMS[form][0](skewed(spark, 3), series(100))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    keys = [plan[i][plan[i].rindex("], [k#") :] for i in windows]
    alone = [i for i, key in zip(windows, keys) if "_segment" not in key.split("]")[1]]
    assert len(windows) == 2 and len(alone) == 1
    assert any("Aggregate [k#" in line for line in plan[alone[0] + 1 : alone[0] + 3])


def test_no_job_before_the_action(spark):
    df = skewed(spark, 4)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    [ours(df, series(100)) for ours, _ in FORMS.values()]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
