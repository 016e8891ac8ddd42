"""Mixing sources to target weights by entropy balancing.

Of all ways to repeat or leave out documents so that each source gives its target of words, the one nearest to "every
document once" (in relative entropy, at most ``cap`` copies) tilts rates exponentially: rate = min(cap, exp(l * size)), with one
multiplier l for each source. The multipliers solve a convex dual, here by Newton steps over the distributed
histogram of (source, size); rates then become whole copies.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import ranked, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
TOLERANCE = 1e-7
MAX_STEPS = 60
_UNIT = 1 << 20  # rates are whole multiples of 1 / _UNIT, so sums don't depend on the order of adding


def sized(docs: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, key, size`` and the columns ``more``: words of each document; the key names the source, null apart from every text."""
    return docs.select(
        *more,
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("key"),
        word_count(F.col("text")).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``key, source_size, target``: one row for each source.

    Sources in order of code points, null last, have the weights in turn. They share the sum of all sizes by weight; no
    source gets more than ``cap`` times its own size, and what is over goes to the others by weight. So a target is
    min(cap * size, level * weight) with the level at which all targets add up.
    """
    by_source = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    # one row for each source from here on
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = by_source.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")))
    ratio = weighed.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", "key")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = ratio.select(
        "*",
        F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.sum("weight").over(whole).alias("weight_all"),
        F.sum("source_size").over(whole).alias("size_all"),
        F.row_number().over(order).alias("nth"),
    ).withColumn("level", (F.col("size_all") - F.col("full")) / (F.col("weight_all") - F.col("weight_before")))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(whole)["level"]
    return rest.select(
        "key",
        "source_size",
        F.least((cap * F.col("source_size")).cast("double"), found * F.col("weight")).alias("target"),
    )


def _rate(cap: int):
    """Copies of a document in units of 1 / _UNIT; at or above the cap all copies."""
    tilt = F.col("tilt") * F.col("size") / F.col("unit")
    return F.when(F.col("tilt") >= F.lit(1e9), F.lit(cap * _UNIT)).otherwise(
        F.floor(F.exp(F.least(tilt, F.lit(5.0))).cast("double") * _UNIT + 0.5)
    )


def tilts(histogram: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """``key, unit, tilt``: the multiplier of each source, by Newton steps on all sources at once.

    ``histogram`` is ``key, size, n`` with sizes above 0. A step outside the bracket known so far is replaced by its
    middle. Each step is one join and sum over the histogram; its state, a row for each source, is written. Sources that are not near
    their target after MAX_STEPS steps are an error.
    """
    start = histogram.groupBy("key").agg(
        (F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.sum(F.col("n") * F.col("size"))).alias("unit")
    )
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = written(
        start.join(goals, "key").select(
            "key",
            "unit",
            "target",
            (F.col("source_size") / _UNIT).alias("least"),
            F.when(full, F.lit(1e9)).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("tilt"),
            F.lit(-1e6).alias("low"),
            F.lit(1e6).alias("high"),
            full.alias("done"),
        ),
        "tilts",
    )
    for _ in range(MAX_STEPS):
        rate = _rate(cap)
        capped = F.least(rate, F.lit(cap * _UNIT))
        words = F.col("n").cast("decimal(19,0)") * F.col("size")
        sums = (
            histogram.join(state.filter(~F.col("done")), "key")
            .groupBy("key")
            .agg(
                F.sum(words * capped).cast("double").alias("got"),
                F.sum(F.when(rate < cap * _UNIT, words * F.col("size") * rate)).cast("double").alias("slope"),
            )
        )
        slope = F.col("slope") / F.col("unit") / _UNIT
        over = F.col("got") / _UNIT - F.col("target")
        low = F.when(over < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(over > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        moved = F.col("tilt") - over / slope
        stepped = state.join(sums, "key", "left").withColumns({"over": over, "low": low, "high": high, "moved": moved})
        # bounds far out are only signs so far: go out from the tilt by doubling
        middle = (
            F.when(F.col("high") >= 1e6, F.greatest(F.col("tilt") * 2, F.lit(1.0)))
            .when(F.col("low") <= -1e6, F.least(F.col("tilt") * 2, F.lit(-1.0)))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = F.col("moved").isNotNull() & (F.col("moved") > F.col("low")) & (F.col("moved") < F.col("high"))
        # rates are rounded, so no tilt is sure to come nearer than one unit of every document
        near = (F.abs("over") <= F.greatest(TOLERANCE * F.col("target"), F.col("least"))) | (F.col("high") - F.col("low") < 1e-12)
        state = written(
            stepped.select(
                "key",
                "unit",
                "target",
                "least",
                F.when(F.col("done") | near, F.col("tilt")).when(inside, F.col("moved")).otherwise(middle).alias("tilt"),
                "low",
                "high",
                (F.col("done") | F.coalesce(near, F.lit(True))).alias("done"),
            ),
            "tilts",
        )
        if state.filter(~F.col("done")).isEmpty():
            return state.select("key", "unit", "tilt")
    raise RuntimeError(f"no rates that give every source its target after {MAX_STEPS} steps")


def copies(histogram: DataFrame, multipliers: DataFrame, cap: int = CAP) -> DataFrame:
    """``key, size, base, extra``: every document of a source and size gets ``base`` copies, ``extra`` of them one more.

    What rounding leaves over is carried in words from one size to the next smaller, so a source misses its target by
    what its smallest documents leave over. A source's rows are its different sizes, as many as its longest document has words at most.
    """
    most = cap * _UNIT
    rate = histogram.join(multipliers, "key").withColumn("rate", F.least(_rate(cap), F.lit(most)).cast("long"))

    def rounded(sizes: pa.Table) -> pa.Table:
        sizes = sizes.sort_by([("size", "descending")])
        owed, extra = 0, []
        for size, n, part in zip(*(sizes.column(c).to_pylist() for c in ("size", "n", "rate")), strict=True):
            owed += n * (part % _UNIT) * size
            more = min(n, max(0, (2 * owed + size * _UNIT) // (2 * size * _UNIT))) if part < most else 0
            owed -= more * size * _UNIT
            extra.append(more)
        base = pc.divide(sizes.column("rate"), _UNIT)
        return pa.table({"key": sizes.column("key"), "size": sizes.column("size"), "base": base, "extra": pa.array(extra, pa.int64())})

    return rate.select("key", "size", "n", "rate").groupBy("key").applyInArrow(rounded, "key string, size long, base long, extra long")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row of ``docs`` (``doc_id, text, source``).

    Null text has size 0; documents without words get no copy, as nothing of them can be taken. A null source is a source
    of its own, last. Which of equal documents get one more copy follows from a hash of their ids, so reruns agree.
    Repeated rows count on their own. An empty table gives no rows.
    """
    return _mixed(docs, weights, cap, [])


def _mixed(docs: DataFrame, weights: Sequence[float], cap: int, more: Sequence[str]) -> DataFrame:
    """The rows of :func:`mixed` with the columns ``more`` of ``docs``, which also tell rows of one id apart."""
    sizes = written(sized(docs, more), "sizes")
    goals = written(targets(sizes, weights, cap), "targets")
    histogram = written(
        sizes.filter("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "histogram"
    )
    plan = copies(histogram, tilts(histogram, goals.filter("target > 0"), cap), cap)
    rows = sizes.count()
    per_key = histogram.join(plan, ["key", "size"], "left").select(
        "key", "size", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("extra", F.lit(0)).alias("extra")
    )
    none = sizes.filter("size = 0").select("doc_id", *more, "key", "size", F.lit(0).cast("long").alias("copies"))
    # rows without an id are dealt out by what tells them apart
    apart = F.when(F.col("doc_id").isNull(), F.hash(*more)) if more else F.lit(None).cast("int")
    worded = sizes.filter("size > 0").drop("source").withColumn("apart", apart)
    some = ranked(worded, ["key", "size"], ["doc_id", *more], rows, per_key, ["doc_id", "apart"]).select(
        "doc_id", *more, "key", "size", (F.col("base") + (F.col("rank") < F.col("extra")).cast("long")).alias("copies")
    )
    return (
        some.unionByName(none)
        .join(goals, "key")
        .select("doc_id", *more, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def repeated(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, with all columns, as often as the mix takes them.

    Copies belong to rows, told apart by all of their columns, so rows with a null id or with one id are taken each as
    :func:`mixed` says, and equal rows together as often as the mix takes all of them. Rows without words are left out, as nothing of them is taken.
    """
    # nulls leave such a hash as it is, so which columns are null counts too
    values = [*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"`{c}`").isNull() for c in docs.columns)]
    key = ["_mix_row", "_mix_row2"]
    keyed = docs.withColumns({key[0]: F.xxhash64(*values), key[1]: F.xxhash64(F.lit("second"), *values)})
    times = _mixed(keyed, weights, cap, key).groupBy(*key).agg(F.sum("copies").cast("int").alias("_mix_times")).filter("_mix_times > 0")
    # equal rows become one before they meet, so any number of them is one row for each task
    joined = keyed.dropDuplicates(key).join(times, key)
    return joined.withColumn("_mix_time", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*(f"`{c}`" for c in docs.columns))
