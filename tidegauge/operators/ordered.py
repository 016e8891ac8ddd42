"""Order-dependent columns over long series: last value so far, previous value, running totals.

A plain window over ``partitionBy(key)`` sends a whole series to one task, so a source that holds a third of the rows would run
alone at the end. Here every series is cut into spans of a fixed length of time. Each span is a window of its own,
which starts from one extra row that carries the state of the spans before it. That state comes from the end of each
span, reduced on the map side, so what is ordered by key alone is one row for each key and span, whatever the traffic.
The plan is the same for every table, and nothing runs before the action.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000

_SPAN, _SEED = "_segment", "_seed"


@dataclass(frozen=True)
class Series:
    """Rows of one series share ``keys``; ``at``, a whole number, and then ``tie`` give their order.

    ``span`` is the length of a window in units of ``at``. Rows without a time come first, in a window of their own.
    """

    keys: list[str]
    at: str
    tie: list[str]
    span: int = HOUR_US

    def position(self) -> Column:
        return F.struct(self.at, *self.tie)

    def span_number(self) -> Column:
        return F.floor(F.col(self.at) / F.lit(self.span))


def _over(
    df: DataFrame,
    series: Series,
    columns: dict[str, Column],
    ends: dict[str, Column],
    carried: dict[str, Column],
    results: dict[str, Callable[[WindowSpec], Column]],
) -> DataFrame:
    """Adds ``results``, each computed over the ordered window it is given.

    ``columns`` prepares helper columns per row, ``ends`` folds them to the state at the end of a span, and
    ``carried`` combines the ends of earlier spans. Both name their results like the helper columns, so the
    extra row of a span looks like one more row at its front.
    """
    kept = df.columns
    rows = df.withColumns(columns).withColumn(_SPAN, series.span_number())
    earlier = Window.partitionBy(*series.keys).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        rows.groupBy(*series.keys, _SPAN)
        .agg(*[c.alias(k) for k, c in ends.items()])
        .select(*series.keys, _SPAN, *[c.over(earlier).alias(k) for k, c in carried.items()])
        .withColumn(_SEED, F.lit(0))
    )
    both = rows.withColumn(_SEED, F.lit(1)).unionByName(seeds, allowMissingColumns=True)
    window = Window.partitionBy(*series.keys, _SPAN).orderBy(_SEED, series.at, *series.tie)
    done = both.withColumns({k: c(window) for k, c in results.items()})
    return done.where(F.col(_SEED) == 1).select(*kept, *results)


def _so_far(column: Column) -> Callable[[WindowSpec], Column]:
    return lambda window: column.over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def carry_last(df: DataFrame, series: Series, values: dict[str, Column]) -> DataFrame:
    """Adds for each value its newest non-null one up to and with the current row."""
    order = series.position()
    helper = {name: f"_value_{name}" for name in values}
    return _over(
        df,
        series,
        columns={helper[n]: c for n, c in values.items()},
        ends={h: F.max_by(h, F.when(F.col(h).isNotNull(), order)) for h in helper.values()},
        carried={h: F.last(h, ignorenulls=True) for h in helper.values()},
        results={n: _so_far(F.last(helper[n], ignorenulls=True)) for n in values},
    )


def previous(df: DataFrame, series: Series, name: str) -> DataFrame:
    """Adds the ``at`` of the row before, NULL for the first row of a series."""
    return _over(
        df,
        series,
        columns={"_at": F.col(series.at)},
        ends={"_at": F.max("_at")},
        carried={"_at": F.last("_at", ignorenulls=True)},
        results={name: lambda window: F.lag("_at").over(window)},
    )


def running(df: DataFrame, series: Series, sums: dict[str, Column], greatest: dict[str, Column]) -> DataFrame:
    """Adds the sum so far, or the greatest value so far, of each column, with the current row."""
    helper = {name: f"_value_{name}" for name in (*sums, *greatest)}
    fold = {n: F.sum if n in sums else F.max for n in helper}
    return _over(
        df,
        series,
        columns={helper[n]: c for n, c in (sums | greatest).items()},
        ends={h: fold[n](h) for n, h in helper.items()},
        carried={h: fold[n](h) for n, h in helper.items()},
        results={n: _so_far(fold[n](h)) for n, h in helper.items()},
    )
