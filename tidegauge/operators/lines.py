"""Message lines to columns, built-in form and user-function form."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import messages as msg


def parse_cost(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds cost (NULL for a bad tag), cost in seconds and line length."""
    return lines.withColumns({"cpu_pause_ms": msg.cost_ms(F.col(line))}).withColumns(
        {"pause_sec": msg.to_seconds(F.col("cpu_pause_ms")), "line_length": F.length(line)}
    )


def bad_cost_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines without a readable cost: set aside instead of failing the batch."""
    return lines.where(msg.cost_ms(F.col(line)).isNull())


def parse_header(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds the parts of a full header: cost, file name and the time in the file name."""
    column = F.col(line)
    return lines.withColumns(
        {"header_cost_ms": msg.header_part(column, 1).try_cast("int"), "name": msg.header_part(column, 2)}
    ).withColumn("name_s", msg.name_seconds(F.col("name")))


def map_lines(
    df: DataFrame, function: Callable[[pd.Series], pd.Series], returns: str, out: str, line: str = "line"
) -> DataFrame:
    """Adds a column from a user's function over whole column batches."""
    return df.withColumn(out, F.pandas_udf(function, returns)(F.col(line)))


def cost_by_slicing() -> Callable[[pd.Series], pd.Series]:
    """A function for ``map_lines`` that reads the cost tag; agrees with ``parse_cost``.

    It is made here rather than at module level so that Spark sends its code: workers need not have this package.
    """

    def cost(lines: pd.Series) -> pd.Series:
        tag = lines.str.slice(1, 7).str.strip()
        return pd.to_numeric(tag.where(tag.str.fullmatch(r"[+-]?[0-9]+"))).astype("Int32")

    return cost
