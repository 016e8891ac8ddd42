"""Time columns: unix seconds and micros, batch times, log times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Unix microseconds of a timestamp, with or without time zone (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def ceil_seconds(us: Column) -> Column:
    """First whole second at or after a time in micros."""
    return -F.floor(-us / F.lit(1_000_000)).cast("bigint")


def batch_time_seconds(text: Column) -> Column:
    """Unix seconds of ``yyyy-MM-ddTHH:mm:ss.000GMT``; other fractions and zones give NULL."""
    whole = text.like("____-__-__T__:__:__.000GMT") | text.like("____-__-__T__:__:__.000UTC")
    return F.unix_seconds(F.when(whole, F.concat(F.substring(text, 1, 19), F.lit("Z")).try_cast("timestamp")))


def log_time_seconds(text: Column) -> Column:
    """Unix seconds of ``yyyy-MM-dd HH:mm:ss`` read as UTC; anything else gives NULL.

    The shape is tested first and the cast reads it, which is much cheaper than a parser for a format.
    """
    return F.unix_seconds(F.when(text.like("____-__-__ __:__:__"), F.concat(text, F.lit("Z")).try_cast("timestamp")))
