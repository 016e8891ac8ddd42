"""Which files of a watched directory count: visible, fresh, new, expired.

The conditions are columns, so they work on listings, on ``_metadata`` of a batch read and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.functions.messages import name_seconds


def is_visible(name: Column) -> Column:
    return ~name.startswith(settings.HIDDEN_PREFIX)


def is_fresh(name: Column, now: Column, interval_sec: int = settings.BATCH_INTERVAL_SEC) -> Column:
    """True up to two batches after the time in the name; NULL when the name has no time."""
    return now < name_seconds(name) + F.lit(2 * interval_sec)


def is_expired(name: Column, mtime_s: Column, now: Column, keep_sec: int = settings.RETENTION_SEC) -> Column:
    return (now > mtime_s + F.lit(keep_sec)) & ~name.contains(settings.IN_PROGRESS_PREFIX)


def visible_files(files: DataFrame, name: str = "name") -> DataFrame:
    return files.where(is_visible(F.col(name)))


def fresh_files(files: DataFrame, now: Column, name: str = "name", **kwargs) -> DataFrame:
    """Visible files that are not too old by their name; late ones are dropped on purpose."""
    return visible_files(files, name).where(is_fresh(F.col(name), now, **kwargs))


def unreadable_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Visible files whose name has no time: set aside instead of failing the job."""
    return visible_files(files, name).where(name_seconds(F.col(name)).isNull())


def new_files(files: DataFrame, start_s: Column, mtime_s: str = "mtime_s") -> DataFrame:
    """Files written at or after the start of the job."""
    return files.where(F.col(mtime_s) >= start_s)


def expired_files(files: DataFrame, now: Column, **kwargs) -> DataFrame:
    return files.where(is_expired(F.col("name"), F.col("mtime_s"), now, **kwargs))
