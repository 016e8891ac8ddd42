"""Word counts. Words are split on single spaces, so doubled spaces give empty words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.counts import batch_start


def words_of(line: Column) -> Column:
    return F.split(line, " ", -1)


def words_of_text(text: Column) -> Column:
    """Words of all lines of a text: line ends and spaces both separate words."""
    return words_of(F.replace(text, F.lit("\n"), F.lit(" ")))


def word_count(df: DataFrame, words: Column) -> DataFrame:
    """Occurrences of each word; frequent words are summed on the map side."""
    return _exploded(df.select(words.alias("words"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _exploded(df: DataFrame) -> DataFrame:
    """One row per word. The outer form splits each text once; only a missing text gives no word."""
    kept = [c for c in df.columns if c != "words"]
    return df.select(*kept, F.explode_outer("words").alias("word")).where(F.col("word").isNotNull())


def word_count_per_batch(lines: DataFrame, interval_sec: int, ts: str = "ts", line: str = "line") -> DataFrame:
    """Occurrences of each word in each batch; nothing is kept from one batch to the next."""
    split = lines.select(batch_start(ts, interval_sec).alias("batch_start_s"), words_of(F.col(line)).alias("words"))
    return _exploded(split).groupBy("batch_start_s", "word").agg(F.count(F.lit(1)).alias("n"))
