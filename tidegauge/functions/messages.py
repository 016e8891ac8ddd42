"""Message lines and file names: rendering, padding, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge import settings


def cost_ms(line: Column) -> Column:
    """CPU cost from characters 1..6 of a line; NULL when they are no integer."""
    return F.substring(line, 2, 6).try_cast("int")


def to_seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def header_part(line: Column, group: int) -> Column:
    """Part of a full header: 1 is the cost digits, 2 the file name; NULL when absent."""
    return F.nullif(F.regexp_extract(line, r"^C([0-9]{6})-F([^-]+)-", group), F.lit(""))


def render_header(cost: Column, name: Column) -> Column:
    """``C<6-digit cost>-F<name>-``; a cost of seven digits overflows the tag."""
    usual = F.lpad(cost.cast("string"), 6, "0")
    digits = F.when(cost.between(0, 999_999), usual).otherwise(F.format_string("%06d", cost))
    return F.concat(F.lit("C"), digits, F.lit("-F"), name, F.lit("-"))


def pad_message(header: Column, size: Column, padding: str = settings.PADDING) -> Column:
    """Header padded to ``size`` characters; NULL for sizes below the header's, or beyond what a text can have."""
    return F.when(size >= F.length(header), F.rpad(header, size.try_cast("int"), padding))


def file_name(unix_sec: Column, counter: Column) -> Column:
    """``<unix seconds>_<10-digit counter>``, the counter wrapping at a million."""
    wrapped = (counter % F.lit(1_000_000)).cast("string")
    return F.concat_ws("_", unix_sec.cast("string"), F.lpad(wrapped, 10, "0"))


def message_id(unix_us: Column, counter: Column) -> Column:
    """Id inside a message: float seconds and a masked counter (a bitwise and, so ids repeat)."""
    sec = F.floor(unix_us / F.lit(1_000_000)).cast("bigint")
    text = F.format_string("%d.%06d", sec, unix_us - sec * F.lit(1_000_000))
    trimmed = F.regexp_replace(text, r"(\.[0-9]+?)0+$", "$1")
    masked = counter.bitwiseAND(F.lit(10_000_000)).cast("string")
    return F.concat_ws("_", trimmed, F.lpad(masked, 8, "0"))


def name_seconds(name: Column) -> Column:
    """Unix seconds at the front of a file name; NULL when it is no integer."""
    return F.split(name, "_", 2).getItem(0).try_cast("bigint")


def params_key(cost: Column, size: Column, period: Column) -> Column:
    """One text per parameter setting, fields in alphabetical order."""
    return F.to_json(
        F.struct(
            cost.alias("cpu_pause_ms"), size.alias("message_bytes"), period.alias("period_sec")
        )
    )


def period_of(frequency: Column) -> Column:
    return F.lit(1.0) / frequency


def whole_rate(period: Column) -> Column:
    """Messages sent per second at a period: truncated, so some rates lose one."""
    return F.floor(F.lit(1.0) / period).cast("int")
