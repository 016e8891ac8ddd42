"""Application log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: timestamp, level, logger, line number, message. Only \n ends a line here (flag d),
# and trailing line ends stay out of the message.
LINE_PATTERN = r"(?d)^([0-9]{4}-.{14})\s([A-Z]+)\s+([^:]+):([0-9]+)\s-\s(.*?)[\n\r]*$"

FIELDS = ["timestamp_str", "level", "logger_name", "linenumber", "message"]

# Order of the fields in one text with line ends between them. Only a logger name could hold a line end, so it is last.
_JOINED = "$1\n$2\n$4\n$5\n$3"
_POSITION = {"timestamp_str": 0, "level": 1, "linenumber": 2, "message": 3, "logger_name": 4}


def log_parts(line: Column) -> Column:
    """All fields of a log line in one array, so the pattern is not matched again for each; NULL without a match."""
    joined = F.regexp_replace(line, LINE_PATTERN, _JOINED)
    return F.when(line.rlike(LINE_PATTERN), F.split(joined, "\n", 5))


def log_field(parts: Column, name: str) -> Column:
    return F.get(parts, _POSITION[name])


def message_pattern(logger: str, text: str = "") -> str:
    """The line pattern for one logger and a text its message holds; the only group is the message."""
    held = f".*\\Q{text}\\E" if text else ""
    return rf"(?d)^[0-9]{{4}}-.{{14}}\s[A-Z]+\s+\Q{logger}\E:[0-9]+\s-\s({held}.*?)[\n\r]*$"


def first_integer(text: Column) -> Column:
    """First run of digits in a text, as a number; NULL when there is none."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("bigint")
