"""Zone-free timestamp arithmetic.

Telemetry timestamps carry no zone, so they live in TIMESTAMP_NTZ and all
arithmetic is done on whole microseconds. Nothing depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND


def naive(value: str | Column) -> Column:
    """A literal or column as a zone-free timestamp."""
    column = F.lit(value) if isinstance(value, str) else value
    return column.cast("timestamp_ntz")


def micros(column: str | Column) -> Column:
    """Whole microseconds since 1970."""
    column = F.col(column) if isinstance(column, str) else column
    return F.timestamp_diff("MICROSECOND", naive("1970-01-01 00:00:00"), column)


def from_micros(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.timestamp_add("MICROSECOND", column, naive("1970-01-01 00:00:00"))


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(HOUR))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(SECOND))


def floor_div(column: Column, width: int) -> Column:
    """Integer division rounding towards minus infinity, exact on longs."""
    width_column = F.lit(width).cast("long")
    return ((column - F.pmod(column, width_column)) / width_column).cast("long")


def iso_text(column: Column) -> Column:
    """``yyyy-mm-ddThh:mm:ss`` with six decimals only when there is a fraction."""
    text = F.replace(column.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)
