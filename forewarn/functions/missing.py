"""Missing values: null and NaN are one notion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or_null(column: Column) -> Column:
    """Parse as double; unparseable text and NaN become null."""
    parsed = column.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def is_missing(name: str) -> Column:
    """Null or NaN."""
    return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))


def ratio(numerator: Column, denominator: Column, otherwise: Column | None = None) -> Column:
    """Division guarded against a zero denominator."""
    guarded = F.when(denominator != 0, numerator / denominator)
    return guarded if otherwise is None else guarded.otherwise(otherwise)
