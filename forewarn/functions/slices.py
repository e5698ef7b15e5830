"""Slices of an order that hold about equally many rows, whatever the values do."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quantiles that one look at the rows estimates; also the largest number of slices.
MOST_SLICES = 2048
# Borders that are compared one by one, in each of two levels.
_GROUP = 64


def slice_borders(rows: DataFrame, column: str, rows_per_slice: int, most: int = MOST_SLICES) -> list[int]:
    """Values of a whole-number column at which slices of about ``rows_per_slice`` rows begin, but for the first.

    One aggregation estimates quantiles (to a tenth of a slice); the driver reads at most ``most`` numbers. Beyond
    that many slices they grow with the rows.
    """
    shares = [i / most for i in range(1, most)]
    found = rows.agg(F.count(column).alias("n"), F.percentile_approx(column, shares, 10 * most).alias("at")).first()
    slices = min(most, -(-found["n"] // max(1, rows_per_slice)))
    if slices < 2:
        return []
    picked = {found["at"][min(most - 1, round(i * most / slices)) - 1] for i in range(1, slices)}
    return sorted(picked)


def slice_number(value: Column, borders: Sequence[int]) -> Column:
    """How many borders are at or below a value; 0 for null."""
    if not borders:
        return F.lit(0)

    def reached(among: Column) -> Column:
        return F.size(F.filter(among, lambda border: border <= value))

    def longs(values: Sequence[int]) -> Column:
        return F.array(*[F.lit(int(v)).cast("long") for v in values])

    if len(borders) <= _GROUP:
        return reached(longs(borders))
    groups = [list(borders[i : i + _GROUP]) for i in range(0, len(borders), _GROUP)]
    before = reached(longs([group[0] for group in groups])) - 1
    own = F.get(F.array(*[longs(group) for group in groups]), before)
    return F.when(before < 0, 0).otherwise(before * _GROUP + F.coalesce(reached(own), F.lit(0)))
