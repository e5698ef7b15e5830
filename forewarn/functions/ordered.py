"""Ordered scans over groups of any size.

``lag`` and running sums over one huge group would put the whole group into one
task. Here every ordered scan is done in two levels: rows are windowed inside
(keys, chunk), where a chunk is a bounded slice of the order, and one summary
row per chunk carries the state from chunk to chunk. The summary is the only
thing windowed by the bare keys; its size is the number of chunks, not rows.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def join_summary(rows: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a per-chunk summary, in which a null key meets a null key."""
    renamed = summary.withColumnsRenamed({name: f"_on_{name}" for name in on})
    same = [F.col(name).eqNullSafe(F.col(f"_on_{name}")) for name in on]
    return rows.join(renamed, same, "left").drop(*[f"_on_{name}" for name in on])


def previous_in_order(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
) -> DataFrame:
    """Add the previous row's value of some columns, across chunk borders.

    ``columns`` maps output name -> source column. ``chunk`` must be
    non-decreasing in ``order``. The first row of a key gets null.
    """
    keys, chunk = list(keys), list(chunk)
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order)
    tails = df.groupBy(*keys, *chunk).agg(
        *[F.max_by(source, _order_key(order)).alias(f"_tail_{name}") for name, source in columns.items()]
    )
    across = Window.partitionBy(*keys).orderBy(*chunk)
    carried = tails.select(
        *keys, *chunk, *[F.lag(f"_tail_{name}").over(across).alias(f"_carried_{name}") for name in columns]
    )
    local = df.withColumns(
        {"_place": F.row_number().over(inside)}
        | {f"_local_{name}": F.lag(source).over(inside) for name, source in columns.items()}
    )
    joined = join_summary(local, carried, [*keys, *chunk])
    picked = {
        name: F.when(F.col("_place") == 1, F.col(f"_carried_{name}")).otherwise(F.col(f"_local_{name}"))
        for name in columns
    }
    helpers = ["_place", *[f"_local_{n}" for n in columns], *[f"_carried_{n}" for n in columns]]
    return joined.withColumns(picked).drop(*helpers)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[Column | str],
    columns: Mapping[str, str],
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums of some columns, across chunk borders.

    ``columns`` maps output name -> source column. With ``descending`` both the
    order and the chunks run from high to low.
    """
    keys, chunk = list(keys), list(chunk)
    direction = F.desc if descending else F.asc
    inside = (
        Window.partitionBy(*keys, *chunk)
        .orderBy(*[direction(c) if isinstance(c, str) else c for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(*[direction(c) for c in chunk])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_chunk = df.groupBy(*keys, *chunk).agg(*[F.sum(s).alias(f"_chunk_{n}") for n, s in columns.items()])
    before = per_chunk.select(
        *keys,
        *chunk,
        *[F.coalesce(F.sum(f"_chunk_{n}").over(across), F.lit(0)).alias(f"_before_{n}") for n in columns],
    )
    local = df.withColumns({f"_inside_{n}": F.sum(s).over(inside) for n, s in columns.items()})
    joined = join_summary(local, before, [*keys, *chunk])
    totals = {n: F.col(f"_inside_{n}") + F.col(f"_before_{n}") for n in columns}
    return joined.withColumns(totals).drop(
        *[f"_inside_{n}" for n in columns], *[f"_before_{n}" for n in columns]
    )
