"""Failure labels: active-failure overlap and forward as-of join to the next failure."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions.ordered import join_summary
from forewarn.functions.slices import slice_borders, slice_number
from forewarn.functions.timeline import HOUR, hours_between, micros, naive
from forewarn.spec import require_columns

# Up to this many intervals are compared one by one inside the scan; a longer list
# becomes a table and goes through label_windows_from_table, with the same result.
LITERAL_FAILURES = 64
# Windows and failures that one task orders at a time.
ROWS_PER_SLICE = 500_000


def _one_of(columns: list[Column], combine) -> Column:
    return columns[0] if len(columns) == 1 else combine(*columns)


def label_windows(windows: DataFrame, failures: Sequence[tuple]) -> DataFrame:
    """Add ``in_failure`` and ``hours_to_next_failure`` from a list of intervals.

    Intervals are half-open: a window that ends exactly when a failure starts is
    not in it (and is 0 hours away); one that starts when it ends is past it.
    A short list runs inside the scan stage, without shuffle or join.
    """
    require_columns(windows.columns, ["window_start", "window_end"], "windows")
    if not failures:
        raise ValueError("no failure interval is given")
    if len(failures) > LITERAL_FAILURES:
        rows = windows.sparkSession.createDataFrame([(str(f[0]), str(f[1])) for f in failures], "a string, b string")
        intervals = rows.select(
            F.col("a").cast("timestamp_ntz").alias("failure_start"), F.col("b").cast("timestamp_ntz").alias("failure_end")
        )
        return label_windows_from_table(windows, intervals)
    start, end = F.col("window_start"), F.col("window_end")
    active = reduce(
        lambda a, b: a | b, [(naive(f[0]) < end) & (naive(f[1]) > start) for f in failures]
    )
    following = _one_of([F.when(naive(f[0]) >= end, naive(f[0])) for f in failures], F.least)
    return windows.withColumns(
        {"in_failure": active, "hours_to_next_failure": hours_between(end, following)}
    )


def label_windows_from_table(
    windows: DataFrame,
    failures: DataFrame,
    asset_cols: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The same two columns from a failure table of any size, per asset.

    Windows (at their end) and failures (at their start) are merged into one ordered stream per (asset, time slice).
    Slices are cut at quantiles of the merged times, so a minute that holds most events is many slices and a quiet
    year is one. The latest failure end seen before a window tells whether one is active; the next failure start after
    it gives the as-of match. One summary row per slice carries both across slices, so windows are never paired with
    failures.

    Failures of an asset that start together count as the one that ends last. Windows need nothing of each other:
    where more of them than a slice should hold end at one instant, they are dealt to parts that each get the slice's
    failures. A failure without a start matches nothing.
    """
    keys = list(asset_cols)
    require_columns(windows.columns, [*keys, "window_start", "window_end"], "windows")
    require_columns(failures.columns, [*keys, "failure_start", "failure_end"], "failures")
    names = [name for name in windows.columns if name not in keys]
    left = windows.select(
        *keys,
        F.struct(*names).alias("_window"),
        micros("window_end").alias("_t"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("_start"),
        F.lit(None).cast("long").alias("_stop"),
    )
    together = (
        failures.where(F.col("failure_start").isNotNull())
        .groupBy(*keys, micros("failure_start").alias("_start"))
        .agg(F.max(micros("failure_end")).alias("_stop"))
    )
    right = together.select(
        *keys,
        F.lit(None).cast(left.schema["_window"].dataType).alias("_window"),
        F.col("_start").alias("_t"),
        F.lit(1).alias("_kind"),
        "_start",
        "_stop",
    )
    merged = left.unionByName(right)
    times = left.select("_t").unionByName(right.select("_t"))
    borders = slice_borders(times, "_t", rows_per_slice)
    merged = merged.withColumn("_slice", slice_number(F.col("_t"), borders))

    across = Window.partitionBy(*keys).orderBy("_slice")
    slices = (
        left.select(*keys, "_t", "_kind", "_start", "_stop")
        .unionByName(right.select(*keys, "_t", "_kind", "_start", "_stop"))
        .withColumn("_slice", slice_number(F.col("_t"), borders))
        .groupBy(*keys, "_slice")
        .agg(
            F.max("_stop").alias("_slice_stop"),
            F.min("_start").alias("_slice_start"),
            F.greatest(F.lit(1), F.ceil(F.count_if(F.col("_kind") == 0) / F.lit(2 * rows_per_slice))).alias("_parts"),
        )
        .select(
            *keys,
            "_slice",
            "_parts",
            F.max("_slice_stop").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_stop_before"),
            F.min("_slice_start").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_start_after"),
        )
    )
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)
    somewhere = F.array(F.pmod(F.xxhash64(F.struct("_t", "_window")), F.col("_parts")))
    dealt = join_summary(merged, slices, [*keys, "_slice"]).withColumn(
        "_part", F.explode(F.when(F.col("_kind") == 1, everywhere).otherwise(somewhere))
    )
    inside = Window.partitionBy(*keys, "_slice", "_part")
    earlier = inside.orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = inside.orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    stop = F.greatest("_stop_here", "_stop_before")
    nearest = F.least("_start_here", "_start_after")
    return (
        dealt.withColumns({"_stop_here": F.max("_stop").over(earlier), "_start_here": F.min("_start").over(later)})
        .where(F.col("_kind") == 0)
        .select(
            *keys,
            "_window.*",
            F.coalesce(stop > micros(F.col("_window.window_start")), F.lit(False)).alias("in_failure"),
            ((nearest - F.col("_t")) / F.lit(float(HOUR))).alias("hours_to_next_failure"),
        )
    )


def within_horizon(horizon_hours: Column | float) -> Column:
    """1 when the next failure starts within the horizon, else 0."""
    if isinstance(horizon_hours, (int, float)) and horizon_hours < 0:
        raise ValueError("horizon_hours must be non-negative")
    limit = horizon_hours if isinstance(horizon_hours, Column) else F.lit(float(horizon_hours))
    return F.coalesce(F.col("hours_to_next_failure") <= limit, F.lit(False)).cast("int")


def label_horizon(labelled: DataFrame, horizon_hours: float) -> DataFrame:
    """Add ``failure_within_horizon`` for one horizon."""
    return labelled.withColumn("failure_within_horizon", within_horizon(horizon_hours))


def label_horizons(labelled: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One copy of each window per horizon, with ``horizon_hours`` and its label."""
    if any(h < 0 for h in horizons):
        raise ValueError("horizon_hours must be non-negative")
    return labelled.withColumn(
        "horizon_hours", F.explode(F.array(*[F.lit(int(h)) for h in horizons]))
    ).withColumn("failure_within_horizon", within_horizon(F.col("horizon_hours").cast("double")))


def bad_windows(windows: DataFrame) -> DataFrame:
    """Counts of windows whose bounds are unusable."""
    start, end = F.col("window_start"), F.col("window_end")
    return windows.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(start.isNull() | end.isNull()).alias("missing_bounds"),
        F.count_if(end <= start).alias("not_increasing"),
    )
