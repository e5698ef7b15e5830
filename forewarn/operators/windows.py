"""Sliding feature windows anchored at each segment's first reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions.timeline import HOUR, SECOND, floor_div, iso_text
from forewarn.spec import TelemetrySpec, WindowPolicy, require_columns

# Columns of a window table that are never model features (fixed values).
NON_FEATURE_COLUMNS = (
    "segment_id",
    "window_id",
    "window_index",
    "window_start",
    "window_end",
    "rows",
    "cadence_seconds",
    "failure_within_horizon",
    "in_failure",
    "hours_to_next_failure",
    "horizon_hours",
    "seed",
    "true_label",
)


def assign_windows(segmented: DataFrame, spec: TelemetrySpec, policy: WindowPolicy) -> DataFrame:
    """Repeat each reading once per window that contains it, adding ``window_index``.

    Window k of a segment covers ``[start + k*step, start + k*step + size)``, so the
    windows of a reading follow from its offset by arithmetic: the containment
    join becomes an equality on (segment, index).
    """
    size, step = policy.window_seconds * SECOND, policy.step_seconds * SECOND
    offset = F.col("offset_us")
    return (
        segmented.withColumns(
            {
                "_low": F.greatest(F.lit(0).cast("long"), floor_div(offset - size, step) + 1),
                "_high": floor_div(offset, step),
            }
        )
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("window_index", F.explode(F.sequence("_low", "_high")))
        .drop("_low", "_high")
    )


def _feature_aggregates(spec: TelemetrySpec) -> list[Column]:
    stamp = F.col("offset_us")
    elapsed = (F.max(stamp) - F.min(stamp)) / float(HOUR)
    columns = []
    for sensor in spec.analogue:
        change = F.max_by(sensor, stamp) - F.min_by(sensor, stamp)
        columns += [
            F.avg(sensor).alias(f"{sensor}_mean"),
            F.stddev_pop(sensor).alias(f"{sensor}_std"),
            F.min(sensor).alias(f"{sensor}_min"),
            F.max(sensor).alias(f"{sensor}_max"),
            F.when(elapsed > 0, change / elapsed).alias(f"{sensor}_roc_per_hour"),
        ]
    minuend, subtrahend = spec.difference
    step_change = F.abs(F.col(spec.volatility) - F.col(f"previous_{spec.volatility}"))
    columns += [
        F.avg(F.col(minuend) - F.col(subtrahend)).alias("pressure_diff_mean"),
        F.avg(spec.duty).alias("comp_duty_cycle"),
        # Successive differences count only when both readings lie in the window.
        F.avg(F.when(stamp - F.col("gap_us") >= F.col("_window_offset"), step_change)).alias(
            "motor_current_volatility"
        ),
    ]
    return columns


def window_features(
    segmented: DataFrame, profile: DataFrame, spec: TelemetrySpec, policy: WindowPolicy
) -> DataFrame:
    """One row of features per accepted window.

    A window is accepted when it ends no later than one cadence after the
    segment's last reading and holds enough readings for the segment's cadence.
    Readings are reduced map-side to (segment, index) before anything is joined;
    only finished windows meet the per-segment ``profile``.
    """
    require_columns(
        segmented.columns,
        ["segment_id", "segment_start", "offset_us", "gap_us", f"previous_{spec.volatility}"],
        "segmented telemetry",
    )
    size, step = policy.window_seconds * SECOND, policy.step_seconds * SECOND
    keys = [*spec.asset_cols, "segment_id"]
    in_windows = assign_windows(segmented, spec, policy).select(
        *keys,
        "window_index",
        *spec.channels,
        f"previous_{spec.volatility}",
        "offset_us",
        "gap_us",
        (F.col("window_index") * step).alias("_window_offset"),
    )
    windows = in_windows.groupBy(*keys, "window_index").agg(
        F.count(F.lit(1)).alias("rows"), *_feature_aggregates(spec)
    )
    cadence = F.col("cadence_seconds")
    # bround rounds half to even, like the rule it stands for.
    expected = F.greatest(F.lit(1.0), F.bround(F.lit(float(policy.window_seconds)) / cadence))
    least_rows = F.greatest(F.lit(1.0), F.floor(expected * policy.min_coverage))
    length = F.timestamp_diff("MICROSECOND", F.col("segment_start"), F.col("segment_end"))
    segments = profile.select(
        *keys, "cadence_seconds", "segment_start", (length + cadence * float(SECOND)).alias("_limit")
    ).where(cadence <= policy.window_seconds)
    begins = F.col("window_index") * step
    return (
        windows.join(segments, keys)
        .where((begins + size <= F.col("_limit")) & (F.col("rows") >= least_rows))
        .select(
            *keys,
            "window_index",
            F.timestamp_add("MICROSECOND", begins, F.col("segment_start")).alias("window_start"),
            F.timestamp_add("MICROSECOND", begins + size, F.col("segment_start")).alias("window_end"),
            "rows",
            "cadence_seconds",
            *spec.feature_names,
        )
    )


def degenerate_windows(windows: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Windows whose readings do not span any time, so no rate of change exists."""
    rate = f"{next(iter(spec.analogue))}_roc_per_hour"
    return windows.where(F.col(rate).isNull())


def require_rates(windows: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """The same windows; the job fails on the first one without a rate of change."""
    rate = f"{next(iter(spec.analogue))}_roc_per_hour"
    message = F.lit("the readings of a feature window span no time")
    return windows.withColumn(
        rate, F.when(F.col(rate).isNull(), F.raise_error(message).cast("double")).otherwise(F.col(rate))
    )


def window_id(spec: TelemetrySpec) -> Column:
    """Text identity of a window: asset columns, segment, start and end."""
    return F.concat_ws(
        ":",
        *[F.col(name).cast("string") for name in spec.asset_cols],
        F.col("segment_id").cast("string"),
        iso_text(F.col("window_start")),
        iso_text(F.col("window_end")),
    )


def predictive_windows(labelled: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Windows outside active failures, with their identity."""
    return labelled.where(~F.col("in_failure")).withColumn("window_id", window_id(spec))


def feature_columns(df: DataFrame, also_exclude: tuple[str, ...] = (), spec: TelemetrySpec | None = None) -> list[str]:
    """Numeric columns that describe readings rather than identity, grid cell or outcome.

    With ``spec`` its asset columns are left out too.
    """
    from pyspark.sql.types import NumericType

    skipped = {*NON_FEATURE_COLUMNS, *also_exclude, *(spec.asset_cols if spec else ())}
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skipped]
