"""Fixed-step sequences: resample each window, fill short holes, pack into arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions.timeline import SECOND, floor_div, micros
from forewarn.spec import SequencePolicy, TelemetrySpec, WindowPolicy, require_columns

OBSERVED = "bin_observed_fraction"


def rows_in_windows(rows: DataFrame, windows: DataFrame, spec: TelemetrySpec, window_seconds: int) -> DataFrame:
    """Pair each reading with the windows of its segment that contain it.

    Windows are at most ``window_seconds`` long, so each one touches at most two
    time slices of that width; the join is an equality on (segment, slice) and
    the containment test filters inside it.
    """
    keys = [*spec.asset_cols, "segment_id"]
    width = window_seconds * SECOND
    low, high = floor_div(micros("window_start"), width), floor_div(micros("window_end") - 1, width)
    by_slice = windows.withColumn("_slice", F.explode(F.sequence(low, high)))
    placed = rows.withColumn("_slice", floor_div(micros(spec.timestamp), width))
    stamp = F.col(spec.timestamp)
    return (
        placed.join(by_slice, [*keys, "_slice"])
        .where((stamp >= F.col("window_start")) & (stamp < F.col("window_end")))
        .drop("_slice")
    )


def _means(spec: TelemetrySpec):
    return [F.count(F.lit(1)).alias("rows_in_bin"), *[F.avg(name).alias(name) for name in spec.channels]]


def _steps(windows: DataFrame, steps: int) -> DataFrame:
    return windows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))


def _aligned_bins(
    segmented: DataFrame, windows: DataFrame, spec: TelemetrySpec, policy: WindowPolicy, sequence: SequencePolicy
) -> DataFrame:
    """Bins counted once per segment, then looked up by every window that covers them."""
    keys = [*spec.asset_cols, "segment_id"]
    bins = (
        segmented.withColumn("_bin", floor_div(F.col("offset_us"), sequence.bin_seconds * SECOND))
        .groupBy(*keys, "_bin")
        .agg(*_means(spec))
    )
    per_step = policy.step_seconds // sequence.bin_seconds
    grid = _steps(windows, sequence.steps).withColumn(
        "_bin", F.col("window_index") * per_step + F.col("step")
    )
    return grid.join(bins, [*keys, "_bin"], "left").drop("_bin")


def _window_bins(
    segmented: DataFrame, windows: DataFrame, spec: TelemetrySpec, sequence: SequencePolicy
) -> DataFrame:
    """Bins counted per window, for windows that do not start on a bin border of the segment."""
    keys = [*spec.asset_cols, "segment_id"]
    bounds = windows.select(*keys, "window_id", "window_start", "window_end")
    contained = rows_in_windows(
        segmented.select(*keys, spec.timestamp, *spec.channels),
        bounds,
        spec,
        sequence.bin_seconds * sequence.steps,
    )
    offset = micros(spec.timestamp) - micros("window_start")
    bins = (
        contained.withColumn("step", floor_div(offset, sequence.bin_seconds * SECOND).cast("int"))
        .groupBy("window_id", "step")
        .agg(*_means(spec))
    )
    return _steps(windows, sequence.steps).join(bins, ["window_id", "step"], "left")


def fill_short_holes(binned: DataFrame, spec: TelemetrySpec, max_fill: int) -> DataFrame:
    """Fill at most ``max_fill`` empty steps after a known one, inside each window.

    Analogue channels take the straight line between their known neighbours and
    need both; digital channels repeat the last value and need only the left one.

    The neighbours of all channels come from one scan forward and one backward: each keeps the last known step and
    value, so the work grows with the steps and not with their square.
    """
    inside = Window.partitionBy("window_id").orderBy("step")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("window_id").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    recent = inside.rowsBetween(-max_fill, -1)
    neighbours = {}
    for name in spec.analogue:
        known = F.when(F.col(name).isNotNull(), F.struct(F.col("step"), F.col(name).alias("value")))
        neighbours[f"_left_{name}"] = F.last(known, ignorenulls=True).over(before)
        neighbours[f"_right_{name}"] = F.last(known, ignorenulls=True).over(after)
    for name in spec.digital:
        neighbours[f"_recent_{name}"] = F.last(name, ignorenulls=True).over(recent)
    filled = {}
    for name in spec.analogue:
        left, right = F.col(f"_left_{name}"), F.col(f"_right_{name}")
        near = F.col("step") - left["step"] <= max_fill
        slope = (right["value"] - left["value"]) / (right["step"] - left["step"])
        line = left["value"] + slope * (F.col("step") - left["step"])
        filled[name] = F.coalesce(F.col(name), F.when(near & right["step"].isNotNull(), line))
    for name in spec.digital:
        filled[name] = F.coalesce(F.col(name), F.col(f"_recent_{name}"))
    return binned.withColumns(neighbours).withColumns(filled).drop(*neighbours)


def resample_windows(
    segmented: DataFrame,
    windows: DataFrame,
    spec: TelemetrySpec,
    sequence: SequencePolicy,
    policy: WindowPolicy | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """One row per accepted window and step: channel means, holes filled, observed fraction.

    ``windows`` are predictive windows (with ``window_id``). With a ``policy``
    whose step is a whole number of bins, bins are counted once per segment and
    shared by overlapping windows. ``profile`` supplies a cadence for windows
    that have none.
    """
    keys = [*spec.asset_cols, "segment_id"]
    require_columns(segmented.columns, [*keys, *spec.required], "sequence source")
    require_columns(windows.columns, [*keys, "window_id", "window_start", "window_end"], "windows")
    if policy is not None and policy.window_seconds != sequence.bin_seconds * sequence.steps:
        raise ValueError("bins and steps must make up the window's length")
    if "cadence_seconds" not in windows.columns:
        windows = windows.withColumn("cadence_seconds", F.lit(None).cast("double"))
    if profile is not None:
        fallback = profile.select(*keys, F.col("cadence_seconds").alias("_segment_cadence"))
        windows = windows.join(fallback, keys, "left")
    else:
        windows = windows.withColumn("_segment_cadence", F.lit(None).cast("double"))
    cadence = F.coalesce(F.when(F.col("cadence_seconds") > 0, F.col("cadence_seconds")), "_segment_cadence")
    accepted = windows.select(*keys, "window_id", "window_start", "window_end", *(
        ["window_index"] if "window_index" in windows.columns else []
    ), cadence.alias("_cadence"))

    aligned = (
        policy is not None
        and policy.step_seconds % sequence.bin_seconds == 0
        and "window_index" in windows.columns
        and "offset_us" in segmented.columns
    )
    if aligned:
        binned = _aligned_bins(segmented, accepted, spec, policy, sequence)
    else:
        binned = _window_bins(segmented, accepted, spec, sequence)
    # greatest and least skip nulls, so both inputs are made non-null first.
    known_cadence = F.coalesce(
        "_cadence", F.raise_error(F.concat(F.lit("no cadence is known for "), F.col("window_id"))).cast("double")
    )
    expected = F.greatest(F.lit(1.0), F.lit(float(sequence.bin_seconds)) / known_cadence)
    observed = F.least(F.lit(1.0), F.coalesce("rows_in_bin", F.lit(0)) / expected)
    return fill_short_holes(binned, spec, sequence.max_fill).select(
        *keys, "window_id", "window_start", "window_end", "step", *spec.channels, observed.alias(OBSERVED)
    )


def sequence_channels(spec: TelemetrySpec) -> tuple[str, ...]:
    return (*spec.channels, OBSERVED)


def pack_sequences(steps: DataFrame, spec: TelemetrySpec, sequence: SequencePolicy) -> DataFrame:
    """One row per window: ``sequence`` is array<array<float>> in step and channel order.

    A group is one window, so it holds exactly ``sequence.steps`` small rows; a
    different count fails the job.
    """
    channels = sequence_channels(spec)
    keys = [*spec.asset_cols, "segment_id", "window_id", "window_start", "window_end"]
    vector = F.array(*[F.col(name).cast("float") for name in channels])
    packed = steps.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("step", vector.alias("vector")))).alias("_steps")
    )
    whole = F.transform("_steps", lambda item: item["vector"])
    return packed.select(
        *keys,
        F.when(F.size("_steps") == sequence.steps, whole)
        .otherwise(F.raise_error(F.lit("a window does not have the configured number of steps")))
        .alias("sequence"),
    )


def windows_without_source(segmented: DataFrame, windows: DataFrame, spec: TelemetrySpec, window_seconds: int) -> DataFrame:
    """Windows that cannot be resampled, with the reason."""
    keys = [*spec.asset_cols, "segment_id"]
    bounds = windows.select(*keys, "window_id", "window_start", "window_end")
    no_segment = bounds.join(segmented.select(*keys).distinct(), keys, "left_anti")
    covered = rows_in_windows(
        segmented.select(*keys, spec.timestamp), bounds, spec, window_seconds
    ).select("window_id").distinct()
    no_rows = bounds.join(no_segment.select("window_id"), "window_id", "left_anti").join(
        covered, "window_id", "left_anti"
    )
    return no_segment.select("window_id", F.lit("the segment has no readings").alias("problem")).unionByName(
        no_rows.select("window_id", F.lit("the window has no readings").alias("problem"))
    )
