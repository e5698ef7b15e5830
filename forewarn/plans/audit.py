"""The full data audit: every profile of a raw telemetry table, as tables or one report row."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.operators.labels import label_windows
from forewarn.operators.profile import (
    cadence_summary,
    common_gaps,
    horizon_audit,
    missing_counts,
    resampling_candidates,
    sensor_percentiles,
)
from forewarn.operators.segments import assign_segments, segment_profile
from forewarn.operators.validation import valid_rows, validate, validation_report
from forewarn.operators.windows import window_features
from forewarn.sources.sinks import stage_table, write_report
from forewarn.sources.telemetry import coerce
from forewarn.spec import TelemetrySpec, WindowPolicy


def audit_tables(
    raw: DataFrame,
    spec: TelemetrySpec,
    policy: WindowPolicy,
    failures: Sequence[tuple],
    horizons: Sequence[int],
    boundary: str,
) -> dict:
    """One table per section of the audit. Flagged rows, segments and windows are kept as stages."""
    typed = coerce(raw, spec)
    flagged = stage_table(validate(typed, spec), "flagged")
    segmented = assign_segments(
        valid_rows(flagged), spec, policy.max_gap_seconds, carry=(spec.volatility,),
        keep=lambda ordered: stage_table(ordered, "readings"),
    )
    profile = stage_table(segment_profile(segmented, spec), "profile")
    windows = stage_table(window_features(segmented, profile, spec, policy), "windows")
    cadence = cadence_summary(typed, spec.timestamp, spec.order_cols)
    return {
        "columns": raw.columns,
        "policy": policy,
        "missing_values": missing_counts(raw.drop(*spec.order_cols)),
        "timestamp": cadence,
        "common_gaps": common_gaps(typed, spec.timestamp, spec.order_cols),
        "validation": validation_report(flagged, profile),
        "segments": profile,
        "sensor_percentiles": sensor_percentiles(typed, list(spec.analogue)),
        "windows": windows,
        "horizons": horizon_audit(label_windows(windows, failures), horizons, boundary),
        "resampling_candidates": resampling_candidates(cadence, policy.window_seconds),
    }


def _listed(table: DataFrame, *order: str):
    """The rows of a table of parameter size (sensors, columns, horizons) as one sorted array."""
    columns = [*order, *[c for c in table.columns if c not in order]]
    return table.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows")).scalar()


def _single(table: DataFrame):
    return table.select(F.struct(*table.columns).alias("row")).scalar()


def _count(table: DataFrame):
    return table.agg(F.count(F.lit(1)).alias("n")).scalar()


def audit_report(tables: dict) -> DataFrame:
    """The audit as one nested row.

    Segments are only counted here: their number grows with the data, so they
    stay a table of their own.
    """
    policy = tables["policy"]
    sections = {
        "schema_version": F.lit(1),
        "rows": F.col("_validation.input_rows"),
        "columns": F.array(*[F.lit(c) for c in tables["columns"]]),
        "missing_values": _listed(tables["missing_values"]),
        "timestamp": _single(tables["timestamp"]),
        "most_common_positive_deltas": _listed(tables["common_gaps"]),
        "validation": F.col("_validation"),
        "gap_policy_seconds": F.lit(policy.max_gap_seconds),
        "segments": _count(tables["segments"]),
        "signal_percentiles_raw": _listed(tables["sensor_percentiles"]),
        "window_policy": F.struct(
            F.lit(policy.window_seconds).alias("history_seconds"),
            F.lit(policy.step_seconds).alias("step_seconds"),
            _count(tables["windows"]).alias("feature_windows"),
        ),
        "horizons": _listed(tables["horizons"], "horizon_hours"),
        "sequence_resampling_candidates": _listed(tables["resampling_candidates"]),
        "resampling_decision": F.lit("pending_review"),
    }
    validation = tables["validation"]
    packed = validation.select(F.struct(*validation.columns).alias("_validation"))
    return packed.withColumns(sections).select(*sections)


def write_audit(tables: dict, path: str) -> None:
    """Write the report row and, next to it, the segment table in order."""
    write_report(audit_report(tables), f"{path}/report")
    segments = tables["segments"]
    keys = segments.columns[: segments.columns.index("segment_id") + 1]
    segments.orderBy(*keys).write.mode("overwrite").json(f"{path}/segments")
