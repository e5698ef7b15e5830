"""Row validation: repeated timestamps, ranges, domains and the quarantine fork."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.spec import TelemetrySpec, require_columns

_SALT_SPREAD = 1024


def arrival(spec: TelemetrySpec) -> Column:
    """Sortable arrival position of a row."""
    columns = spec.order_cols
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def flag_repeated_timestamps(df: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Add ``duplicate_timestamp``: not the first arrival of its timestamp.

    Copies collapse map-side, so a timestamp that holds a large share of all
    rows costs one row per task. Only timestamps seen more than once are joined
    back; Spark broadcasts that table when its measured size allows and splits
    skewed partitions otherwise. Rows without a timestamp are never repeats and
    are spread over a salt instead of meeting on one null key.
    """
    require_columns(df.columns, [*spec.order_cols, spec.timestamp], "telemetry")
    keys = [*spec.asset_cols, spec.timestamp]
    repeated = (
        df.where(F.col(spec.timestamp).isNotNull())
        .groupBy(*keys)
        .agg(F.min(arrival(spec)).alias("_first_arrival"), F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > 1)
        .select(*keys, F.lit(0).alias("_salt"), "_first_arrival")
    )
    spread = F.when(
        F.col(spec.timestamp).isNull(), 1 + F.pmod(F.xxhash64(*spec.order_cols), F.lit(_SALT_SPREAD))
    ).otherwise(0)
    return (
        df.withColumn("_salt", spread.cast("int"))
        .join(repeated, [*keys, "_salt"], "left")
        .withColumn("duplicate_timestamp", F.coalesce(arrival(spec) > F.col("_first_arrival"), F.lit(False)))
        .drop("_salt", "_first_arrival")
    )


def in_range(name: str, bounds: tuple[float, float]) -> Column:
    """True only for a present value inside the inclusive range."""
    return F.coalesce(F.col(name).between(*bounds), F.lit(False))


def is_binary(name: str) -> Column:
    """True only for a present 0 or 1."""
    return F.coalesce(F.col(name).isin(0, 1), F.lit(False))


def row_reasons(spec: TelemetrySpec) -> Column:
    """Names of the row-level rules a coerced row breaks."""
    rules = [F.when(F.col(spec.timestamp).isNull(), F.lit("timestamp_missing"))]
    rules += [F.when(F.col(name).isNull(), F.lit(f"{name}_missing")) for name in spec.asset_cols]
    rules += [
        F.when(~in_range(name, bounds), F.lit(f"{name}_out_of_range")) for name, bounds in spec.analogue.items()
    ]
    rules += [F.when(~is_binary(name), F.lit(f"{name}_not_binary")) for name in spec.digital]
    return F.array_compact(F.array(*rules))


def row_accepted(spec: TelemetrySpec) -> Column:
    """True when a coerced row breaks no row-level rule."""
    present = [F.col(name).isNotNull() for name in (spec.timestamp, *spec.asset_cols)]
    ranges = [in_range(name, bounds) for name, bounds in spec.analogue.items()]
    return reduce(lambda a, b: a & b, [*present, *ranges, *[is_binary(name) for name in spec.digital]])


def validate(df: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Flag every coerced row: ``duplicate_timestamp``, ``reasons``, ``is_valid``.

    Repeats are judged before validity: when the first copy is out of range, the
    later copies are still repeats.
    """
    require_columns(df.columns, spec.required, "telemetry")
    flagged = flag_repeated_timestamps(df, spec)
    reasons = F.concat(
        F.when(F.col("duplicate_timestamp"), F.array(F.lit("duplicate_timestamp"))).otherwise(
            F.array().cast("array<string>")
        ),
        row_reasons(spec),
    )
    # The flag does not go through the array, so accepting rows stays cheap. As one
    # CASE it is judged after the join, on values parsed once: split into
    # conjuncts it would be pushed below and parse the text again per comparison.
    accepted = F.when(F.col("duplicate_timestamp"), F.lit(False)).otherwise(row_accepted(spec))
    return flagged.withColumns({"reasons": reasons, "is_valid": accepted})


def valid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_valid").drop("is_valid", "reasons", "duplicate_timestamp")


def quarantined_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where(~F.col("is_valid")).drop("is_valid")


def validation_report(flagged: DataFrame, segment_starts: DataFrame) -> DataFrame:
    """One row: input, valid, quarantined and repeated rows, and segments.

    ``segment_starts`` is the output of ``segment_profile``: one row per segment.
    """
    rows = flagged.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if("is_valid").alias("valid_rows"),
        F.count_if(~F.col("is_valid")).alias("quarantined_rows"),
        F.count_if("duplicate_timestamp").alias("duplicate_timestamps"),
    )
    segments = segment_starts.agg(F.count(F.lit(1)).alias("segments"))
    return rows.withColumn("segments", segments.scalar())
