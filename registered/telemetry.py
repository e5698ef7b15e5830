"""Scans, validation, segmentation and raw-data profiles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from forewarn.operators.profile import (
    GAP_PERCENTILES,
    SENSOR_PERCENTILES,
    arrival_gaps,
    cadence_summary,
    common_gaps,
    missing_counts,
    resampling_candidates,
    sensor_percentiles,
)
from forewarn.operators.segments import assign_segments, segment_profile
from forewarn.operators.sketches import add_days, daily_sketches, measured_rank_errors, rank_error, sketch_percentiles
from forewarn.operators.validation import (
    flag_repeated_timestamps,
    in_range,
    is_binary,
    quarantined_rows,
    valid_rows,
    validation_report,
)
from forewarn.plans.events_study import CLEAN, DIRTY, FLEET
from forewarn.sources.sinks import fresh_path, read_validated, stage_table, table_fingerprint, write_quarantine, write_validated
from forewarn.sources.telemetry import coerce, scan_csv, scan_parquet
from forewarn.spec import TelemetrySpec, WindowPolicy
from registered.base import digest, query, rounded, sql

DIRTY_SQL = dict(minute=True, value_limit=200.0)
FLEET_POLICY = WindowPolicy(86400, 43200, 43200, 0.5)
FLEET_SQL = dict(asset="user_id", policy=FLEET_POLICY)


def dirty(study):
    return replace(study, spec=DIRTY)


def fleet(study):
    return replace(study, spec=FLEET, policy=FLEET_POLICY)


@query(
    "src1_telemetry_scan",
    "SELECT event_id, file_row_number AS arrival, ts, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1"
    " AS file_row_number FROM events)",
)
def src1(study):
    """Parquet scan that keeps the file's own row order."""
    return scan_parquet(study.spark, f"{study.sf_dir}/events.parquet").select(
        "event_id", F.col("row_order").alias("arrival"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value"
    )


@query(
    "src1_csv_round_trip",
    rounded(sql("SELECT event_id, ts, value, k, CAST(active AS DOUBLE) AS active FROM raw"), "value", "k", "active"),
)
def src1_csv(study):
    """Telemetry written as CSV text and scanned back as strings, then coerced."""
    spec = TelemetrySpec(
        timestamp="ts", analogue=CLEAN.analogue, digital=("active",), difference=("k", "value"), duty="active",
        volatility="value",
    )
    path = fresh_path(study.spark, "telemetry-csv")
    raw = study.raw().select(F.col("ts").cast("string").alias("ts"), "value", "k", "active", "event_id")
    raw.write.csv(path, header=True)
    scanned = scan_csv(study.spark, path, spec, extra=("event_id",))
    return coerce(scanned, spec).select(F.col("event_id").cast("long").alias("event_id"), "ts", "value", "k", "active")


@query(
    "src2_coerce_columns",
    rounded(
        """SELECT event_id,
             CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts,
             CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value,
             CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
             CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS DOUBLE) AS active
           FROM events""",
        "value", "k", "active",
    ),
)
def src2(study):
    """Text cells, some of them unparseable, become typed values or null."""
    spoiled = study.raw().join(study.table("events").select("event_id", "event_type"), "event_id").select(
        "event_id",
        F.when(F.col("event_type") == "error", "not a time").otherwise(F.col("ts").cast("string")).alias("ts"),
        F.when(F.col("event_type") == "signup", "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        "k",
        "active",
    )
    return coerce(spoiled, CLEAN)


@query("val1_duplicate_timestamps", sql("SELECT event_id, ts, duplicate_timestamp FROM flagged", **DIRTY_SQL))
def val1(study):
    study = dirty(study)
    return flag_repeated_timestamps(coerce(study.raw(True), DIRTY), DIRTY).select(
        "event_id", "ts", "duplicate_timestamp"
    )


@query(
    "val2_range_predicate",
    sql(
        "SELECT event_id, NOT coalesce(value BETWEEN 0.0 AND 200.0, false) AS value_rejected,"
        " NOT coalesce(k BETWEEN 0.0 AND 100.0, false) AS k_rejected FROM raw",
        **DIRTY_SQL,
    ),
)
def val2(study):
    raw = coerce(study.raw(), DIRTY)
    return raw.select(
        "event_id", *[(~in_range(name, bounds)).alias(f"{name}_rejected") for name, bounds in DIRTY.analogue.items()]
    )


@query("val3_domain_predicate", sql("SELECT event_id, active NOT IN (0, 1) AS active_rejected, k NOT IN (0, 1) AS k_rejected FROM raw"))
def val3(study):
    raw = coerce(study.raw(), CLEAN)
    return raw.select("event_id", (~is_binary("active")).alias("active_rejected"), (~is_binary("k")).alias("k_rejected"))


@query(
    "val4_valid_rows",
    rounded(sql("SELECT event_id, ts, value, k, CAST(active AS DOUBLE) AS active FROM valid", **DIRTY_SQL), "value", "k", "active"),
)
def val4_valid(study):
    return valid_rows(dirty(study).flagged(True))


@query(
    "val4_quarantined_rows",
    rounded(
        sql(
            """SELECT event_id, ts, value, duplicate_timestamp,
                 concat_ws('|', CASE WHEN duplicate_timestamp THEN 'duplicate_timestamp' END,
                   CASE WHEN NOT value BETWEEN 0.0 AND 200.0 THEN 'value_out_of_range' END) AS reasons
               FROM judged WHERE NOT is_valid""",
            **DIRTY_SQL,
        ),
        "value",
    ),
)
def val4_quarantine(study):
    return quarantined_rows(dirty(study).flagged(True)).select(
        "event_id", "ts", "value", "duplicate_timestamp", F.array_join("reasons", "|").alias("reasons")
    )


@query(
    "val5_validation_report",
    sql(
        """SELECT count(*) AS input_rows, count(*) FILTER (is_valid) AS valid_rows,
             count(*) FILTER (NOT is_valid) AS quarantined_rows,
             count(*) FILTER (duplicate_timestamp) AS duplicate_timestamps,
             (SELECT count(*) FROM profile) AS segments
           FROM judged""",
        **DIRTY_SQL,
    ),
)
def val5(study):
    study = dirty(study)
    flagged = study.flagged(True)
    segments = segment_profile(assign_segments(valid_rows(flagged), DIRTY, study.policy.max_gap_seconds), DIRTY)
    return validation_report(flagged, segments)


@query(
    "val5_report_while_writing",
    sql(
        """SELECT count(*) AS input_rows, count(*) FILTER (is_valid) AS valid_rows,
             count(*) FILTER (NOT is_valid) AS quarantined_rows,
             count(*) FILTER (duplicate_timestamp) AS duplicate_timestamps,
             count(*) FILTER (is_valid) AS stored_valid, count(*) FILTER (NOT is_valid) AS stored_quarantined
           FROM judged""",
        **DIRTY_SQL,
    ),
)
def val5_writing(study):
    """Counts taken while valid and rejected rows are written, next to those of what was written."""
    path = fresh_path(study.spark, "validated")
    counts = write_validated(dirty(study).flagged(True), path)
    stored = read_validated(study.spark, path)
    return stored.agg(
        *[F.lit(int(n)).cast("long").alias(name) for name, n in counts.items()],
        F.count_if("is_valid").alias("stored_valid"),
        F.count_if(~F.col("is_valid")).alias("stored_quarantined"),
    )


@query(
    "ts1_gap_segments",
    rounded(
        sql("SELECT event_id, ts, segment_id, segment_start, previous_timestamp, previous_value FROM segmented"),
        "previous_value",
    ),
)
def ts1(study):
    return study.segmented().select(
        "event_id", "ts", "segment_id", "segment_start", "previous_timestamp", "previous_value"
    )


@query(
    "ts1_gap_segments_fleet",
    rounded(
        sql(
            "SELECT event_id, user_id, ts, segment_id, segment_start, previous_timestamp, previous_value FROM segmented",
            **FLEET_SQL,
        ),
        "previous_value",
    ),
)
def ts1_fleet(study):
    return fleet(study).segmented().select(
        "event_id", "user_id", "ts", "segment_id", "segment_start", "previous_timestamp", "previous_value"
    )


@query(
    "ts2_segment_cadence",
    rounded(sql("SELECT segment_id, cadence_seconds FROM profile"), "cadence_seconds"),
)
def ts2(study):
    return study.profile().select("segment_id", "cadence_seconds")


@query("ts15_segment_profile", rounded(sql("SELECT * FROM profile"), "duration_hours", "cadence_seconds"))
def ts15(study):
    return study.profile()


@query(
    "ts15_segment_profile_fleet",
    rounded(sql("SELECT * FROM profile", **FLEET_SQL), "duration_hours", "cadence_seconds"),
)
def ts15_fleet(study):
    return fleet(study).profile()


ARRIVALS = """arrivals AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY event_id) AS before FROM raw),
deltas AS (SELECT event_id, ts, (epoch_us(ts) - epoch_us(before)) / 1000000.0 AS gap_seconds FROM arrivals)"""


@query(
    "ts14_cadence_profile",
    rounded(
        sql(
            "SELECT count(ts) AS parsed, count(*) - count(ts) AS unparseable,"
            " (SELECT count(*) FROM flagged WHERE duplicate_timestamp) AS duplicate_timestamps,"
            " count(*) FILTER (gap_seconds <= 0) AS non_increasing_adjacent_pairs, min(ts) AS \"start\", max(ts) AS \"end\", "
            + ", ".join(
                f"quantile_cont(CASE WHEN gap_seconds > 0 THEN gap_seconds END, {p}) AS {n}"
                for n, p in GAP_PERCENTILES.items()
            )
            + ", max(CASE WHEN gap_seconds > 0 THEN gap_seconds END) AS \"max\","
            " quantile_cont(CASE WHEN gap_seconds > 0 THEN gap_seconds END, 0.5) AS median_seconds FROM deltas",
            ARRIVALS,
            **DIRTY_SQL,
        ),
        *GAP_PERCENTILES, '"max"', "median_seconds",
    ),
)
def ts14(study):
    return cadence_summary(coerce(dirty(study).raw(True), DIRTY), "ts", ["event_id"])


@query(
    "ts14_cadence_profile_exact_times",
    rounded(
        sql(
            "SELECT "
            + ", ".join(
                f"quantile_cont(CASE WHEN gap_seconds > 0 THEN gap_seconds END, {p}) AS {n}"
                for n, p in GAP_PERCENTILES.items()
            )
            + " FROM deltas",
            ARRIVALS,
        ),
        *GAP_PERCENTILES,
    ),
)
def ts14_exact(study):
    return cadence_summary(coerce(study.raw(), CLEAN), "ts", ["event_id"]).select(*GAP_PERCENTILES)


@query(
    "so3_most_common_gaps",
    sql(
        "SELECT gap_seconds, count(*) AS count FROM deltas WHERE gap_seconds > 0 GROUP BY 1"
        " ORDER BY 2 DESC, 1 LIMIT 10",
        ARRIVALS,
        **DIRTY_SQL,
    ),
)
def so3(study):
    return common_gaps(coerce(dirty(study).raw(True), DIRTY), "ts", ["event_id"])


@query(
    "wf5_adjacent_non_increase",
    sql("SELECT ts AS \"timestamp\", gap_seconds FROM deltas WHERE gap_seconds <= 0", ARRIVALS, **DIRTY_SQL),
)
def wf5(study):
    gaps = arrival_gaps(coerce(dirty(study).raw(True), DIRTY), "ts", ["event_id"])
    return gaps.where("gap_seconds <= 0").select("timestamp", "gap_seconds")


@query(
    "wf1_lag_gap",
    rounded(
        sql(
            "SELECT event_id, CASE WHEN previous_timestamp IS NULL THEN 0.0 ELSE"
            " (epoch_us(ts) - epoch_us(previous_timestamp)) / 1000000.0 END AS gap_seconds FROM segmented"
        ),
        "gap_seconds",
    ),
)
def wf1(study):
    seconds = F.timestamp_diff("MICROSECOND", F.col("previous_timestamp"), F.col("ts")) / 1e6
    return study.segmented().select("event_id", F.coalesce(seconds, F.lit(0.0)).alias("gap_seconds"))


def _percentile_sql(table: str, sensors) -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' AS sensor, "
        + ", ".join(f"quantile_cont(CAST({s} AS DOUBLE), {p}) AS {n}" for n, p in SENSOR_PERCENTILES.items())
        + f" FROM {table}"
        for s in sensors
    )


@query("ts16_sensor_percentiles", rounded(sql(_percentile_sql("raw", ("value", "k"))), *SENSOR_PERCENTILES))
def ts16(study):
    return sensor_percentiles(coerce(study.raw(), CLEAN), ["value", "k"])


LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("ts16_percentiles_lineitem", rounded(_percentile_sql("lineitem", LINE_COLUMNS), *SENSOR_PERCENTILES))
def ts16_lineitem(study):
    return sensor_percentiles(study.table("lineitem"), LINE_COLUMNS)


SENSORS = ("value", "k")
SKETCHED = {"p1": 0.01, "p50": 0.5, "p99": 0.99}


@query(
    "ts16_sketch_percentiles",
    sql(
        """SELECT sensor, rank, n, true AS is_within FROM (SELECT 'value' AS sensor, count(value) AS n FROM raw
             UNION ALL SELECT 'k', count(k) FROM raw), (VALUES ('p1'), ('p50'), ('p99')) AS r(rank)"""
    ),
)
def ts16_sketches(study):
    """Percentiles from stored sketches of each day, held against the exact ranks of what they answer."""
    readings = coerce(study.raw(), CLEAN)
    path = fresh_path(study.spark, "sketches")
    add_days(daily_sketches(readings, SENSORS, "ts"), path)
    found = stage_table(sketch_percentiles(study.spark.read.parquet(path), SKETCHED), "sketched")
    errors = measured_rank_errors(found, readings, SENSORS, SKETCHED)
    return errors.join(found.select("sensor", "n"), "sensor").select(
        "sensor", "rank", "n", (F.col("error") <= rank_error()).alias("is_within")
    )


@query(
    "ts17_missing_values",
    "SELECT * FROM (SELECT 'ts' AS column_name, count(*) FILTER (event_type = 'error') AS missing FROM events UNION ALL"
    " SELECT 'value', count(*) FILTER (event_type = 'signup' OR value > 200) FROM events) WHERE missing > 0",
)
def ts17(study):
    kind = study.table("events").select("event_id", "event_type")
    spoiled = study.raw().join(kind, "event_id")
    return missing_counts(
        spoiled.select(
            "event_id",
            F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"),
            F.when(F.col("value") > 200, F.lit(float("nan")))
            .when(F.col("event_type") != "signup", F.col("value"))
            .alias("value"),
            "k",
        )
    )


@query("ts17_missing_values_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM lineitem HAVING count(*) > count({c})"
    for c in ("l_orderkey", *LINE_COLUMNS, "l_returnflag", "l_linestatus", "l_shipdate")
))
def ts17_lineitem(study):
    return missing_counts(
        study.table("lineitem").select("l_orderkey", *LINE_COLUMNS, "l_returnflag", "l_linestatus", "l_shipdate")
    )


@query(
    "ts18_resampling_candidates",
    sql(
        """SELECT interval_seconds, CAST(ceil(3600.0 / interval_seconds) AS BIGINT) AS timesteps_per_window FROM (
             SELECT DISTINCT unnest([lo, 5, 10, 30, 60]) AS interval_seconds, lo FROM (
               SELECT greatest(1, CAST(ceil(quantile_cont(CASE WHEN gap_seconds > 0 THEN gap_seconds END, 0.5)) AS BIGINT))
                 AS lo FROM deltas))
           WHERE interval_seconds >= lo""",
        ARRIVALS,
        **DIRTY_SQL,
    ),
)
def ts18(study):
    summary = cadence_summary(coerce(dirty(study).raw(True), DIRTY), "ts", ["event_id"])
    return resampling_candidates(summary, 3600)


@query("so1_time_sort", rounded(sql("SELECT ts, value FROM valid ORDER BY ts"), "value"))
def so1(study):
    return study.valid().select("ts", "value").orderBy("ts")


@query(
    "snk1_quarantine",
    rounded(sql("SELECT event_id, value FROM judged WHERE NOT is_valid", **DIRTY_SQL), "value"),
)
def snk1(study):
    """Rejected rows written to the quarantine and read back."""
    path = fresh_path(study.spark, "quarantine")
    if not write_quarantine(quarantined_rows(dirty(study).flagged(True)), path):
        return study.table("events").select("event_id", "value").limit(0)
    return study.spark.read.parquet(path).select("event_id", "value")


_ROW_TEXT = """concat_ws('|', CAST(epoch_us(ts) AS VARCHAR), coalesce(CAST(event_id AS VARCHAR), '~'),
    CAST(CAST(round(value * 1e6) AS BIGINT) AS VARCHAR), CAST(CAST(round(k * 1e6) AS BIGINT) AS VARCHAR),
    CAST(CAST(round(active * 1e6) AS BIGINT) AS VARCHAR))"""


@query(
    "snk4_table_fingerprint",
    sql(f"SELECT count(*) AS rows, CAST(coalesce(sum({digest(_ROW_TEXT)}), 0) AS VARCHAR) AS fingerprint FROM valid"),
)
def snk4(study):
    """All columns of the valid table; a change in any of them is another fingerprint."""
    return table_fingerprint(study.valid())
