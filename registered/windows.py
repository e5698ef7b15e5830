"""Feature windows, failure labels, splits and folds."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from forewarn.operators.checks import fold_problems
from forewarn.operators.labels import bad_windows, label_horizons, label_windows_from_table
from forewarn.operators.profile import horizon_audit
from forewarn.operators.splits import (
    class_weights,
    fold_class_counts,
    purge_overlap,
    split_bounds,
)
from forewarn.operators.sequences import rows_in_windows
from forewarn.operators.windows import assign_windows, degenerate_windows, feature_columns
from forewarn.plans.events_study import CLEAN, GRID, HOLDOUT_START
from forewarn.spec import WindowPolicy
from registered.base import FEATURES, HOLDOUT, query, rounded, sql
from registered.telemetry import FLEET_SQL, fleet

WINDOW_COLUMNS = ["segment_id", "window_start", "window_end"]
IDENTITY = "segment_id, window_start, window_end"


def _windows_sql(extra: str = "", **options) -> str:
    return rounded(
        sql(f"SELECT {extra}{IDENTITY}, window_index, rows, cadence_seconds, {', '.join(FEATURES)} FROM windows", **options),
        "cadence_seconds",
        *FEATURES,
    )


@query("ts3_sliding_windows", sql(f"SELECT {IDENTITY}, window_index, rows FROM windows"))
def ts3(study):
    return study.windows().select(*WINDOW_COLUMNS, "window_index", "rows")


@query("ts5_window_features", _windows_sql())
def ts5(study):
    return study.windows()


@query("ts5_window_features_fleet", _windows_sql("user_id, ", **FLEET_SQL))
def ts5_fleet(study):
    return fleet(study).windows()


# A window of 50 minutes every 70 leaves readings that no window contains.
SPARSE = WindowPolicy(3000, 4200, 1200, 0.5)


@query("ts3_windows_with_holes", _windows_sql(policy=SPARSE))
def ts3_holes(study):
    return replace(study, policy=SPARSE).windows()


STRICT = WindowPolicy(3600, 1800, 1200, 0.9)


@query(
    "ts4_coverage_gate",
    sql(
        f"SELECT {IDENTITY}, rows, CAST(greatest(1, round_even(3600 / cadence_seconds, 0)) AS BIGINT) AS expected_rows"
        " FROM windows",
        policy=STRICT,
    ),
)
def ts4(study):
    expected = F.greatest(F.lit(1.0), F.bround(F.lit(3600.0) / F.col("cadence_seconds"))).cast("long")
    return replace(study, policy=STRICT).windows().select(*WINDOW_COLUMNS, "rows", expected.alias("expected_rows"))


@query(
    "ts6_cross_column_features",
    rounded(
        sql(f"SELECT {IDENTITY}, pressure_diff_mean, comp_duty_cycle, motor_current_volatility FROM windows"),
        "pressure_diff_mean", "comp_duty_cycle", "motor_current_volatility",
    ),
)
def ts6(study):
    return study.windows().select(*WINDOW_COLUMNS, *FEATURES[-3:])


# Low coverage and long cadences, so that windows with a single reading are accepted.
LONELY = WindowPolicy(1800, 900, 1800, 0.1)


@query(
    "ts7_degenerate_windows",
    sql(f"SELECT {IDENTITY}, rows FROM windows WHERE value_roc_per_hour IS NULL", policy=LONELY),
)
def ts7(study):
    study = replace(study, policy=LONELY)
    return degenerate_windows(study.windows(), CLEAN).select(*WINDOW_COLUMNS, "rows")


@query(
    "jn4_rows_in_windows",
    sql(
        "SELECT y.event_id, x.segment_id, x.window_start FROM windows x JOIN segmented y"
        " ON x.segment_id = y.segment_id AND y.ts >= x.window_start AND y.ts < x.window_end"
    ),
)
def jn4(study):
    windows = study.windows().select(*WINDOW_COLUMNS)
    rows = study.segmented().select("event_id", "ts", "segment_id")
    return rows_in_windows(rows, windows, CLEAN, 3600).select("event_id", "segment_id", "window_start")


@query(
    "wf6_successive_difference",
    rounded(
        sql(
            "SELECT y.event_id, x.segment_id, x.window_index, CASE WHEN y.previous_timestamp >= x.window_start"
            " THEN abs(y.value - y.previous_value) END AS step_change FROM (SELECT segment_id, segment_start,"
            " unnest(generate_series(0, 2000)) AS window_index FROM profile) w,"
            " LATERAL (SELECT w.segment_id, w.window_index, w.segment_start + to_seconds(w.window_index * 1800)"
            " AS window_start) x JOIN segmented y ON x.segment_id = y.segment_id AND y.ts >= x.window_start"
            " AND y.ts < x.window_start + to_seconds(3600)"
        ),
        "step_change",
    ),
)
def wf6(study):
    rows = assign_windows(study.segmented(), CLEAN, study.policy)
    start = F.timestamp_add("SECOND", F.col("window_index") * 1800, F.col("segment_start"))
    change = F.when(F.col("previous_timestamp") >= start, F.abs(F.col("value") - F.col("previous_value")))
    return rows.select("event_id", "segment_id", "window_index", change.alias("step_change"))


@query("jn1_active_failure_overlap", sql(f"SELECT {IDENTITY}, in_failure FROM labelled"))
def jn1(study):
    return study.labelled().select(*WINDOW_COLUMNS, "in_failure")


@query(
    "jn2_forward_asof",
    rounded(sql(f"SELECT {IDENTITY}, hours_to_next_failure FROM labelled"), "hours_to_next_failure"),
)
def jn2(study):
    return study.labelled().select(*WINDOW_COLUMNS, "hours_to_next_failure")


FLEET_FAILURES = """fleet_failures AS (
  SELECT user_id, ts AS failure_start, ts + INTERVAL 5 HOUR AS failure_end FROM events
  WHERE event_type = 'error'),
fleet_labels AS (
  SELECT w.user_id, w.segment_id, w.window_start, w.window_end,
    EXISTS (SELECT 1 FROM fleet_failures f WHERE f.user_id = w.user_id AND f.failure_start < w.window_end
      AND f.failure_end > w.window_start) AS in_failure,
    (SELECT min(epoch_us(f.failure_start) - epoch_us(w.window_end)) FROM fleet_failures f
      WHERE f.user_id = w.user_id AND f.failure_start >= w.window_end) / 3600000000.0 AS hours_to_next_failure
  FROM windows w)"""


@query(
    "jn2_forward_asof_fleet",
    rounded(sql("SELECT * FROM fleet_labels", FLEET_FAILURES, **FLEET_SQL), "hours_to_next_failure"),
)
def jn2_fleet(study):
    """Failures taken from the data, one machine per user, joined without pairing."""
    failures = (
        study.table("events")
        .where(F.col("event_type") == "error")
        .select(
            "user_id",
            F.col("ts").cast("timestamp_ntz").alias("failure_start"),
            (F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 5 HOURS")).alias("failure_end"),
        )
    )
    windows = fleet(study).windows().select("user_id", *WINDOW_COLUMNS)
    return label_windows_from_table(windows, failures, ["user_id"])


@query(
    "jn2_forward_asof_large_table",
    rounded(
        sql(
            f"""SELECT {IDENTITY},
                  EXISTS (SELECT 1 FROM many f WHERE f.failure_start < w.window_end AND f.failure_end > w.window_start)
                    AS in_failure,
                  (SELECT min(epoch_us(f.failure_start) - epoch_us(w.window_end)) FROM many f
                    WHERE f.failure_start >= w.window_end) / 3600000000.0 AS hours_to_next_failure
                FROM windows w""",
            "many AS (SELECT ts AS failure_start, ts + INTERVAL 20 MINUTE AS failure_end FROM events WHERE event_type = 'error')",
        ),
        "hours_to_next_failure",
    ),
)
def jn2_large(study):
    """Every error event is a failure: too many intervals for literals."""
    start = F.col("ts").cast("timestamp_ntz")
    failures = study.table("events").where(F.col("event_type") == "error").select(
        start.alias("failure_start"), (start + F.expr("INTERVAL 20 MINUTES")).alias("failure_end")
    )
    return label_windows_from_table(study.windows().select(*WINDOW_COLUMNS), failures)


@query(
    "jn3_horizon_labels",
    sql("SELECT window_id, horizon_hours, failure_within_horizon FROM by_horizon"),
)
def jn3(study):
    return study.by_horizon().select("window_id", "horizon_hours", "failure_within_horizon")


@query(
    "ml4_labels_per_horizon",
    sql(
        "SELECT horizon_hours, CAST(sum(failure_within_horizon) AS BIGINT) AS positives, count(*) AS windows,"
        " count(*) FILTER (in_failure) AS active FROM by_horizon GROUP BY 1"
    ),
)
def ml4(study):
    return study.by_horizon().groupBy("horizon_hours").agg(
        F.sum(F.col("failure_within_horizon").cast("long")).alias("positives"),
        F.count(F.lit(1)).alias("windows"),
        F.count_if("in_failure").alias("active"),
    )


@query("prj1_predictive_windows", sql(f"SELECT {IDENTITY} FROM predictive"))
def prj1(study):
    return study.predictive().select(*WINDOW_COLUMNS)


@query("prj2_feature_columns", rounded(sql(f"SELECT {', '.join(FEATURES)} FROM predictive"), *FEATURES))
def prj2(study):
    predictive = study.predictive()
    return predictive.select(*feature_columns(predictive))


@query("prj3_window_id", sql(f"SELECT window_id, {IDENTITY} FROM predictive"))
def prj3(study):
    return study.predictive().select("window_id", *WINDOW_COLUMNS)


@query(
    "val7_window_bounds",
    sql(
        """SELECT count(*) AS windows, count(*) FILTER (window_start IS NULL OR window_end IS NULL) AS missing_bounds,
             count(*) FILTER (window_end <= window_start) AS not_increasing FROM windows"""
    ),
)
def val7(study):
    return bad_windows(study.windows())


@query(
    "so1_window_sort",
    sql(f"SELECT {IDENTITY} FROM predictive ORDER BY window_end, window_start"),
)
def so1_windows(study):
    return study.predictive().select(*WINDOW_COLUMNS).orderBy("window_end", "window_start")


@query(
    "sp1_overlap_purge",
    sql("SELECT window_id FROM split WHERE split = 'train'"),
)
def sp1(study):
    predictive = study.predictive()
    cut = F.lit(HOLDOUT_START).cast("timestamp_ntz")
    before = predictive.where(F.col("window_end") < cut)
    after = predictive.where(F.col("window_end") >= cut)
    return purge_overlap(before, after).select("window_id")


@query(
    "sp1_overlap_purge_fleet",
    sql(
        f"""SELECT b.user_id, b.segment_id, b.window_start FROM windows b WHERE b.window_end < {HOLDOUT}
              AND b.window_end <= coalesce((SELECT min(a.window_start) FROM windows a
                WHERE a.user_id = b.user_id AND a.window_end >= {HOLDOUT}), b.window_end)""",
        **FLEET_SQL,
    ),
)
def sp1_fleet(study):
    windows = fleet(study).windows().select("user_id", *WINDOW_COLUMNS)
    cut = F.lit(HOLDOUT_START).cast("timestamp_ntz")
    kept = purge_overlap(windows.where(F.col("window_end") < cut), windows.where(F.col("window_end") >= cut), ["user_id"])
    return kept.select("user_id", "segment_id", "window_start")


@query("sp2_chronological_split", sql("SELECT window_id, split FROM split"))
def sp2(study):
    return study.split().select("window_id", "split")


@query("sp3_development_folds", sql("SELECT window_id, fold, role FROM fold_split"))
def sp3(study):
    return study.folds().select("window_id", "fold", "role")


def _bounds_sql(keys: str, table: str, role: str, train: str, test: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT *, latest_train_window_end <= earliest_test_window_start AS timestamp_intervals_disjoint FROM (
      SELECT {lead}count(*) FILTER ({role} = '{train}') AS train_windows, count(*) FILTER ({role} = '{test}') AS test_windows,
        max(window_end) FILTER ({role} = '{train}') AS latest_train_window_end,
        min(window_start) FILTER ({role} = '{test}') AS earliest_test_window_start
      FROM {table} {group})"""


@query("sp4_split_bounds", sql(_bounds_sql("", "split", "split", "train", "test")))
def sp4(study):
    return split_bounds(study.split(), [], "split", "train", "test")


@query("sp4_fold_bounds", sql(_bounds_sql("fold", "fold_split", "role", "train", "validation")))
def sp4_folds(study):
    return split_bounds(study.folds(), ["fold"], "role", "train", "validation")


@query(
    "ml5_binary_fold_guard",
    sql(
        """SELECT horizon_hours, fold, role, count(*) AS windows, CAST(sum(y) AS BIGINT) AS positives,
             CAST(sum(1 - y) AS BIGINT) AS negatives, sum(y) > 0 AND sum(1 - y) > 0 AS is_binary
           FROM (SELECT *, CAST(coalesce(hours_to_next_failure <= horizon_hours, false) AS INTEGER) AS y
             FROM fold_split, horizons) GROUP BY 1, 2, 3"""
    ),
)
def ml5(study):
    return fold_class_counts(label_horizons(study.folds(), GRID.horizons))


@query(
    "ag24_class_weights",
    rounded(
        sql(
            """SELECT horizon_hours, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives,
                 sum(1 - y) / sum(y) AS positive_weight
               FROM (SELECT *, CAST(coalesce(hours_to_next_failure <= horizon_hours, false) AS INTEGER) AS y
                 FROM split, horizons WHERE split = 'train') GROUP BY 1"""
        ),
        "positive_weight",
    ),
)
def ag24(study):
    return class_weights(label_horizons(study.split().where(F.col("split") == "train"), GRID.horizons))


HORIZON_AUDIT = f"""SELECT horizon_hours, count(*) FILTER (NOT in_failure) AS predictive_windows,
  count(*) FILTER (NOT in_failure AND y = 1) AS positive_windows,
  count(*) FILTER (NOT in_failure AND y = 0) AS negative_windows,
  count(*) FILTER (in_failure) AS quarantined_failure_windows, CAST(NULL AS VARCHAR) AS split_error,
  count(*) FILTER (train) AS train_windows, count(*) FILTER (train AND y = 1) AS train_positive,
  count(*) FILTER (test) AS test_windows, count(*) FILTER (test AND y = 1) AS test_positive,
  max(window_end) FILTER (train) AS latest_train_window_end, min(window_start) FILTER (test) AS earliest_test_window_start,
  max(window_end) FILTER (train) <= min(window_start) FILTER (test) AS timestamp_intervals_disjoint
FROM (
  SELECT l.*, h.horizon_hours, CAST(coalesce(hours_to_next_failure <= h.horizon_hours, false) AS INTEGER) AS y,
    NOT in_failure AND window_end >= {HOLDOUT} AS test,
    NOT in_failure AND window_end < {HOLDOUT} AND window_end <= (
      SELECT min(window_start) FROM predictive WHERE window_end >= {HOLDOUT}) AS train
  FROM labelled l, horizons h)
GROUP BY 1"""


@query("ts19_horizon_audit", sql(HORIZON_AUDIT))
def ts19(study):
    return horizon_audit(study.labelled(), GRID.horizons, HOLDOUT_START)


@query(
    "ts19_horizon_audit_without_holdout",
    sql(
        """SELECT horizon_hours, count(*) FILTER (NOT in_failure) AS predictive_windows,
             'Fixed holdout boundary 2025-01-01 00:00:00 must leave windows on both sides' AS split_error
           FROM labelled, horizons GROUP BY 1"""
    ),
)
def ts19_missing(study):
    return horizon_audit(study.labelled(), GRID.horizons, "2025-01-01 00:00:00").select(
        "horizon_hours", "predictive_windows", "split_error"
    )


@query(
    "ev5_fold_check",
    sql(
        f"""SELECT fold, CASE WHEN validation_start >= validation_end OR validation_end >= {HOLDOUT}
               THEN 'the fold is empty or reaches the holdout'
             WHEN lag(validation_end) OVER (ORDER BY validation_start) > validation_start
               THEN 'the fold begins inside the one before' END AS problem
           FROM (SELECT fold, min(window_start) AS validation_start, max(window_end) AS validation_end
             FROM fold_split WHERE role = 'validation' GROUP BY 1)"""
    ),
)
def ev5(study):
    """The span each fold actually covers, checked for order and overlap."""
    spans = study.folds().where(F.col("role") == "validation").groupBy("fold").agg(
        F.min("window_start").alias("validation_start"), F.max("window_end").alias("validation_end")
    )
    return fold_problems(spans, HOLDOUT_START)
