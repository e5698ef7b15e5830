"""Report tables, stored evidence and regime shifts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from forewarn.operators.alerts import CELL
from forewarn.operators.checks import domain_check
from forewarn.operators.metrics import eventwise_metrics, seed_summary
from forewarn.operators.regimes import (
    effects_of,
    least_consistent,
    pivot_effects,
    regime_effects,
    regime_summary,
)
from forewarn.operators.reports import (
    alert_burden,
    comparison_table,
    cost_against_ranking,
    cross_event_pivot,
    event_timeline,
    filter_rows,
    horizon_performance,
    lead_band,
    policy_summary,
    seed_band,
)
from forewarn.operators.thresholds import threshold_records
from forewarn.plans.audit import audit_report, audit_tables, write_audit
from forewarn.plans.events_study import FAILURES, GRID, HOLDOUT_START, ONSETS, THRESHOLDS
from forewarn.sources.sinks import fresh_path, stage_table, write_named_traces, write_partitioned
from forewarn.sources.traces import read_thresholds, scan_named_traces, scan_trace
from forewarn.spec import EVENT_LABELS, MODEL_LABELS
from registered.base import FEATURES, ONSET_ROWS, query, rounded, sql
from registered.evidence import (
    EVENT_CTES,
    POLICY_CTES,
    SUMMARY_CTE,
    SWEEP_CTES,
    development,
    holdout,
    metrics,
    thresholds,
)

EVENTS = [name for name, _ in ONSETS]
SUMMARY = f"{EVENT_CTES},\n{SUMMARY_CTE}"


def with_event(traces):
    return traces.withColumn("event", F.coalesce("fold", F.lit(GRID.holdout_event)))


def _summary(study):
    return seed_summary(eventwise_metrics(study.stored_traces(), GRID.holdout_event))


# --- stored evidence -------------------------------------------------------------------

TRACE_COLUMNS = "model, horizon_hours, seed, window_id, segment_id, true_label, probability, event"


@query(
    "src4_named_trace_files",
    rounded(
        sql(f"SELECT {TRACE_COLUMNS} FROM (SELECT *, coalesce(fold, 'july_holdout') AS event FROM traces)"), "probability"
    ),
)
def src4(study):
    """Traces written as gzip CSV per (model, horizon) and read back by file name."""
    traces, root = study.stored_traces(), fresh_path(study.spark, "named-traces")
    write_named_traces(development(traces), f"{root}/development")
    write_named_traces(holdout(traces), f"{root}/holdout")
    return scan_named_traces(study.spark, root, GRID.holdout_event).select(*TRACE_COLUMNS.split(", "))


@query(
    "src5_partitioned_trace",
    rounded(
        sql("SELECT window_id, seed, true_label, probability FROM traces WHERE model = 'tcn' AND horizon_hours = 6"
            " AND fold = 'june_failure'"),
        "probability",
    ),
)
def src5(study):
    """One (model, horizon, event) of a partitioned trace table."""
    path = fresh_path(study.spark, "partitioned-traces")
    write_partitioned(with_event(study.with_stored_windows().traces()), path, ("model", "horizon_hours"))
    return scan_trace(study.spark, path, "tcn", 6, "june_failure").select(
        "window_id", "seed", "true_label", "probability"
    )


@query(
    "src6_domain_checks",
    sql(
        """SELECT 'model' AS column_name, count(DISTINCT model) FILTER (model IN ('xgboost', 'tcn', 'attention_tcn')) AS present,
             3 - count(DISTINCT model) FILTER (model IN ('xgboost', 'tcn', 'attention_tcn')) AS missing,
             count(DISTINCT model) FILTER (model NOT IN ('xgboost', 'tcn', 'attention_tcn')) AS unexpected, true AS matches FROM traces
           UNION ALL SELECT 'horizon_hours', count(DISTINCT horizon_hours), 4 - count(DISTINCT horizon_hours), 0, true FROM traces
           UNION ALL SELECT 'seed', count(DISTINCT seed) FILTER (seed IN (17, 42, 99)),
             3 - count(DISTINCT seed) FILTER (seed IN (17, 42, 99)), count(DISTINCT seed) FILTER (seed NOT IN (17, 42, 99)), false FROM traces"""
    ),
)
def src6(study):
    """Two columns hold exactly the expected values; the third is compared with a wrong set."""
    return domain_check(
        study.stored_traces(), {"model": GRID.models, "horizon_hours": GRID.horizons, "seed": (17, 42, 99)}
    )


@query(
    "src7_threshold_json",
    rounded(
        sql("SELECT model, horizon_hours, threshold, development_f_beta AS development_f2,"
            " development_false_alert_episodes FROM selected", SWEEP_CTES),
        "threshold", "development_f2",
    ),
)
def src7(study):
    """Nested threshold records written as JSON and read back."""
    path = fresh_path(study.spark, "thresholds")
    threshold_records(thresholds(study.stored_traces()), THRESHOLDS, GRID.seeds).write.json(path)
    return read_thresholds(study.spark, path).select(
        "model", "horizon_hours", "operational.threshold", "operational.development_f2",
        "operational.development_false_alert_episodes",
    )


@query(
    "snk2_partitioned_metrics",
    sql("SELECT model, horizon_hours, threshold_policy, tp, fp, fn, tn FROM policy_metrics", POLICY_CTES),
)
def snk2(study):
    path = fresh_path(study.spark, "metrics")
    write_partitioned(metrics(study.stored_traces()), path)
    stored = study.spark.read.parquet(path)
    return stored.select("model", "horizon_hours", "threshold_policy", "tp", "fp", "fn", "tn")


@query(
    "snk3_audit_report",
    sql(
        """SELECT 1 AS schema_version, (SELECT count(*) FROM raw) AS rows, (SELECT count(*) FROM profile) AS segments,
             4 AS horizons, (SELECT count(*) FROM windows) AS feature_windows"""
    ),
)
def snk3(study):
    """The one-row audit written as JSON and read back."""
    path = fresh_path(study.spark, "audit")
    write_audit(audit_tables(study.raw(), study.spec, study.policy, FAILURES, GRID.horizons, HOLDOUT_START), path)
    return study.spark.read.json(f"{path}/report").select(
        "schema_version", "rows", "segments", F.size("horizons").alias("horizons"), "window_policy.feature_windows"
    )


@query(
    "ts20_full_audit",
    sql(
        """SELECT 1 AS schema_version, (SELECT count(*) FROM raw) AS rows, (SELECT count(*) FROM valid) AS valid_rows,
             (SELECT count(*) FROM profile) AS segments, 4 AS horizons,
             (SELECT count(*) FROM windows) AS feature_windows, 3600 AS history_seconds"""
    ),
)
def ts20(study):
    report = audit_report(
        audit_tables(study.raw(), study.spec, study.policy, FAILURES, GRID.horizons, HOLDOUT_START)
    )
    return report.select(
        "schema_version", "rows", "validation.valid_rows", "segments", F.size("horizons").alias("horizons"), "window_policy.feature_windows", "window_policy.history_seconds",
    )


# --- filters and projections -------------------------------------------------------------


@query(
    "prj4_optional_filters",
    rounded(
        sql("SELECT model, event, seed, average_precision FROM event_metrics WHERE horizon_hours = 6 AND"
            " event = 'june_failure'", EVENT_CTES),
        "average_precision",
    ),
)
def prj4(study):
    rows = eventwise_metrics(study.stored_traces(), GRID.holdout_event)
    return filter_rows(rows, model=None, horizon_hours=6, event="june_failure").select(
        "model", "event", "seed", "average_precision"
    )


@query(
    "prj5_lead_band",
    sql(
        "SELECT model, horizon_hours, seed, window_id FROM traces WHERE fold IS NULL AND window_end BETWEEN"
        " TIMESTAMP '2024-01-25 14:30:00' AND TIMESTAMP '2024-01-27 14:30:00'"
    ),
)
def prj5(study):
    return lead_band(holdout(study.with_stored_windows().traces()), ONSETS[-1][1]).select(*CELL, "window_id")


@query(
    "prj6_display_names",
    rounded(
        sql(
            """SELECT CASE event WHEN 'may_failure' THEN 'May development' WHEN 'june_failure' THEN 'June development'
                 ELSE 'July holdout' END AS event_name,
               CASE model WHEN 'xgboost' THEN 'XGBoost' WHEN 'tcn' THEN 'TCN' ELSE 'Attention-TCN' END AS model_name,
               horizon_hours, seed, prevalence, average_precision AS average_precision_mean,
               ap_lift_over_prevalence AS ap_lift_mean, roc_auc AS roc_auc_mean FROM event_metrics""",
            EVENT_CTES,
        ),
        "prevalence", "average_precision_mean", "ap_lift_mean", "roc_auc_mean",
    ),
)
def prj6(study):
    rows = eventwise_metrics(study.stored_traces(), GRID.holdout_event)
    return comparison_table(rows, MODEL_LABELS, EVENT_LABELS)


# --- summaries ---------------------------------------------------------------------------

POLICY_MEANS = ["threshold", "average_precision", "ap_lift_over_prevalence", "roc_auc", "prevalence", "balanced_accuracy",
                '"precision"', "recall", "false_alert_episodes_per_day", "event_detection_rate", "first_alert_lead_hours"]


@query(
    "ag14_policy_summary",
    rounded(
        sql(
            "SELECT model, horizon_hours, threshold_policy, threshold, "
            + ", ".join(f"avg({c}) AS {c}" for c in POLICY_MEANS[1:] if c != "event_detection_rate")
            + ", avg(CAST(held_out_event_detected AS INTEGER)) AS event_detection_rate FROM policy_metrics GROUP BY 1, 2, 3, 4",
            POLICY_CTES,
        ),
        *POLICY_MEANS,
    ),
)
def ag14(study):
    return policy_summary(metrics(study.stored_traces()))


@query(
    "ag15_alert_burden",
    rounded(
        sql(
            """SELECT model, horizon_hours, threshold_policy, avg(false_alert_episodes_per_day) AS false_alerts_per_day,
                 avg(CAST(held_out_event_detected AS INTEGER)) AS event_detection_rate
               FROM policy_metrics GROUP BY 1, 2, 3""",
            POLICY_CTES,
        ),
        "false_alerts_per_day", "event_detection_rate",
    ),
)
def ag15(study):
    return alert_burden(metrics(study.stored_traces()))


@query(
    "ag16_cost_against_ranking",
    rounded(
        sql(
            """SELECT p.model, avg(d.n / 1000.0) AS fit_seconds, avg(p.windows / 1000.0) AS final_fit_seconds,
                 avg(ap_lift_over_prevalence) AS heldout_ap_lift, avg(d.n / 1000.0) + avg(p.windows / 1000.0) AS total_fit_seconds
               FROM policy_metrics p JOIN (SELECT model, horizon_hours, seed, count(*) AS n FROM traces
                 WHERE fold IS NOT NULL GROUP BY 1, 2, 3) d USING (model, horizon_hours, seed)
               WHERE threshold_policy = 'reference_0.5' GROUP BY 1""",
            POLICY_CTES,
        ),
        "fit_seconds", "final_fit_seconds", "heldout_ap_lift", "total_fit_seconds",
    ),
)
def ag16(study):
    """Fit times stand for the number of rows each fit would read."""
    traces = study.stored_traces()
    cost = development(traces).groupBy(*CELL).agg((F.count(F.lit(1)) / 1000.0).alias("development_fit_seconds"))
    rows = metrics(traces).join(cost, list(CELL)).withColumn("final_fit_seconds", F.col("windows") / 1000.0)
    return cost_against_ranking(rows)


@query(
    "ag17_event_timeline",
    rounded(
        sql(
            """SELECT model, horizon_hours, hours_to_next_failure, avg(probability) AS probability_mean,
                 stddev_samp(probability) AS probability_std FROM traces
               WHERE fold IS NULL AND hours_to_next_failure BETWEEN 0 AND 24 GROUP BY 1, 2, 3"""
        ),
        "hours_to_next_failure", "probability_mean", "probability_std",
    ),
)
def ag17(study):
    return event_timeline(holdout(study.with_stored_windows().traces()), ["model", "horizon_hours"])


@query(
    "so5_timeline_order",
    rounded(
        sql(
            """SELECT *, row_number() OVER (PARTITION BY event, model, horizon_hours ORDER BY hours_to_next_failure DESC) AS place
               FROM (SELECT coalesce(fold, 'july_holdout') AS event, model, horizon_hours, hours_to_next_failure,
                   avg(probability) AS probability_mean, stddev_samp(probability) AS probability_std
                 FROM traces WHERE hours_to_next_failure BETWEEN 0 AND 24 GROUP BY ALL)"""
        ),
        "hours_to_next_failure", "probability_mean", "probability_std",
    ),
)
def so5(study):
    """Every cell's timeline from far to near; a timeline's hours are as many as its last day has windows."""
    rows = study.with_stored_windows().traces().withColumn("event", F.coalesce("fold", F.lit(GRID.holdout_event)))
    cells = ["event", "model", "horizon_hours"]
    order = Window.partitionBy(*cells).orderBy(F.desc("hours_to_next_failure"))
    return event_timeline(rows, cells).withColumn("place", F.row_number().over(order)).orderBy(*cells, "place")


@query(
    "ag18_seed_band",
    rounded(
        sql(
            """SELECT model, horizon_hours, window_end, avg(probability) AS probability, min(probability) AS probability_min,
                 max(probability) AS probability_max FROM traces WHERE fold IS NULL GROUP BY 1, 2, 3"""
        ),
        "probability", "probability_min", "probability_max",
    ),
)
def ag18(study):
    return seed_band(holdout(study.with_stored_windows().traces()), keys=["model", "horizon_hours"])


@query(
    "ag18_single_seed_trace",
    rounded(
        sql(
            """SELECT model, horizon_hours, window_end, probability, probability AS probability_min,
                 probability AS probability_max
               FROM traces WHERE fold IS NULL AND seed = 42"""
        ),
        "probability", "probability_min", "probability_max",
    ),
)
def ag18_single(study):
    return seed_band(holdout(study.with_stored_windows().traces()), seed=42, keys=["model", "horizon_hours"])


@query(
    "ag19_horizon_performance",
    rounded(
        sql("SELECT model, horizon_hours, ap_lift_mean, coalesce(ap_lift_std, 0) AS ap_lift_std FROM summary"
            " WHERE event = 'july_holdout' ORDER BY 1, 2", SUMMARY),
        "ap_lift_mean", "ap_lift_std",
    ),
)
def ag19(study):
    return horizon_performance(_summary(study), GRID.holdout_event).orderBy("model", "horizon_hours")


@query(
    "ag20_cross_event_pivot",
    rounded(
        sql(
            "SELECT event, " + ", ".join(f"max(ap_lift_mean) FILTER (model = '{m}') AS {m}" for m in GRID.models)
            + " FROM summary WHERE horizon_hours = 1 GROUP BY 1",
            SUMMARY,
        ),
        *GRID.models,
    ),
)
def ag20(study):
    return cross_event_pivot(_summary(study), GRID.models)


# --- regimes -----------------------------------------------------------------------------


def regime_ctes(strict: bool = False) -> str:
    if strict:
        close = "bool_or(hours BETWEEN 0 AND 48)"
    else:
        close = "min(hours) BETWEEN 0 AND 48"
    features = " UNION ALL ".join(f"SELECT regime, '{f}' AS feature, {f} AS reading FROM members" for f in FEATURES)
    return f"""onsets AS (SELECT * FROM (VALUES {ONSET_ROWS}) AS t(event, onset)),
distances AS (
  SELECT p.window_id, o.event, (epoch_us(o.onset) - epoch_us(p.window_end)) / 3600000000.0 AS hours
  FROM predictive p, onsets o),
regimes AS (
  SELECT window_id, coalesce(max(event) FILTER (hours BETWEEN 0 AND 24),
    CASE WHEN {close} THEN 'near_failure_excluded' ELSE 'normal' END) AS regime FROM distances GROUP BY 1),
members AS (SELECT p.*, r.regime FROM predictive p JOIN regimes r ON r.window_id = p.window_id),
long AS ({features}),
stats AS (
  SELECT feature, regime, quantile_cont(reading, 0.5) AS middle,
    quantile_cont(reading, 0.75) - quantile_cont(reading, 0.25) AS iqr, count(reading) AS n
  FROM long WHERE regime <> 'near_failure_excluded' AND reading IS NOT NULL GROUP BY 1, 2),
effects AS (
  SELECT e.regime AS event, e.feature, n.middle AS normal_median, n.iqr AS normal_iqr, e.middle AS event_median,
    (e.middle - n.middle) / CASE WHEN n.iqr > 0 THEN n.iqr ELSE 1.0 END AS robust_standardized_difference, e.n AS event_windows
  FROM stats e JOIN stats n ON n.feature = e.feature AND n.regime = 'normal' WHERE e.regime <> 'normal'),
pivoted AS (
  SELECT feature, {", ".join(f"max(robust_standardized_difference) FILTER (event = '{e}') AS {e}" for e in EVENTS)}
  FROM effects GROUP BY 1),
consistency AS (
  SELECT *, abs(sign(may_failure) + sign(june_failure) + sign(july_holdout)) / 3.0 AS direction_consistency,
    coalesce(abs(sign(may_failure) + sign(june_failure) + sign(july_holdout)) = 3, false) AS all_events_same_direction
  FROM pivoted)"""


REGIMES = regime_ctes()
EFFECT_DOUBLES = ["normal_median", "normal_iqr", "event_median", "robust_standardized_difference"]


def _effects(study):
    members = stage_table(study.regime_members(), "regimes")
    return regime_effects(members, FEATURES, ONSETS)


@query("jn10_regime_membership", sql("SELECT window_id, regime FROM regimes", REGIMES))
def jn10(study):
    from forewarn.operators.regimes import regime

    return study.predictive().select("window_id", regime(ONSETS).alias("regime"))


@query("jn10_strict_regime_membership", sql("SELECT window_id, regime FROM regimes", regime_ctes(strict=True)))
def jn10_strict(study):
    from forewarn.operators.regimes import regime

    return study.predictive().select("window_id", regime(ONSETS, strict=True).alias("regime"))


@query("ag22_regime_effects", rounded(sql("SELECT * FROM effects", REGIMES), *EFFECT_DOUBLES))
def ag22(study):
    return _effects(study)


@query("ag21_effects_pivot", rounded(sql("SELECT * FROM pivoted", REGIMES), *EVENTS))
def ag21(study):
    return pivot_effects(_effects(study), EVENTS)


@query(
    "ag23_direction_consistency",
    rounded(sql("SELECT * FROM consistency", REGIMES), *EVENTS, "direction_consistency"),
)
def ag23(study):
    return regime_summary(_effects(study), EVENTS)


@query(
    "so4_least_consistent_features",
    rounded(
        sql("SELECT * FROM consistency ORDER BY direction_consistency, feature LIMIT 12", REGIMES),
        *EVENTS, "direction_consistency",
    ),
)
def so4(study):
    return least_consistent(regime_summary(_effects(study), EVENTS))


@query(
    "jn6_effects_of_features",
    rounded(
        sql("SELECT * FROM effects WHERE feature IN (SELECT feature FROM consistency ORDER BY direction_consistency,"
            " feature LIMIT 5)", REGIMES),
        *EFFECT_DOUBLES,
    ),
)
def jn6(study):
    effects = _effects(study)
    return effects_of(effects, least_consistent(regime_summary(effects, EVENTS), 5))
