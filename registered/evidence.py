"""Alert runs, thresholds, metrics and checks over prediction traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from forewarn.operators.alerts import CELL, alert_runs, false_alert_episodes, mark_run_starts
from forewarn.operators.checks import (
    differing_identities,
    evidence_errors,
    evidence_report,
    experiment_cells,
    identity_mismatches,
    missing_pairs,
    pending_cells,
    thresholds_per_group,
    trace_problems,
    unequal_windows,
    version_counts,
)
from forewarn.operators.metrics import (
    confusion_counts,
    decision_scores,
    evaluated_days,
    eventwise_metrics,
    in_event_order,
    policy_metrics,
    prevalence,
    ranking_metrics,
    ranking_scores,
    score_medians,
    seed_summary,
)
from forewarn.operators.thresholds import (
    apply_thresholds,
    complete_groups,
    select_threshold,
    sweep_thresholds,
    threshold_records,
)
from forewarn.plans.events_study import GRID, THRESHOLDS
from forewarn.sources.manifest import commit_cells, pending_in_manifest, read_cells
from forewarn.sources.sinks import fresh_path, stage_table
from registered.base import query, rounded, sql

STEP = 1800
PARTS = [name for name, _, _ in GRID.folds]

SWEEP_CTES = """candidates AS (
  SELECT CAST(i AS INTEGER) AS candidate, 0.05::DOUBLE + i * ((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE) AS threshold
  FROM generate_series(0, 90) AS g(i)),
development AS (
  SELECT t.*, s.s AS seed_place, f.position AS fold_place
  FROM traces t JOIN seeds s ON s.seed = t.seed JOIN folds f ON f.fold = t.fold),
tried AS (
  SELECT d.*, c.candidate, c.threshold, d.probability >= c.threshold AS predicted,
    lag(d.probability >= c.threshold) OVER w AS before, lag(d.window_start) OVER w AS before_start
  FROM development d, candidates c
  WINDOW w AS (PARTITION BY model, horizon_hours, candidate, segment_id ORDER BY window_start, seed_place, fold_place)),
sweep AS (
  SELECT model, horizon_hours, candidate, threshold,
    count(*) FILTER (predicted AND true_label = 1) AS tp, count(*) FILTER (predicted AND true_label = 0) AS fp,
    count(*) FILTER (NOT predicted AND true_label = 1) AS fn, count(*) FILTER (NOT predicted AND true_label = 0) AS tn,
    count(*) FILTER (predicted AND true_label = 0 AND (NOT coalesce(before, false)
      OR epoch_us(window_start) - epoch_us(before_start) > 1800000000)) AS false_alert_episodes
  FROM tried GROUP BY 1, 2, 3, 4),
scored AS (
  SELECT *, CASE WHEN 5 * tp + 4 * fn + fp = 0 THEN 0.0 ELSE 5.0 * tp / (5 * tp + 4 * fn + fp) END AS f_beta FROM sweep),
selected AS (
  SELECT model, horizon_hours, round(threshold, 10) AS threshold, f_beta AS development_f_beta,
    false_alert_episodes AS development_false_alert_episodes
  FROM (SELECT *, row_number() OVER (PARTITION BY model, horizon_hours
    ORDER BY f_beta DESC, false_alert_episodes, threshold DESC) AS place FROM scored) WHERE place = 1),
decided AS (
  SELECT t.*, s.threshold AS operational_threshold, CAST(probability >= 0.5 AS INTEGER) AS reference_prediction,
    CAST(probability >= s.threshold AS INTEGER) AS operational_prediction
  FROM traces t JOIN selected s ON s.model = t.model AND s.horizon_hours = t.horizon_hours WHERE t.fold IS NULL)"""

# The same choice without a row for each candidate and window: a window reaches so many candidates, and opens runs for
# those between what the window before it reached (none after a gap) and what it reaches itself.
CHOSEN_CTES = """traced_once AS MATERIALIZED (SELECT * FROM traces),
candidates AS (
  SELECT CAST(i AS INTEGER) AS candidate, 0.05::DOUBLE + i * ((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE) AS threshold
  FROM generate_series(0, 90) AS g(i)),
reaches AS MATERIALIZED (
  SELECT probability, count(*) FILTER (threshold <= probability) AS reached
  FROM (SELECT DISTINCT probability FROM traced_once), candidates GROUP BY 1),
stepped AS MATERIALIZED (
  SELECT model, horizon_hours, true_label, reached,
    CASE WHEN epoch_us(window_start) - epoch_us(lag(window_start) OVER w) <= 1800000000 THEN lag(reached) OVER w ELSE 0 END AS low
  FROM traced_once t JOIN reaches USING (probability) JOIN seeds s ON s.seed = t.seed JOIN folds f ON f.fold = t.fold
  WINDOW w AS (PARTITION BY model, horizon_hours, segment_id ORDER BY window_start, s.s, f.position)),
counted AS MATERIALIZED (
  SELECT model, horizon_hours, true_label, reached, coalesce(low, 0) AS low, count(*) AS n FROM stepped GROUP BY ALL),
sweep AS (
  SELECT model, horizon_hours, candidate, threshold,
    coalesce(sum(n) FILTER (true_label = 1 AND reached > candidate), 0) AS tp,
    coalesce(sum(n) FILTER (true_label = 0 AND reached > candidate), 0) AS fp,
    coalesce(sum(n) FILTER (true_label = 1 AND reached <= candidate), 0) AS fn,
    coalesce(sum(n) FILTER (true_label = 0 AND reached > candidate AND low <= candidate), 0) AS runs
  FROM counted, candidates GROUP BY ALL),
selected AS MATERIALIZED (
  SELECT model, horizon_hours, round(threshold, 10) AS threshold
  FROM (SELECT *, row_number() OVER (PARTITION BY model, horizon_hours ORDER BY
      CASE WHEN 5 * tp + 4 * fn + fp = 0 THEN 0.0 ELSE 5.0 * tp / (5 * tp + 4 * fn + fp) END DESC, runs, threshold DESC) AS place
    FROM sweep) WHERE place = 1)"""

RUN_CTES = f"""{SWEEP_CTES},
ordered AS (
  SELECT *, lag(reference_prediction) OVER w AS before, lag(window_start) OVER w AS before_start
  FROM decided WINDOW w AS (PARTITION BY model, horizon_hours, seed, segment_id ORDER BY window_start)),
marked AS (
  SELECT *, reference_prediction = 1 AND (coalesce(before, 0) = 0
    OR epoch_us(window_start) - epoch_us(before_start) > 1800000000) AS starts_run FROM ordered),
run_rows AS (
  SELECT *, sum(CASE WHEN starts_run THEN 1 ELSE 0 END) OVER (
    PARTITION BY model, horizon_hours, seed, segment_id ORDER BY window_start) AS run FROM marked)"""


def metric_ctes(keys: str, source: str, prefix: str) -> str:
    """Naive ranking metrics of a source table by some keys."""
    join = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""{prefix}_scores AS (
  SELECT {keys}, probability, count(*) FILTER (true_label = 1) AS pos, count(*) FILTER (true_label = 0) AS neg
  FROM {source} GROUP BY ALL),
{prefix}_cumulative AS (
  SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM {prefix}_scores
  WINDOW w AS (PARTITION BY {keys} ORDER BY probability DESC)),
{prefix}_ranked AS (
  SELECT {keys}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
      sum(pos * (cum_pos::DOUBLE / (cum_pos + cum_neg))) / sum(pos) END AS average_precision,
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
      sum(neg * (cum_pos - pos + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) END AS roc_auc
  FROM {prefix}_cumulative GROUP BY {keys}),
{prefix}_basics AS (
  SELECT {keys}, count(*) AS windows, CAST(sum(true_label) AS BIGINT) AS positive_windows, avg(true_label) AS prevalence,
    quantile_cont(probability, 0.5) FILTER (true_label = 1) AS positive_score_median,
    quantile_cont(probability, 0.5) FILTER (true_label = 0) AS negative_score_median
  FROM {source} GROUP BY ALL),
{prefix}_metrics AS (
  SELECT a.*, b.average_precision, b.average_precision / a.prevalence AS ap_lift_over_prevalence, b.roc_auc,
    positive_score_median - negative_score_median AS median_score_gap
  FROM {prefix}_basics a JOIN {prefix}_ranked b ON {join})"""


RANK_KEYS = "model, horizon_hours, seed, event"
EVENT_CTES = (
    "evented AS (SELECT *, coalesce(fold, 'july_holdout') AS event FROM traces),\n"
    + metric_ctes(RANK_KEYS, "evented", "event")
)
RANK_COLUMNS = ["prevalence", "average_precision", "ap_lift_over_prevalence", "roc_auc", "positive_score_median",
                "negative_score_median", "median_score_gap"]

POLICY_CTES = f"""{SWEEP_CTES},
policies AS (
  SELECT *, 'reference_0.5' AS threshold_policy, 0.5::DOUBLE AS threshold, reference_prediction AS prediction FROM decided
  UNION ALL
  SELECT *, 'development_selected', operational_threshold, operational_prediction FROM decided),
policy_rows AS (
  SELECT *, lag(prediction) OVER w AS before, lag(window_start) OVER w AS before_start FROM policies
  WINDOW w AS (PARTITION BY model, horizon_hours, seed, threshold_policy, segment_id ORDER BY window_start)),
spans AS (
  SELECT model, horizon_hours, seed, segment_id,
    greatest(epoch_us(max(window_start)) - epoch_us(min(window_start)) + 1800000000, 1800000000) AS span
  FROM decided GROUP BY 1, 2, 3, 4),
days AS (SELECT model, horizon_hours, seed, sum(span) / 86400000000.0 AS evaluated_days FROM spans GROUP BY 1, 2, 3),
{metric_ctes("model, horizon_hours, seed", "decided", "cell")},
counted AS (
  SELECT model, horizon_hours, seed, threshold_policy, threshold, count(*) AS windows,
    CAST(sum(true_label) AS BIGINT) AS positive_windows, avg(true_label) AS prevalence,
    avg((probability - true_label) * (probability - true_label)) AS brier_score,
    count(*) FILTER (prediction = 0 AND true_label = 0) AS tn, count(*) FILTER (prediction = 1 AND true_label = 0) AS fp,
    count(*) FILTER (prediction = 0 AND true_label = 1) AS fn, count(*) FILTER (prediction = 1 AND true_label = 1) AS tp,
    count(*) FILTER (prediction = 1 AND true_label = 0 AND (coalesce(before, 0) = 0
      OR epoch_us(window_start) - epoch_us(before_start) > 1800000000)) AS false_alert_episodes,
    max(hours_to_next_failure) FILTER (prediction = 1 AND true_label = 1) AS first_alert_lead_hours
  FROM policy_rows GROUP BY 1, 2, 3, 4, 5),
policy_metrics AS (
  SELECT c.*, r.average_precision, r.average_precision / c.prevalence AS ap_lift_over_prevalence, r.roc_auc,
    CASE WHEN tp + fn = 0 THEN tn::DOUBLE / (tn + fp) WHEN tn + fp = 0 THEN tp::DOUBLE / (tp + fn)
      ELSE (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END AS balanced_accuracy,
    CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS "precision",
    CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1,
    d.evaluated_days, false_alert_episodes / d.evaluated_days AS false_alert_episodes_per_day,
    tp > 0 AS held_out_event_detected
  FROM counted c
  JOIN cell_ranked r ON r.model = c.model AND r.horizon_hours = c.horizon_hours AND r.seed = c.seed
  JOIN days d ON d.model = c.model AND d.horizon_hours = c.horizon_hours AND d.seed = c.seed)"""
POLICY_DOUBLES = [
    "threshold", "prevalence", "average_precision", "ap_lift_over_prevalence", "roc_auc", "brier_score",
    "balanced_accuracy", '"precision"', "recall", "f1", "evaluated_days", "false_alert_episodes_per_day",
    "first_alert_lead_hours",
]
SUMMARY_CTE = """summary AS (
  SELECT event, horizon_hours, model, CAST(count(DISTINCT seed) AS INTEGER) AS seeds, avg(prevalence) AS prevalence,
    avg(average_precision) AS average_precision_mean, stddev_samp(average_precision) AS average_precision_std,
    avg(ap_lift_over_prevalence) AS ap_lift_mean, stddev_samp(ap_lift_over_prevalence) AS ap_lift_std,
    avg(roc_auc) AS roc_auc_mean, stddev_samp(roc_auc) AS roc_auc_std, avg(median_score_gap) AS median_score_gap_mean
  FROM event_metrics GROUP BY 1, 2, 3)"""
SUMMARY_DOUBLES = ["prevalence", "average_precision_mean", "average_precision_std", "ap_lift_mean", "ap_lift_std",
                   "roc_auc_mean", "roc_auc_std", "median_score_gap_mean"]


def development(traces):
    return traces.where(F.col("fold").isNotNull())


def holdout(traces):
    return traces.where(F.col("fold").isNull()).drop("fold")


def thresholds(traces):
    sweep = sweep_thresholds(development(traces), THRESHOLDS, STEP, seeds=GRID.seeds, folds=PARTS)
    return select_threshold(sweep)


def decided(traces):
    """Holdout rows with hard predictions: a stored stage, since every metric reads it."""
    return stage_table(apply_thresholds(holdout(traces), thresholds(traces), THRESHOLDS), "decided")


def metrics(traces):
    return policy_metrics(decided(traces), THRESHOLDS, STEP)


@query(
    "prj8_prediction_projection",
    rounded(sql("SELECT * FROM traces"), "probability", "hours_to_next_failure"),
)
def prj8(study):
    return study.with_stored_windows().traces()


@query(
    "st1_union_folds",
    sql("SELECT coalesce(fold, 'july_holdout') AS event, count(*) AS rows FROM traces GROUP BY 1"),
)
def st1(study):
    traces = study.with_stored_windows().traces()
    both = development(traces).withColumnRenamed("fold", "event").unionByName(
        holdout(traces).withColumn("event", F.lit(GRID.holdout_event))
    )
    return both.groupBy("event").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "val6_trace_checks",
    sql(
        """SELECT model, horizon_hours, seed, CAST(sum(copies) AS BIGINT) AS rows, CAST(sum(bad) AS BIGINT) AS bad_probabilities,
             count(*) FILTER (copies > 1) AS repeated_windows
           FROM (SELECT model, horizon_hours, seed, window_id, count(*) AS copies,
               count(*) FILTER (NOT coalesce(probability * 1.2 BETWEEN 0 AND 1, false)) AS bad
             FROM (SELECT * FROM traces WHERE fold IS NULL UNION ALL
               SELECT * FROM traces WHERE fold IS NULL AND probability > 0.9) GROUP BY 1, 2, 3, 4)
           GROUP BY 1, 2, 3"""
    ),
)
def val6(study):
    """A holdout trace spoiled by scores above one and by repeated windows."""
    rows = holdout(study.stored_traces())
    spoiled = rows.unionByName(rows.where(F.col("probability") > 0.9)).withColumn(
        "probability", F.col("probability") * 1.2
    )
    return trace_problems(spoiled)


@query(
    "fa1_false_alert_episodes",
    sql(
        "SELECT model, horizon_hours, seed, count(*) FILTER (starts_run AND true_label = 0) AS false_alert_episodes"
        " FROM marked GROUP BY 1, 2, 3",
        RUN_CTES,
    ),
)
def fa1(study):
    return false_alert_episodes(decided(study.stored_traces()), "reference_prediction", step_seconds=STEP)


@query(
    "fa1_run_starts",
    sql("SELECT model, horizon_hours, seed, window_id, starts_run FROM marked", RUN_CTES),
)
def fa1_starts(study):
    marked = mark_run_starts(decided(study.stored_traces()), "reference_prediction", step_seconds=STEP)
    return marked.select(*CELL, "window_id", "starts_run")


@query(
    "fa2_alert_runs",
    sql(
        """SELECT model, horizon_hours, seed, segment_id, CAST(run AS BIGINT) AS run, min(window_start) AS run_start,
             max(window_end) AS run_end, count(*) AS windows, arg_min(true_label, window_start) AS first_label,
             arg_min(true_label, window_start) = 0 AS is_false_alert
           FROM run_rows WHERE reference_prediction = 1 GROUP BY 1, 2, 3, 4, 5""",
        RUN_CTES,
    ),
)
def fa2(study):
    return alert_runs(decided(study.stored_traces()), "reference_prediction", step_seconds=STEP)


@query(
    "th1_candidates_reached",
    sql(
        "SELECT model, horizon_hours, seed, window_id, (SELECT CAST(count(*) AS INTEGER) FROM candidates c"
        " WHERE c.threshold <= t.probability) AS reached FROM traces t",
        SWEEP_CTES,
    ),
)
def th1(study):
    from forewarn.operators.thresholds import candidates_reached

    traces = study.with_stored_windows().traces()
    return traces.select(*CELL, "window_id", candidates_reached(F.col("probability"), THRESHOLDS).alias("reached"))


@query("th2_threshold_sweep", rounded(sql("SELECT * FROM scored", SWEEP_CTES), "threshold", "f_beta"))
def th2(study):
    return sweep_thresholds(development(study.stored_traces()), THRESHOLDS, STEP, seeds=GRID.seeds, folds=PARTS)


@query(
    "th3_operational_threshold",
    rounded(sql("SELECT * FROM selected", SWEEP_CTES), "threshold", "development_f_beta"),
)
def th3(study):
    return thresholds(study.stored_traces())


@query(
    "th3_threshold_per_seed_runs",
    sql(
        """SELECT model, horizon_hours, candidate, count(*) FILTER (predicted AND true_label = 0 AND (NOT coalesce(before, false)
             OR epoch_us(window_start) - epoch_us(before_start) > 1800000000)) AS false_alert_episodes
           FROM (SELECT d.*, c.candidate, d.probability >= c.threshold AS predicted,
               lag(d.probability >= c.threshold) OVER w AS before, lag(d.window_start) OVER w AS before_start
             FROM development d, candidates c
             WINDOW w AS (PARTITION BY model, horizon_hours, candidate, seed, segment_id ORDER BY window_start, fold_place))
           GROUP BY 1, 2, 3""",
        SWEEP_CTES,
    ),
)
def th3_per_seed(study):
    sweep = sweep_thresholds(
        development(study.stored_traces()), THRESHOLDS, STEP, seeds=GRID.seeds, folds=PARTS, per_seed=True
    )
    return sweep.select("model", "horizon_hours", "candidate", "false_alert_episodes")


@query(
    "th4_applied_thresholds",
    rounded(
        sql(
            """SELECT model, horizon_hours, seed, window_id, threshold AS operational_threshold,
                 CAST(probability >= 0.5 AS INTEGER) AS reference_prediction,
                 CAST(probability >= threshold AS INTEGER) AS operational_prediction
               FROM traced_once JOIN selected USING (model, horizon_hours) WHERE fold IS NULL""",
            CHOSEN_CTES,
        ),
        "operational_threshold",
    ),
)
def th4(study):
    """Thresholds applied to groups that have every seed."""
    traces = study.stored_traces()
    ready = complete_groups(holdout(traces), GRID.seeds)
    return decided(traces).join(ready, ["model", "horizon_hours"], "left_semi").select(
        *CELL, "window_id", "operational_threshold", "reference_prediction", "operational_prediction"
    )


@query(
    "th4_complete_groups",
    sql(
        """SELECT model, horizon_hours FROM traces WHERE fold IS NULL AND NOT (model = 'tcn' AND seed = 89 AND horizon_hours > 3)
           GROUP BY 1, 2 HAVING count(DISTINCT seed) = 3"""
    ),
)
def th4_complete(study):
    """Two groups lost one seed and are not ready."""
    lost = (F.col("model") == "tcn") & (F.col("seed") == 89) & (F.col("horizon_hours") > 3)
    return complete_groups(holdout(study.stored_traces()).where(~lost), GRID.seeds)


@query(
    "prj7_hard_predictions",
    sql(
        "SELECT model, horizon_hours, CAST(sum(reference_prediction) AS BIGINT) AS reference_alerts,"
        " CAST(sum(operational_prediction) AS BIGINT) AS operational_alerts FROM decided GROUP BY 1, 2",
        SWEEP_CTES,
    ),
)
def prj7(study):
    return decided(study.stored_traces()).groupBy("model", "horizon_hours").agg(
        F.sum(F.col("reference_prediction").cast("long")).alias("reference_alerts"),
        F.sum(F.col("operational_prediction").cast("long")).alias("operational_alerts"),
    )


@query(
    "jn9_thresholds_per_group",
    sql(
        """SELECT model, horizon_hours, count(*) AS records FROM (
             SELECT model, horizon_hours FROM selected UNION ALL SELECT model, horizon_hours FROM selected WHERE threshold > 0.2)
           GROUP BY 1, 2 HAVING count(*) <> 1""",
        SWEEP_CTES,
    ),
)
def jn9(study):
    """Groups that would not have exactly one threshold after a second, partial selection."""
    chosen = thresholds(study.stored_traces())
    return thresholds_per_group(chosen.unionByName(chosen.where(F.col("threshold") > 0.2)))


@query(
    "jn9_threshold_join",
    rounded(
        sql("SELECT DISTINCT t.model, t.horizon_hours, t.seed, s.threshold FROM traces t JOIN selected s"
            " ON s.model = t.model AND s.horizon_hours = t.horizon_hours", SWEEP_CTES),
        "threshold",
    ),
)
def jn9_join(study):
    traces = study.stored_traces()
    cells = traces.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    return cells.join(thresholds(traces).select("model", "horizon_hours", "threshold"), ["model", "horizon_hours"])


CELL_CTES = metric_ctes("model, horizon_hours, seed", "(SELECT * FROM traces WHERE fold IS NULL)", "cell")


@query(
    "ag1_average_precision",
    rounded(sql("SELECT model, horizon_hours, seed, average_precision FROM cell_ranked", CELL_CTES), "average_precision"),
)
def ag1(study):
    return ranking_scores(holdout(study.stored_traces()), CELL).drop("roc_auc")


@query(
    "ag2_roc_auc",
    rounded(
        sql(
            """SELECT model, horizon_hours, seed, sum(CASE WHEN p.probability > n.probability THEN 1.0
                 WHEN p.probability = n.probability THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS roc_auc
               FROM (SELECT * FROM traces WHERE fold IS NULL AND true_label = 1) p
               JOIN (SELECT * FROM traces WHERE fold IS NULL AND true_label = 0) n USING (model, horizon_hours, seed)
               GROUP BY 1, 2, 3"""
        ),
        "roc_auc",
    ),
)
def ag2(study):
    return ranking_scores(holdout(study.stored_traces()), CELL).drop("average_precision")


@query(
    "ag3_prevalence_and_lift",
    rounded(
        sql("SELECT model, horizon_hours, seed, windows, positive_windows, prevalence, ap_lift_over_prevalence"
            " FROM cell_metrics", CELL_CTES),
        "prevalence", "ap_lift_over_prevalence",
    ),
)
def ag3(study):
    rows = holdout(study.stored_traces())
    return prevalence(rows, CELL).join(ranking_scores(rows, CELL), list(CELL)).select(
        *CELL, "windows", "positive_windows", "prevalence",
        (F.col("average_precision") / F.col("prevalence")).alias("ap_lift_over_prevalence"),
    )


@query(
    "ag4_score_medians",
    rounded(
        sql("SELECT model, horizon_hours, seed, positive_score_median, negative_score_median, median_score_gap"
            " FROM cell_metrics", CELL_CTES),
        "positive_score_median", "negative_score_median", "median_score_gap",
    ),
)
def ag4(study):
    return score_medians(holdout(study.stored_traces()), CELL)


@query("ag5_ranking_metrics", rounded(sql("SELECT * FROM cell_metrics", CELL_CTES), *RANK_COLUMNS))
def ag5(study):
    return ranking_metrics(holdout(study.stored_traces()), CELL)


@query("ag6_eventwise_metrics", rounded(sql("SELECT * FROM event_metrics", EVENT_CTES), *RANK_COLUMNS))
def ag6(study):
    return eventwise_metrics(study.stored_traces(), GRID.holdout_event)


@query(
    "so2_event_order",
    rounded(
        sql("SELECT event, horizon_hours, model, seed, average_precision FROM event_metrics ORDER BY"
            " list_position(['may_failure', 'june_failure', 'july_holdout'], event), 2, 3, 4", EVENT_CTES),
        "average_precision",
    ),
)
def so2(study):
    rows = eventwise_metrics(study.stored_traces(), GRID.holdout_event)
    return in_event_order(rows, GRID.events, "horizon_hours", "model", "seed").select(
        "event", "horizon_hours", "model", "seed", "average_precision"
    )


@query(
    "ag7_seed_summary",
    rounded(sql("SELECT * FROM summary", f"{EVENT_CTES},\n{SUMMARY_CTE}"), *SUMMARY_DOUBLES),
)
def ag7(study):
    return seed_summary(eventwise_metrics(study.stored_traces(), GRID.holdout_event))


@query(
    "ag8_confusion_counts",
    sql(
        """SELECT model, horizon_hours, seed,
             count(*) FILTER (operational_prediction = 0 AND true_label = 0) AS tn,
             count(*) FILTER (operational_prediction = 1 AND true_label = 0) AS fp,
             count(*) FILTER (operational_prediction = 0 AND true_label = 1) AS fn,
             count(*) FILTER (operational_prediction = 1 AND true_label = 1) AS tp FROM decided GROUP BY 1, 2, 3""",
        SWEEP_CTES,
    ),
)
def ag8(study):
    return confusion_counts(decided(study.stored_traces()), "operational_prediction", CELL)


@query(
    "ag9_decision_scores",
    rounded(
        sql('SELECT model, horizon_hours, seed, balanced_accuracy, "precision", recall, f1 FROM policy_metrics'
            " WHERE threshold_policy = 'development_selected'", POLICY_CTES),
        "balanced_accuracy", '"precision"', "recall", "f1",
    ),
)
def ag9(study):
    counts = confusion_counts(decided(study.stored_traces()), "operational_prediction", CELL)
    return counts.withColumns(decision_scores()).select(*CELL, "balanced_accuracy", "precision", "recall", "f1")


@query(
    "ag10_brier_score",
    rounded(
        sql("SELECT model, horizon_hours, seed, avg(pow(probability - true_label, 2)) AS brier_score FROM traces"
            " WHERE fold IS NULL GROUP BY 1, 2, 3"),
        "brier_score",
    ),
)
def ag10(study):
    squared = F.pow(F.col("probability") - F.col("true_label"), F.lit(2))
    return holdout(study.stored_traces()).groupBy(*CELL).agg(F.avg(squared).alias("brier_score"))


@query(
    "ag11_evaluated_days",
    rounded(sql("SELECT * FROM days", POLICY_CTES), "evaluated_days"),
)
def ag11(study):
    return evaluated_days(holdout(study.stored_traces()), STEP)


@query(
    "ag12_detection_and_lead",
    rounded(
        sql("SELECT model, horizon_hours, seed, threshold_policy, held_out_event_detected, first_alert_lead_hours"
            " FROM policy_metrics", POLICY_CTES),
        "first_alert_lead_hours",
    ),
)
def ag12(study):
    return metrics(study.stored_traces()).select(
        *CELL, "threshold_policy", "held_out_event_detected", "first_alert_lead_hours"
    )


@query("ag13_policy_metrics", rounded(sql("SELECT * FROM policy_metrics", POLICY_CTES), *POLICY_DOUBLES))
def ag13(study):
    return metrics(study.stored_traces())


@query(
    "wf9_cumulative_precision_recall",
    rounded(
        sql(
            """SELECT model, horizon_hours, seed, probability, CAST(cum_pos AS BIGINT) AS true_positives,
                 cum_pos::DOUBLE / (cum_pos + cum_neg) AS precision_at FROM cell_cumulative""",
            CELL_CTES,
        ),
        "probability", "precision_at",
    ),
)
def wf9(study):
    """The precision-recall curve behind AP, one row per distinct score."""
    from forewarn.functions.ordered import running_sums
    from forewarn.functions.quantiles import magnitude_bucket

    label = F.col("true_label")
    scores = (
        holdout(study.stored_traces())
        .groupBy(*CELL, "probability")
        .agg(F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"))
        .withColumn("bucket", magnitude_bucket(F.col("probability")))
    )
    curve = running_sums(
        scores, CELL, ["bucket"], ["probability"], {"true_positives": "pos", "false_positives": "neg"}, descending=True
    )
    total = F.col("true_positives") + F.col("false_positives")
    return curve.select(*CELL, "probability", "true_positives", (F.col("true_positives") / total).alias("precision_at"))


GRID_CTE = "grid AS (SELECT m.model, h.horizon_hours, s.seed, m.m, s.s FROM models m, horizons h, seeds s)"


@query(
    "jn7_cell_grid",
    sql(
        f"""SELECT g.model, g.horizon_hours, CAST(g.seed AS INTEGER) AS seed,
              CAST(row_number() OVER (ORDER BY g.m, g.horizon_hours, g.s) - 1 AS INTEGER) AS position, coalesce(n, 0) AS rows
            FROM grid g LEFT JOIN (SELECT model, horizon_hours, seed, count(*) AS n FROM traces GROUP BY 1, 2, 3) t
              USING (model, horizon_hours, seed)""",
        GRID_CTE,
    ),
)
def jn7(study):
    """The grid in report order with the trace rows found for each cell."""
    found = study.with_stored_windows().traces().groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    return experiment_cells(study.spark, GRID).join(found, list(CELL), "left").select(
        *CELL, "position", F.coalesce("_n", F.lit(0)).alias("rows")
    )



LOST_COLUMN = "(model = 'attention_tcn' AND horizon_hours = 12) OR (seed = 17 AND horizon_hours = 3)"


@query(
    "jn8_pending_cells",
    sql(
        f"""SELECT model, horizon_hours, CAST(seed AS INTEGER) AS seed FROM grid EXCEPT
            SELECT model, horizon_hours, seed FROM traces WHERE NOT ({LOST_COLUMN})""",
        GRID_CTE,
    ),
)
def jn8(study):
    """Cells still to run when part of the traces is missing."""
    done = study.with_stored_windows().traces().where(f"NOT ({LOST_COLUMN})")
    return pending_cells(experiment_cells(study.spark, GRID), done).select(*CELL)


def _committed(study):
    """Traces committed cell by cell of what is not lost, next to a write that broke off; the commit is repeated."""
    root = fresh_path(study.spark, "cells")
    traces = study.stored_traces()
    done = traces.where(f"NOT ({LOST_COLUMN})")
    commit_cells(done, root, "study")
    # What a broken write leaves: rows under a batch that no manifest row names.
    traces.write.partitionBy(*CELL).parquet(f"{root}/cells/batch=broken")
    commit_cells(done, root, "study")
    return root


@query(
    "snk2_committed_cells",
    sql(
        f"""SELECT model, horizon_hours, CAST(seed AS INTEGER) AS seed, count(*) AS windows, sum(true_label)::BIGINT AS positives
            FROM traces WHERE NOT ({LOST_COLUMN}) GROUP BY ALL"""
    ),
)
def snk2_committed(study):
    """Only committed cells are read, each once."""
    return (
        read_cells(study.spark, _committed(study))
        .groupBy("model", "horizon_hours", "seed")
        .agg(F.count("*").alias("windows"), F.sum(F.col("true_label").cast("long")).alias("positives"))
    )


@query(
    "jn8_pending_in_manifest",
    sql(
        f"""SELECT model, horizon_hours, CAST(seed AS INTEGER) AS seed FROM grid EXCEPT
            SELECT model, horizon_hours, seed FROM traces WHERE NOT ({LOST_COLUMN})""",
        GRID_CTE,
    ),
)
def jn8_manifest(study):
    """Cells still to run, from the manifest alone."""
    return pending_in_manifest(experiment_cells(study.spark, GRID), _committed(study), "study").select(*CELL)


@query(
    "st2_window_set_equality",
    sql(
        """SELECT horizon_hours, seed, count(*) AS pairs, count(*) FILTER (n <> 3) AS unequal_pairs FROM (
             SELECT horizon_hours, seed, window_id, true_label, count(DISTINCT model) AS n FROM traces
             WHERE NOT (model = 'tcn' AND probability > 0.95) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""
    ),
)
def st2(study):
    """One model lost its highest scores, so some windows are not scored by all."""
    kept = study.stored_traces().where(~((F.col("model") == "tcn") & (F.col("probability") > 0.95)))
    return identity_mismatches(kept, GRID.models)


@query(
    "st2_differing_groups",
    sql(
        """SELECT horizon_hours, seed, pairs, unequal_pairs FROM (
             SELECT horizon_hours, seed, count(*) AS pairs, count(*) FILTER (n <> 3) AS unequal_pairs FROM (
               SELECT horizon_hours, seed, window_id, true_label, count(DISTINCT model) AS n FROM traces
               WHERE NOT (model = 'tcn' AND seed = 89 AND probability > 0.95) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
           WHERE unequal_pairs > 0"""
    ),
)
def st2_differing(study):
    """One model lost its highest scores under one seed: only that seed's windows are compared one by one."""
    lost = (F.col("model") == "tcn") & (F.col("seed") == 89) & (F.col("probability") > 0.95)
    return differing_identities(study.stored_traces().where(~lost), GRID.models)


@query(
    "st2_unequal_windows",
    sql(
        """SELECT horizon_hours, seed, window_id, true_label, array_to_string(list_sort(list(DISTINCT model)), '|') AS models
           FROM traces WHERE NOT (model = 'tcn' AND probability > 0.95) GROUP BY 1, 2, 3, 4
           HAVING count(DISTINCT model) <> 3"""
    ),
)
def st2_rows(study):
    kept = study.stored_traces().where(~((F.col("model") == "tcn") & (F.col("probability") > 0.95)))
    return unequal_windows(kept, GRID.models).withColumn("models", F.array_join("models", "|"))


@query(
    "st3_set_difference",
    sql("SELECT DISTINCT window_id FROM predictive WHERE window_id NOT IN (SELECT window_id FROM traces)"),
)
def st3(study):
    """Predictive windows that no trace covers."""
    study = study.with_stored_windows()
    return missing_pairs(study.predictive(), study.traces(), ["window_id"])


@query(
    "ev1_missing_cells",
    sql(
        f"""SELECT 'missing_cell' AS "check", model || '/h' || horizon_hours || '/seed' || seed AS key,
              'Missing predictions' AS message FROM (
            SELECT model, horizon_hours, seed FROM grid EXCEPT
            SELECT model, horizon_hours, seed FROM traces WHERE NOT ({LOST_COLUMN}))""",
        GRID_CTE,
    ),
)
def ev1(study):
    kept = study.stored_traces().where(f"NOT ({LOST_COLUMN})")
    return evidence_errors(experiment_cells(study.spark, GRID), kept, GRID).where("check = 'missing_cell'")


@query(
    "ev2_trace_errors",
    sql(
        """SELECT * FROM (
             SELECT 'probability' AS "check", model || '/h' || horizon_hours || '/seed' || seed AS key,
               'Invalid probabilities' AS message
             FROM kept WHERE probability > 1 GROUP BY model, horizon_hours, seed
             UNION ALL
             SELECT DISTINCT 'window_set', 'h' || horizon_hours || '/seed' || seed, 'Window/label mismatch' FROM (
               SELECT horizon_hours, seed FROM kept GROUP BY horizon_hours, seed, window_id, true_label
               HAVING count(DISTINCT model) <> 3))""",
        """kept AS (
             SELECT * REPLACE (CASE WHEN model = 'xgboost' AND seed = 42 THEN probability * 1.5 ELSE probability END AS probability)
             FROM traces WHERE fold IS NULL AND NOT (model = 'tcn' AND horizon_hours = 6 AND probability > 0.95))""",
    ),
)
def ev2(study):
    """A study with scores above one in one place and lost windows in another."""
    rows = holdout(study.stored_traces())
    lost = (F.col("model") == "tcn") & (F.col("horizon_hours") == 6) & (F.col("probability") > 0.95)
    raised = (F.col("model") == "xgboost") & (F.col("seed") == 42)
    kept = rows.where(~lost).withColumn(
        "probability", F.when(raised, F.col("probability") * 1.5).otherwise(F.col("probability"))
    )
    return evidence_errors(experiment_cells(study.spark, GRID), kept, GRID)


@query(
    "ev3_single_version",
    sql(
        "SELECT count(DISTINCT run_id) AS run_id_versions FROM (SELECT model, horizon_hours, seed,"
        " CASE WHEN count(*) FILTER (true_label = 1) > 10 THEN 'b' ELSE 'a' END AS run_id FROM traces"
        " WHERE fold IS NULL GROUP BY 1, 2, 3)"
    ),
)
def ev3(study):
    """Cells marked with a version derived from their rows; more than one version is a fault."""
    positives = F.count_if(F.col("true_label") == 1)
    cells = holdout(study.stored_traces()).groupBy(*CELL).agg(
        F.when(positives > 10, "b").otherwise("a").alias("run_id")
    )
    return version_counts(cells, ["run_id"])


@query(
    "ev4_evidence_report",
    sql(
        f"""SELECT false AS valid, (SELECT count(*) FROM (SELECT DISTINCT model, horizon_hours, seed FROM kept)) AS complete_cells,
              36::BIGINT AS expected_cells, (SELECT 2 * count(*) FROM (SELECT DISTINCT model, horizon_hours, seed FROM kept)) AS metric_rows,
              (SELECT count(*) FROM (SELECT model, horizon_hours, seed FROM grid EXCEPT SELECT model, horizon_hours, seed FROM kept))
              + (SELECT count(*) FROM (SELECT DISTINCT horizon_hours, seed FROM kept GROUP BY horizon_hours, seed, window_id,
                  true_label HAVING count(DISTINCT model) <> 3)) AS errors""",
        f"kept AS (SELECT * FROM traces WHERE fold IS NULL AND NOT ({LOST_COLUMN})),\n{GRID_CTE}",
    ),
)
def ev4(study):
    traces = study.stored_traces()
    kept = holdout(traces).where(f"NOT ({LOST_COLUMN})")
    rows = policy_metrics(apply_thresholds(kept, thresholds(traces), THRESHOLDS), THRESHOLDS, STEP)
    cells = experiment_cells(study.spark, GRID)
    report = evidence_report(cells, kept, rows, evidence_errors(cells, kept, GRID))
    return report.withColumn("errors", F.size("errors").cast("long"))


@query(
    "ev4_evidence_report_complete",
    sql(
        """SELECT true AS valid, 36::BIGINT AS complete_cells, 36::BIGINT AS expected_cells,
             (SELECT count(*) FROM policy_metrics) AS metric_rows, 0::BIGINT AS errors""",
        POLICY_CTES,
    ),
)
def ev4_complete(study):
    traces = study.stored_traces()
    cells = experiment_cells(study.spark, GRID)
    chosen = thresholds(traces)
    rows = policy_metrics(apply_thresholds(holdout(traces), chosen, THRESHOLDS), THRESHOLDS, STEP)
    errors = evidence_errors(cells, holdout(traces), GRID, thresholds=chosen)
    return evidence_report(cells, holdout(traces), rows, errors).withColumn("errors", F.size("errors").cast("long"))


@query(
    "th3_threshold_records",
    rounded(
        sql(
            """SELECT model, horizon_hours, '17|42|89' AS seeds, 0.5::DOUBLE AS reference_threshold, threshold AS operational_threshold,
                 development_f_beta AS development_f2, development_false_alert_episodes FROM selected""",
            SWEEP_CTES,
        ),
        "reference_threshold", "operational_threshold", "development_f2",
    ),
)
def th3_records(study):
    records = threshold_records(thresholds(study.stored_traces()), THRESHOLDS, GRID.seeds)
    return records.select(
        "model", "horizon_hours", F.array_join("seeds", "|").alias("seeds"), "reference_threshold",
        F.col("operational.threshold").alias("operational_threshold"),
        F.col("operational.development_f2").alias("development_f2"),
        F.col("operational.development_false_alert_episodes").alias("development_false_alert_episodes"),
    )
