"""Ranking, decision and alert metrics, for any number of grid cells in one plan."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.functions.missing import ratio
from forewarn.functions.ordered import running_sums
from forewarn.functions.quantiles import exact_percentiles, magnitude_bucket
from forewarn.functions.timeline import SECOND, micros
from forewarn.operators.alerts import CELL, false_alert_episodes
from forewarn.spec import ThresholdPolicy, require_columns


def ranking_scores(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average precision and ROC-AUC per key; both null when a class is absent.

    Equal scores form one step. Rows collapse to distinct scores before anything
    is ordered, and the ordered sums run over score buckets in two levels, so one
    key may hold any number of scores.
    """
    label = F.col("true_label")
    scores = (
        predictions.groupBy(*keys, "probability")
        .agg(F.count_if(label == 1).alias("_pos"), F.count_if(label == 0).alias("_neg"))
        .withColumn("_bucket", magnitude_bucket(F.col("probability")))
    )
    above = running_sums(
        scores, keys, ["_bucket"], ["probability"], {"_cum_pos": "_pos", "_cum_neg": "_neg"}, descending=True
    )
    # Products of counts outgrow a long.
    pos, neg, cum_pos, cum_neg = (F.col(c).cast("double") for c in ("_pos", "_neg", "_cum_pos", "_cum_neg"))
    sums = above.groupBy(*keys).agg(
        F.sum(pos * cum_pos / (cum_pos + cum_neg)).alias("_precision_sum"),
        F.sum(neg * (cum_pos - pos / 2)).alias("_pairs"),
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(
        *keys,
        F.when(both, F.col("_precision_sum") / F.col("_p")).alias("average_precision"),
        F.when(both, F.col("_pairs") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
    )


def prevalence(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows, positives and the share of positives."""
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.col("true_label").cast("long")).alias("positive_windows"),
        F.avg(F.col("true_label").cast("double")).alias("prevalence"),
    )


def score_medians(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median score of each class and their gap."""
    medians = exact_percentiles(predictions, [*keys, "true_label"], "probability", {"_median": 0.5})
    pivoted = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("true_label") == 1, F.col("_median"))).alias("positive_score_median"),
        F.max(F.when(F.col("true_label") == 0, F.col("_median"))).alias("negative_score_median"),
    )
    return pivoted.withColumn(
        "median_score_gap", F.col("positive_score_median") - F.col("negative_score_median")
    )


def ranking_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold-free metrics per key: counts, prevalence, AP, lift, AUC and score medians."""
    require_columns(predictions.columns, [*keys, "true_label", "probability"], "prediction trace")
    keys = list(keys)
    lift = ratio(F.col("average_precision"), F.col("prevalence"))
    return (
        prevalence(predictions, keys)
        .join(ranking_scores(predictions, keys), keys)
        .join(score_medians(predictions, keys), keys)
        .select(
            *keys,
            "windows",
            "positive_windows",
            "prevalence",
            "average_precision",
            lift.alias("ap_lift_over_prevalence"),
            "roc_auc",
            "positive_score_median",
            "negative_score_median",
            "median_score_gap",
        )
    )


def ranking_problems(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows cannot be ranked, with the first broken rule."""
    label, score = F.col("true_label"), F.col("probability")
    bad_score = score.isNull() | F.isnan(score) | ~score.between(0, 1)
    found = predictions.groupBy(*keys).agg(
        F.count_if(~F.coalesce(label.isin(0, 1), F.lit(False))).alias("_labels"),
        F.count_if(bad_score).alias("_scores"),
        F.count_if(label == 1).alias("_pos"),
        F.count_if(label == 0).alias("_neg"),
    )
    problem = (
        F.when(F.col("_labels") > 0, "a label is neither 0 nor 1")
        .when(F.col("_scores") > 0, "a score is no number from 0 to 1")
        .when((F.col("_pos") == 0) | (F.col("_neg") == 0), "one of the classes is missing")
    )
    return found.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def eventwise_metrics(traces: DataFrame, holdout_event: str) -> DataFrame:
    """Ranking metrics per model, horizon, seed and event; rows without a fold are the holdout."""
    events = traces.withColumn("event", F.coalesce("fold", F.lit(holdout_event)))
    return ranking_metrics(events, ["model", "horizon_hours", "seed", "event"])


def in_event_order(df: DataFrame, events: Sequence[str], *then: str) -> DataFrame:
    """Sort by the position of ``event`` in the given order, then by other columns."""
    return df.orderBy(F.array_position(F.array(*[F.lit(e) for e in events]), F.col("event")), *then)


def seed_summary(eventwise: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds, per event, horizon and model."""
    require_columns(
        eventwise.columns,
        ["model", "horizon_hours", "seed", "event", "prevalence", "average_precision",
         "ap_lift_over_prevalence", "roc_auc", "median_score_gap"],
        "event metrics",
    )
    return eventwise.groupBy("event", "horizon_hours", "model").agg(
        F.size(F.collect_set("seed")).alias("seeds"),
        F.avg("prevalence").alias("prevalence"),
        F.avg("average_precision").alias("average_precision_mean"),
        F.stddev_samp("average_precision").alias("average_precision_std"),
        F.avg("ap_lift_over_prevalence").alias("ap_lift_mean"),
        F.stddev_samp("ap_lift_over_prevalence").alias("ap_lift_std"),
        F.avg("roc_auc").alias("roc_auc_mean"),
        F.stddev_samp("roc_auc").alias("roc_auc_std"),
        F.avg("median_score_gap").alias("median_score_gap_mean"),
    )


def confusion_counts(predictions: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """tn, fp, fn and tp per key."""
    label, predicted = F.col("true_label") == 1, F.col(column) == 1
    return predictions.groupBy(*keys).agg(
        F.count_if(~predicted & ~label).alias("tn"),
        F.count_if(predicted & ~label).alias("fp"),
        F.count_if(~predicted & label).alias("fn"),
        F.count_if(predicted & label).alias("tp"),
    )


def decision_scores():
    """Precision, recall, F1 and balanced accuracy from the four counts.

    A zero denominator gives 0, except that balanced accuracy averages only the
    classes that occur.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)
    hit, miss = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "balanced_accuracy": F.coalesce((hit + miss) / 2, hit, miss),
        "precision": ratio(tp, tp + fp, zero),
        "recall": ratio(tp, tp + fn, zero),
        "f1": ratio(2.0 * tp, 2 * tp + fp + fn, zero),
    }


def evaluated_days(
    predictions: DataFrame, step_seconds: int, keys: Sequence[str] = CELL, segment_cols: Sequence[str] = ("segment_id",)
) -> DataFrame:
    """Days covered by the windows: per segment, first to last start plus one step."""
    step = step_seconds * SECOND
    spans = predictions.groupBy(*keys, *segment_cols).agg(
        F.greatest(
            F.max(micros("window_start")) - F.min(micros("window_start")) + step, F.lit(step).cast("long")
        ).alias("_span")
    )
    return spans.groupBy(*keys).agg((F.sum("_span") / F.lit(86400.0 * SECOND)).alias("evaluated_days"))


def by_policy(predictions: DataFrame, policy: ThresholdPolicy) -> DataFrame:
    """Two copies of each prediction: under the reference and under the selected threshold."""
    return predictions.withColumn(
        "_policy",
        F.explode(
            F.array(
                F.struct(
                    F.lit("reference_0.5").alias("threshold_policy"),
                    F.lit(policy.reference).alias("threshold"),
                    F.col("reference_prediction").alias("prediction"),
                ),
                F.struct(
                    F.lit("development_selected").alias("threshold_policy"),
                    F.col("operational_threshold").alias("threshold"),
                    F.col("operational_prediction").alias("prediction"),
                ),
            )
        ),
    ).select(*predictions.columns, "_policy.*")


def policy_metrics(
    predictions: DataFrame,
    policy: ThresholdPolicy,
    step_seconds: int,
    keys: Sequence[str] = CELL,
    segment_cols: Sequence[str] = ("segment_id",),
) -> DataFrame:
    """One metric row per cell and threshold policy.

    The row-level work is four grouped reductions; what is joined afterwards has
    one row per cell (or cell and policy).
    """
    keys = list(keys)
    label, score = F.col("true_label"), F.col("probability")
    policies = by_policy(predictions, policy)
    policy_keys = [*keys, "threshold_policy", "threshold"]
    alerted = (F.col("prediction") == 1) & (label == 1)
    predicted = F.col("prediction") == 1
    decisions = policies.groupBy(*policy_keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(label.cast("long")).alias("positive_windows"),
        F.avg(label.cast("double")).alias("prevalence"),
        F.avg(F.pow(score - label, F.lit(2))).alias("brier_score"),
        F.count_if(~predicted & (label == 0)).alias("tn"),
        F.count_if(predicted & (label == 0)).alias("fp"),
        F.count_if(~predicted & (label == 1)).alias("fn"),
        F.count_if(alerted).alias("tp"),
        F.max(F.when(alerted, F.col("hours_to_next_failure"))).alias("first_alert_lead_hours"),
    )
    episodes = false_alert_episodes(policies, "prediction", policy_keys, step_seconds, segment_cols)
    per_day = ratio(F.col("false_alert_episodes"), F.col("evaluated_days"))
    return (
        decisions.join(episodes, policy_keys)
        .join(evaluated_days(predictions, step_seconds, keys, segment_cols), keys)
        .join(ranking_scores(predictions, keys), keys)
        .withColumns(decision_scores())
        .withColumns(
            {
                "ap_lift_over_prevalence": ratio(F.col("average_precision"), F.col("prevalence")),
                "false_alert_episodes_per_day": per_day,
                "held_out_event_detected": F.col("tp") > 0,
            }
        )
        .select(
            *policy_keys, "windows", "positive_windows", "prevalence", "average_precision",
            "ap_lift_over_prevalence", "roc_auc", "brier_score", "balanced_accuracy", "precision",
            "recall", "f1", "tn", "fp", "fn", "tp", "false_alert_episodes", "evaluated_days",
            "false_alert_episodes_per_day", "held_out_event_detected", "first_alert_lead_hours",
        )
    )
