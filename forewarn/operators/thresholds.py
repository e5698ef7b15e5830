"""Operational thresholds chosen from development predictions."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions.missing import ratio
from forewarn.functions.ordered import previous_in_order
from forewarn.functions.timeline import SECOND, floor_div, micros
from forewarn.operators.alerts import CHUNK_SECONDS
from forewarn.spec import ThresholdPolicy, require_columns


def candidate_thresholds(policy: ThresholdPolicy) -> list[float]:
    """Evenly spaced candidates from start to stop inclusive, as exact doubles."""
    count = math.ceil((policy.stop + policy.step / 2 - policy.start) / policy.step)
    width = (policy.start + policy.step) - policy.start
    return [policy.start + i * width for i in range(count)]


def _candidate_table(policy: ThresholdPolicy) -> tuple[Column, int]:
    values = candidate_thresholds(policy)
    return F.array(*[F.lit(v) for v in values]), len(values)


def candidates_reached(probability: Column, policy: ThresholdPolicy) -> Column:
    """How many candidates are less than or equal to a probability.

    The position is computed, then corrected by one against the exact candidate
    values, so the comparison is the same as testing each candidate.
    """
    table, count = _candidate_table(policy)
    guess = F.floor((probability - policy.start) / policy.step).cast("int") + 1
    guess = F.least(F.lit(count), F.greatest(F.lit(0), guess))
    up = F.coalesce(F.get(table, guess) <= probability, F.lit(False))
    down = F.coalesce(F.get(table, guess - 1) > probability, F.lit(False))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def sweep_thresholds(
    predictions: DataFrame,
    policy: ThresholdPolicy,
    step_seconds: int,
    keys: Sequence[str] = ("model", "horizon_hours"),
    seeds: Sequence[int] = (),
    folds: Sequence[str] = (),
    segment_cols: Sequence[str] = ("segment_id",),
    per_seed: bool = False,
) -> DataFrame:
    """Counts, F-beta and false alert runs of every candidate, in one pass over the rows.

    A row is predicted for the first ``b`` candidates. It opens an alert run for
    candidates from ``low`` up to ``b``, where ``low`` is how far the row before it
    reached (0 after a gap). Each row therefore adds two change points; summing
    them per candidate leaves at most one row per candidate and key.

    Rows of all seeds are pooled and ordered by (window start, seed, fold), so a
    run may pass from one seed's copy of a window to the next. ``per_seed``
    orders each seed on its own.
    """
    require_columns(
        predictions.columns, [*keys, *segment_cols, "seed", "fold", "window_start", "true_label", "probability"],
        "development predictions",
    )
    table, count = _candidate_table(policy)
    place = F.array_position(F.array(*[F.lit(int(s)) for s in seeds]), F.col("seed").cast("int")) if seeds else F.col("seed")
    fold_place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")) if folds else F.lit(0)
    placed = predictions.select(
        *keys,
        *segment_cols,
        "seed",
        place.alias("_seed_place"),
        fold_place.alias("_fold_place"),
        F.col("true_label").cast("int").alias("_label"),
        micros("window_start").alias("_t"),
        candidates_reached(F.col("probability"), policy).alias("_reach"),
    ).withColumn("_chunk", floor_div(F.col("_t"), CHUNK_SECONDS * SECOND))
    order_keys = [*keys, *segment_cols, *(["seed"] if per_seed else [])]
    linked = previous_in_order(
        placed, order_keys, ["_chunk"], ["_t", "_seed_place", "_fold_place"],
        {"_previous_reach": "_reach", "_previous_t": "_t"},
    )
    continues = F.col("_t") - F.col("_previous_t") <= step_seconds * SECOND
    low = F.when(continues, F.col("_previous_reach")).otherwise(0)
    opens = ((low < F.col("_reach")) & (F.col("_label") == 0)).cast("long")
    zero = F.lit(0).cast("long")
    negative = (1 - F.col("_label")).cast("long")
    points = linked.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col("_reach").alias("index"),
                    F.col("_label").cast("long").alias("positives"),
                    negative.alias("negatives"),
                    (-opens).alias("runs"),
                ),
                F.struct(low.alias("index"), zero.alias("positives"), zero.alias("negatives"), opens.alias("runs")),
            )
        ).alias("_point"),
    ).select(*keys, "_point.*")
    sums = points.groupBy(*keys, "index").agg(
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"), F.sum("runs").alias("runs")
    )
    grid = (
        sums.select(*keys)
        .distinct()
        .select(
            *keys,
            F.explode(F.sequence(F.lit(0), F.lit(count))).alias("index"),
            zero.alias("positives"),
            zero.alias("negatives"),
            zero.alias("runs"),
        )
    )
    complete = sums.unionByName(grid).groupBy(*keys, "index").agg(
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"), F.sum("runs").alias("runs")
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = complete.withColumns(
        {
            "fn": F.sum("positives").over(upto),
            "tn": F.sum("negatives").over(upto),
            "false_alert_episodes": F.sum("runs").over(upto),
            "_positives": F.sum("positives").over(whole),
            "_negatives": F.sum("negatives").over(whole),
        }
    ).where(F.col("index") < count)
    tp = F.col("_positives") - F.col("fn")
    fp = F.col("_negatives") - F.col("tn")
    beta = policy.beta**2
    f_beta = ratio((1 + beta) * tp, (1 + beta) * tp + beta * F.col("fn") + fp, F.lit(0.0))
    return counted.select(
        *keys,
        F.col("index").alias("candidate"),
        F.get(table, F.col("index")).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        "fn",
        "tn",
        f_beta.alias("f_beta"),
        "false_alert_episodes",
    )


def select_threshold(sweep: DataFrame, keys: Sequence[str] = ("model", "horizon_hours")) -> DataFrame:
    """The best candidate per key: highest F-beta, then fewest false runs, then highest threshold."""
    rank = F.struct("f_beta", -F.col("false_alert_episodes"), "threshold")
    best = sweep.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", "f_beta", "false_alert_episodes"), rank).alias("_best")
    )
    return best.select(
        *keys,
        F.round("_best.threshold", 10).alias("threshold"),
        F.col("_best.f_beta").alias("development_f_beta"),
        F.col("_best.false_alert_episodes").alias("development_false_alert_episodes"),
    )


def complete_groups(traces: DataFrame, seeds: Sequence[int], keys: Sequence[str] = ("model", "horizon_hours")) -> DataFrame:
    """Keys for which every seed has predictions."""
    wanted = traces.where(F.col("seed").isin(*seeds))
    return (
        wanted.groupBy(*keys, "seed").agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_seeds"))
        .where(F.col("_seeds") == len(seeds))
        .select(*keys)
    )


def apply_thresholds(
    holdout: DataFrame,
    thresholds: DataFrame,
    policy: ThresholdPolicy,
    keys: Sequence[str] = ("model", "horizon_hours"),
) -> DataFrame:
    """Hard predictions under the reference and the selected threshold.

    Every row needs exactly one threshold of its key; none or several end the job
    with an error (``threshold_problems`` lists them beforehand).
    """
    chosen = thresholds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_records"), F.max("threshold").alias("_threshold")
    )
    wrong = F.raise_error(
        F.concat(
            F.coalesce(F.col("_records"), F.lit(0)).cast("string"),
            F.lit(" thresholds instead of one for "),
            F.concat_ws("/", *[F.col(k).cast("string") for k in keys]),
        )
    ).cast("double")
    one = F.when((F.col("_records") == 1) & F.col("_threshold").isNotNull(), F.col("_threshold")).otherwise(wrong)
    return (
        holdout.join(chosen, list(keys), "left")
        .withColumn("operational_threshold", one)
        .drop("_records", "_threshold")
        .withColumn("reference_prediction", (F.col("probability") >= policy.reference).cast("int"))
        .withColumn(
            "operational_prediction", (F.col("probability") >= F.col("operational_threshold")).cast("int")
        )
    )


def threshold_problems(holdout: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("model", "horizon_hours")) -> DataFrame:
    """Keys of the holdout without exactly one threshold, with the number of records."""
    found = thresholds.where(F.col("threshold").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_records"))
    records = F.coalesce("_records", F.lit(0))
    return (
        holdout.select(*keys).distinct().join(found, list(keys), "left")
        .where(records != 1)
        .select(*keys, records.alias("records"))
    )


def threshold_records(thresholds: DataFrame, policy: ThresholdPolicy, seeds: Sequence[int]) -> DataFrame:
    """The nested record kept for each model and horizon."""
    return thresholds.select(
        "model",
        "horizon_hours",
        F.lit("pooled_development_fold_predictions_only").alias("selection_scope"),
        F.array(*[F.lit(int(s)) for s in seeds]).alias("seeds"),
        F.lit(policy.reference).alias("reference_threshold"),
        F.struct(
            F.col("threshold"),
            F.col("development_f_beta").alias("development_f2"),
            F.col("development_false_alert_episodes"),
        ).alias("operational"),
    )
