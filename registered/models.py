"""Fits of every horizon and seed, and thresholds and metrics of what they score.

Scores have no SQL counterpart; what is determined has, in queries of its own: which rows are scored under which cell
and fold, their labels, that every score is a probability, and how importances are ordered.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forewarn.operators.boosting import BoostParameters
from forewarn.operators.kernels import kernel_features
from forewarn.operators.labels import label_horizon
from forewarn.operators.metrics import policy_metrics
from forewarn.operators.normalizer import apply_normalizer, fit_normalizer
from forewarn.operators.reports import cost_against_ranking
from forewarn.operators.scoring import (
    GridResult,
    assemble_features,
    cell_costs,
    feature_importance,
    logistic_trainer,
    run_boosted_cells,
    run_cell,
    run_cells,
)
from forewarn.operators.sequences import pack_sequences, sequence_channels
from forewarn.operators.thresholds import apply_thresholds, select_threshold, sweep_thresholds
from forewarn.plans.events_study import CLEAN, GRID, SEQUENCE, THRESHOLDS
from forewarn.sources.sinks import stage_table
from registered.base import FEATURES, query, sql
from registered.evidence import PARTS, STEP, development, holdout

BOOSTED, KERNELS = "boosted_trees", "kernel_logistic"

# Fits of this session, so that the queries about one grid fit it once; results are written tables.
_DONE: dict[tuple, object] = {}


def _once(study, name: str, build: Callable):
    key = name, study.spark.sparkContext.applicationId, study.sf_dir
    if key not in _DONE:
        _DONE[key] = build(study)
    return _DONE[key]


def _boosted(study) -> GridResult:
    study = study.with_stored_windows()
    folds = stage_table(assemble_features(study.folds(), FEATURES), "folds")
    split = stage_table(assemble_features(study.split(), FEATURES), "split")
    return run_boosted_cells(folds, split, GRID.horizons, GRID.seeds, BoostParameters(), BOOSTED)


def _kernels(study) -> tuple[DataFrame, DataFrame]:
    """Trace and costs of the sequence classifier.

    Each fold, and the final fit, has a normaliser of its own training windows; each seed has its own kernels. Features
    meet their windows once; a fit reads the folder of its seed, part and use, without a join.
    """
    study = study.with_stored_windows()
    channels = sequence_channels(CLEAN)
    steps = stage_table(study.steps(), "sequences")
    folds, split = stage_table(study.folds(), "folds"), stage_table(study.split(), "split")
    parts = {name: folds.where(F.col("fold") == name) for name in PARTS}
    trained = {name: rows.where(F.col("role") == "train") for name, rows in parts.items()}
    parts["final"], trained["final"] = split, split.where(F.col("split") == "train")
    banks = []
    for name, rows in parts.items():
        fitted = fit_normalizer(steps, trained[name].select("window_id"), channels, tuple(CLEAN.analogue))
        own = steps.join(rows.select("window_id"), "window_id", "left_semi")
        packed = pack_sequences(apply_normalizer(own, fitted, channels), CLEAN, SEQUENCE)
        banks.append(kernel_features(packed, GRID.seeds).withColumn("part", F.lit(name)))
    traced = ["window_id", "segment_id", "window_start", "window_end", "hours_to_next_failure"]
    used = [
        folds.select(*traced, F.col("fold").alias("part"), F.col("role").alias("use")),
        split.where(F.col("split") != "purged").select(*traced, F.lit("final").alias("part"), F.col("split").alias("use")),
    ]
    vectors = reduce(DataFrame.unionByName, banks).join(reduce(DataFrame.unionByName, used), ["part", "window_id"])
    vectors = stage_table(vectors, "kernel-features", ("seed", "part", "use"))

    def cell(horizon, seed):
        own = label_horizon(vectors.where(F.col("seed") == seed).drop("seed"), horizon)
        of_folds = own.where(F.col("part").isin(*PARTS)).withColumnsRenamed({"part": "fold", "use": "role"})
        of_split = own.where(F.col("part") == "final").drop("part").withColumnRenamed("use", "split")
        return lambda: run_cell(logistic_trainer(), of_folds, of_split, model=KERNELS, horizon_hours=horizon, seed=seed)

    done = run_cells({(KERNELS, h, s): cell(h, s) for h in GRID.horizons for s in GRID.seeds})
    traces = reduce(DataFrame.unionByName, [result.trace for result in done.values()])
    return traces, cell_costs(study.spark, done)


def _boosted_trace(study) -> DataFrame:
    return _once(study, BOOSTED, _boosted).trace


def _kernel_trace(study) -> DataFrame:
    return _once(study, KERNELS, _kernels)[0]


def _both(study) -> DataFrame:
    return _boosted_trace(study).unionByName(_kernel_trace(study))


def _scored_sql(model: str) -> str:
    return sql(
        f"""SELECT '{model}' AS model, horizon_hours, seed, fold, window_id,
             CAST(coalesce(hours_to_next_failure <= horizon_hours, false) AS INTEGER) AS true_label,
             true AS is_probability
           FROM traced, horizons, seeds"""
    )


def _determined(trace: DataFrame) -> DataFrame:
    score = F.col("probability")
    valid = F.coalesce(score.between(0, 1) & ~F.isnan(score), F.lit(False)).alias("is_probability")
    return trace.select("model", "horizon_hours", "seed", "fold", "window_id", "true_label", valid)


@query("ml1_boosted_tree_cell")
def ml1(study):
    return _boosted_trace(study)


@query("ml1_scored_rows", _scored_sql(BOOSTED))
def ml1_rows(study):
    return _determined(_boosted_trace(study))


@query("ml2_sequence_classifier_cell")
def ml2(study):
    return _kernel_trace(study)


@query("ml2_scored_rows", _scored_sql(KERNELS))
def ml2_rows(study):
    return _determined(_kernel_trace(study))


def _importances(study) -> DataFrame:
    final = _once(study, BOOSTED, _boosted).models[GRID.horizons[0], GRID.seeds[0]]
    return feature_importance(study.spark, final, FEATURES)


@query("ml3_feature_importance")
def ml3(study):
    return _importances(study)


@query(
    "ml3_importance_checks",
    "SELECT * FROM (VALUES " + ", ".join(f"('{name}', true, true, true)" for name in FEATURES)
    + ") AS t(feature, is_share, in_order, is_whole)",
)
def ml3_checks(study):
    """Every feature once, shares that sum to one, in descending order as returned; no feature has all of them."""
    found = _importances(study).withColumn("place", F.monotonically_increasing_id())
    everything = Window.orderBy("place")  # a row for each feature
    before = F.lag("importance").over(everything)
    return found.select(
        "feature",
        F.col("importance").between(0, 0.999).alias("is_share"),
        (F.coalesce(before, F.lit(1.0)) >= F.col("importance")).alias("in_order"),
        (F.abs(F.sum("importance").over(Window.partitionBy()) - 1) < 1e-9).alias("is_whole"),
    )


def _thresholds(trace: DataFrame) -> DataFrame:
    return select_threshold(sweep_thresholds(development(trace), THRESHOLDS, STEP, seeds=GRID.seeds, folds=PARTS))


def _metrics(trace: DataFrame) -> DataFrame:
    chosen = stage_table(_thresholds(trace), "fitted-thresholds")
    return policy_metrics(stage_table(apply_thresholds(holdout(trace), chosen, THRESHOLDS), "decided"), THRESHOLDS, STEP)


@query("th3_fitted_thresholds")
def th3_fitted(study):
    """Thresholds chosen from the development scores of the fitted models."""
    return _thresholds(_both(study))


@query("ag13_fitted_metrics")
def ag13_fitted(study):
    """Holdout metrics of the fitted models under the reference and the chosen thresholds."""
    return _metrics(_both(study))


def _priced(study) -> DataFrame:
    costs = _once(study, BOOSTED, _boosted).costs.unionByName(_once(study, KERNELS, _kernels)[1])
    return cost_against_ranking(_metrics(_both(study)).join(costs, ["model", "horizon_hours", "seed"]))


@query("ag16_fitted_cost_against_ranking")
def ag16_fitted(study):
    """Measured fit seconds of both models next to their holdout lift."""
    return _priced(study)


@query(
    "ag16_fitted_cost_checks",
    f"SELECT * FROM (VALUES ('{BOOSTED}', true, true), ('{KERNELS}', true, true)) AS t(model, is_measured, is_sum)",
)
def ag16_checks(study):
    total = F.col("fit_seconds") + F.col("final_fit_seconds")
    return _priced(study).select(
        "model",
        ((F.col("fit_seconds") > 0) & (F.col("final_fit_seconds") > 0)).alias("is_measured"),
        (F.abs(F.col("total_fit_seconds") - total) < 1e-9).alias("is_sum"),
    )
