"""Fit classifiers on training windows and score others with MLlib.

A trainer is any callable ``(train, rounds) -> (model, rounds used)`` where ``train``
has ``features``, ``label``, ``weight`` and ``is_validation`` columns, ``rounds`` is
None for a fit that may stop early on the validation rows, and the model's
``transform`` adds ``probability``. Fitting is distributed by MLlib; the only loops
are over the configured folds and cells.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from statistics import median
from typing import Any, Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from forewarn.operators.boosting import BoostedModel, BoostParameters, Fit, fit_boosted, probabilities
from forewarn.operators.splits import class_weights
from forewarn.sources.sinks import stage_table

TRACE = ["window_id", "segment_id", "window_start", "window_end", "true_label", "probability", "hours_to_next_failure"]


@dataclass(frozen=True)
class TreeParameters:
    """Boosting settings (fixed values of the study's tree model)."""

    max_iterations: int = 500
    step_size: float = 0.05
    max_depth: int = 3
    min_child_rows: int = 3
    subsample: float = 0.8
    feature_share: str = "0.8"
    validation_tolerance: float = 0.01
    seed: int = 42


def assemble_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summary features of each window as one vector, missing values kept."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df)


def assemble_sequences(packed: DataFrame) -> DataFrame:
    """The normalised sequence of each window, flattened to one vector."""
    flat = F.transform(F.flatten("sequence"), lambda v: v.cast("double"))
    return packed.withColumn("features", array_to_vector(flat))


def with_class_weight(train: DataFrame) -> DataFrame:
    """Weight positives by negatives per positive; both classes are needed."""
    ratio = class_weights(train, []).first()["positive_weight"]
    if not ratio:
        raise ValueError("Training rows need both classes")
    label = F.col("failure_within_horizon").cast("double")
    return train.withColumns({"label": label, "weight": F.when(label == 1, F.lit(float(ratio))).otherwise(1.0)})


def _gbt(parameters: TreeParameters, iterations: int, validated: bool) -> GBTClassifier:
    model = GBTClassifier(
        maxIter=iterations,
        stepSize=parameters.step_size,
        maxDepth=parameters.max_depth,
        minInstancesPerNode=parameters.min_child_rows,
        subsamplingRate=parameters.subsample,
        featureSubsetStrategy=parameters.feature_share,
        weightCol="weight",
        seed=parameters.seed,
        validationTol=parameters.validation_tolerance,
    )
    return model.setValidationIndicatorCol("is_validation") if validated else model


def fit_trees(train: DataFrame, parameters: TreeParameters, iterations: int | None = None):
    """A fitted boosted-tree model; rows marked ``is_validation`` only decide when to stop."""
    validated = "is_validation" in train.columns
    return _gbt(parameters, iterations or parameters.max_iterations, validated).fit(train)


def score_with(model, score: DataFrame) -> DataFrame:
    """Attach the probability of the positive class."""
    scored = model.transform(score)
    drop = [c for c in ("rawPrediction", "prediction", "features") if c in scored.columns]
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop(*drop)


# (train, rounds or None) -> (model, rounds used)
Trainer = Callable[[DataFrame, "int | None"], tuple[Any, int]]


def tree_trainer(parameters: TreeParameters) -> Trainer:
    """Boosted trees; a fit without given rounds stops early on the validation rows."""

    def fit(train: DataFrame, rounds: int | None) -> tuple[Any, int]:
        if rounds is not None:
            train = train.drop("is_validation")
        model = fit_trees(train, parameters, rounds)
        return model, model.getNumTrees

    return fit


@dataclass(frozen=True)
class LogisticModel:
    """Coefficients of a fitted regression.

    MLlib's own model carries its training summary, and with it the session, into the tasks that score; a session that
    has observed a write once can't be sent there.
    """

    weights: np.ndarray
    bias: float

    @property
    def width(self) -> int:
        return len(self.weights)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(features @ self.weights + self.bias)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Attach ``probability`` as a vector of both classes' shares."""
        score = probabilities(df, [self])[0]
        return df.withColumn("probability", array_to_vector(F.array(1 - score, score)))


def logistic_trainer(parameters: dict | None = None) -> Trainer:
    """Weighted logistic regression, used on flattened sequences; validation rows are left out."""

    def fit(train: DataFrame, rounds: int | None) -> tuple[Any, int]:
        options = {"maxIter": 100, "regParam": 0.01} | (parameters or {})
        model = LogisticRegression(weightCol="weight", **options).fit(train.where(~F.col("is_validation")))
        own = LogisticModel(model.coefficients.toArray(), float(model.intercept))
        return own, model.summary.totalIterations

    return fit


def as_trace(scored: DataFrame, **constants) -> DataFrame:
    """Prediction columns in trace form, with cell constants such as model, seed and fold."""
    label = F.col("failure_within_horizon").cast("int").alias("true_label")
    columns = [label if name == "true_label" else F.col(name) for name in TRACE]
    return scored.select(
        *[F.lit(value).alias(name) for name, value in constants.items()], *columns
    )


@dataclass(frozen=True)
class CellResult:
    """Stored development and holdout predictions of a cell (``fold`` null for holdout), and what they took."""

    trace: DataFrame
    rounds: tuple[int, ...]
    development_fit_seconds: float
    final_fit_seconds: float
    prediction_seconds: float


def run_cell(trainer: Trainer, folds: DataFrame, split: DataFrame, **constants) -> CellResult:
    """One cell: a fit per fold that its validation rows may stop, then a final fit on all training rows.

    ``folds`` and ``split`` hold labelled rows with ``features``. The final fit uses the median of the rounds
    that the folds used. The holdout takes no part in any fit.
    """
    names = sorted(row["fold"] for row in folds.select("fold").distinct().collect())
    label = F.col("failure_within_horizon").cast("double")
    parts, rounds, started = [], [], time.perf_counter()
    for name in names:
        here = folds.where(F.col("fold") == name)
        validation = here.where(F.col("role") == "validation")
        weighted = with_class_weight(here.where(F.col("role") == "train")).withColumn("is_validation", F.lit(False))
        watched = validation.withColumns({"label": label, "weight": F.lit(1.0), "is_validation": F.lit(True)})
        model, used = trainer(weighted.unionByName(watched), None)
        rounds.append(used)
        parts.append(as_trace(score_with(model, validation), **constants, fold=name))
    developed = time.perf_counter()
    train = with_class_weight(split.where(F.col("split") == "train")).withColumn("is_validation", F.lit(False))
    final, _ = trainer(train, max(1, int(median(rounds))))
    fitted = time.perf_counter()
    scored = score_with(final, split.where(F.col("split") == "test"))
    parts.append(as_trace(scored, **constants).withColumn("fold", F.lit(None).cast("string")))
    trace = stage_table(reduce(DataFrame.unionByName, parts), "trace")
    return CellResult(trace, tuple(rounds), developed - started, fitted - developed, time.perf_counter() - fitted)


def run_cells(cells: Mapping[tuple, Callable[[], CellResult]], at_once: int = 4) -> dict[tuple, CellResult]:
    """Run cells, some at a time: each is a row of small jobs that leaves most of a cluster idle."""
    with ThreadPoolExecutor(at_once) as pool:
        running = {cell: pool.submit(inheritable_thread_target(run)) for cell, run in cells.items()}
        return {cell: future.result() for cell, future in running.items()}


_COSTS = (
    "model string, horizon_hours int, seed int, development_fit_seconds double, final_fit_seconds double, "
    "prediction_seconds double"
)


def cell_costs(spark: SparkSession, results: Mapping[tuple, CellResult]) -> DataFrame:
    """Measured seconds of each (model, horizon_hours, seed); one row per cell."""
    rows = [
        (*cell, r.development_fit_seconds, r.final_fit_seconds, r.prediction_seconds) for cell, r in results.items()
    ]
    return spark.createDataFrame(rows, _COSTS)


@dataclass(frozen=True)
class GridResult:
    """Stored predictions of all cells, each cell's seconds, its final model and the rounds that its folds used."""

    trace: DataFrame
    costs: DataFrame
    models: dict[tuple[int, int], BoostedModel]
    rounds: dict[tuple[int, int], tuple[int, ...]]


def run_boosted_cells(
    folds: DataFrame,
    split: DataFrame,
    horizons: Sequence[int],
    seeds: Sequence[int],
    parameters: BoostParameters = BoostParameters(),
    model: str = "boosted_trees",
) -> GridResult:
    """All (horizon, seed) cells of boosted trees, fitted together: a pass over the rows serves every cell.

    ``folds`` and ``split`` hold rows with ``features`` and ``hours_to_next_failure``. A fold's validation rows may
    stop its fits; a final fit takes the median of the rounds that its folds used, and the holdout takes no part in
    any. Cells share passes, so the seconds of a cell are its share of them.
    """
    cells = [(horizon, seed) for horizon in horizons for seed in seeds]
    names = sorted(row["fold"] for row in folds.select("fold").distinct().collect())
    hours = F.col("hours_to_next_failure")
    labels = F.array(*[F.coalesce(hours <= h, F.lit(False)).cast("double") for h in horizons]).alias("labels")

    def rows(df: DataFrame, part, validation) -> DataFrame:
        return df.select(part.alias("part"), "features", labels, F.xxhash64("window_id").alias("key"), validation.alias("is_validation"))

    started = time.perf_counter()
    wanted = [Fit(name, horizons.index(h), seed) for name in names for h, seed in cells]
    developed = fit_boosted(rows(folds, F.col("fold"), F.col("role") == "validation"), wanted, parameters)
    fitted = {(fit.part, horizons[fit.target], fit.seed): found for fit, found in zip(wanted, developed)}
    rounds = {cell: tuple(len(fitted[name, *cell].trees) for name in names) for cell in cells}
    development = time.perf_counter()
    train = rows(split.where(F.col("split") == "train"), F.lit("final"), F.lit(False))
    last = [Fit("final", horizons.index(h), seed, max(1, int(median(rounds[h, seed])))) for h, seed in cells]
    final = dict(zip(cells, fit_boosted(train, last, parameters)))
    finished = time.perf_counter()
    parts = [
        _grid_trace(folds.where((F.col("fold") == name) & (F.col("role") == "validation")), {c: fitted[name, *c] for c in cells}, name, model)
        for name in names
    ]
    parts.append(_grid_trace(split.where(F.col("split") == "test"), final, None, model))
    trace = stage_table(reduce(DataFrame.unionByName, parts), "trace")
    seconds = [development - started, finished - development, time.perf_counter() - finished]
    costs = folds.sparkSession.createDataFrame(
        [(model, *cell, *[s / len(cells) for s in seconds]) for cell in cells], _COSTS
    )
    return GridResult(trace, costs, final, rounds)


def _grid_trace(rows: DataFrame, models: Mapping[tuple[int, int], BoostedModel], fold: str | None, model: str) -> DataFrame:
    """Each row scored by every cell's model, in trace form."""
    cells = list(models)
    keys = F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.lit(s).alias("seed")) for h, s in cells])
    scored = rows.withColumn("_scores", F.arrays_zip(keys.alias("cell"), probabilities(rows, [models[c] for c in cells]).alias("score")))
    hours = F.col("hours_to_next_failure")
    return scored.withColumn("_score", F.explode("_scores")).select(
        F.lit(model).alias("model"),
        "_score.cell.horizon_hours",
        "_score.cell.seed",
        F.lit(fold).cast("string").alias("fold"),
        *[c for c in TRACE if c not in ("true_label", "probability", "hours_to_next_failure")],
        F.coalesce(hours <= F.col("_score.cell.horizon_hours"), F.lit(False)).cast("int").alias("true_label"),
        F.col("_score.score").alias("probability"),
        "hours_to_next_failure",
    )


def feature_importance(spark: SparkSession, model, columns: Sequence[str]) -> DataFrame:
    """Importance per feature of a fitted tree model, highest first, then by name.

    Boosted trees on histograms give the average gain of their splits, MLlib's their own measure. The list is as long
    as the feature set.
    """
    found = model.importances() if isinstance(model, BoostedModel) else model.featureImportances.toArray()
    weights = found.tolist()
    rows = [(name, float(w)) for name, w in zip(columns, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
