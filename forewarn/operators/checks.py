"""Checks over prediction traces and grids. Each returns rows that describe problems."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forewarn.functions.timeline import naive
from forewarn.spec import EvaluationGrid, require_columns

# Columns every prediction trace has.
TRACE_COLUMNS = (
    "model", "horizon_hours", "seed", "window_id", "segment_id", "window_start", "window_end",
    "true_label", "probability", "hours_to_next_failure",
)
CELL = ("model", "horizon_hours", "seed")


def _literal_column(values, kind: str):
    return F.posexplode(F.array(*[F.lit(v).cast(kind) for v in values]))


def experiment_cells(spark: SparkSession, grid: EvaluationGrid) -> DataFrame:
    """Every (model, horizon, seed) of the grid, numbered in report order."""
    one = spark.range(1)
    models = one.select(_literal_column(grid.models, "string").alias("_m", "model"))
    horizons = models.select("*", _literal_column(grid.horizons, "int").alias("_h", "horizon_hours"))
    cells = horizons.select("*", _literal_column(grid.seeds, "int").alias("_s", "seed"))
    place = (F.col("_m") * len(grid.horizons) + F.col("_h")) * len(grid.seeds) + F.col("_s")
    return cells.select("model", "horizon_hours", "seed", place.alias("position"))


def pending_cells(cells: DataFrame, done: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Cells of the grid without a finished counterpart."""
    return cells.join(done.select(*keys).distinct(), list(keys), "left_anti")


def trace_problems(traces: DataFrame, keys: Sequence[str] = CELL, development: bool = False) -> DataFrame:
    """Per cell: unusable probabilities and window identities that occur more than once."""
    require_columns(traces.columns, [*TRACE_COLUMNS, *(["fold"] if development else [])], "prediction trace")
    score = F.col("probability")
    bad = score.isNull() | F.isnan(score) | ~score.between(0, 1)
    identity = [*keys, "window_id", *(["fold"] if development else [])]
    per_window = traces.groupBy(*identity).agg(
        F.count(F.lit(1)).alias("_copies"), F.count_if(bad).alias("_bad")
    )
    return per_window.groupBy(*keys).agg(
        F.sum("_copies").alias("rows"),
        F.sum("_bad").alias("bad_probabilities"),
        F.count_if(F.col("_copies") > 1).alias("repeated_windows"),
    )


def unequal_windows(traces: DataFrame, models: Sequence[str]) -> DataFrame:
    """(window, label) pairs that were not scored by every model, per horizon and seed."""
    return (
        traces.groupBy("horizon_hours", "seed", "window_id", "true_label")
        .agg(F.sort_array(F.collect_set("model")).alias("models"))
        .where(F.size("models") != len(models))
    )


def identity_mismatches(traces: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per horizon and seed: how many pairs some model lacks."""
    return (
        traces.groupBy("horizon_hours", "seed", "window_id", "true_label")
        .agg(F.size(F.collect_set("model")).alias("_models"))
        .groupBy("horizon_hours", "seed")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_if(F.col("_models") != len(models)).alias("unequal_pairs"),
        )
    )


def pair_digests(traces: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Per cell: rows and two independent sums over hashes of its (window, label) pairs, whatever their order."""
    wide = "decimal(38,0)"
    return traces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64("window_id", "true_label").cast(wide)).alias("digest"),
        F.sum(F.xxhash64(F.lit(1), "true_label", "window_id").cast(wide)).alias("second_digest"),
    )


def differing_groups(traces: DataFrame, models: Sequence[str]) -> DataFrame:
    """(horizon_hours, seed) whose models did not score the same rows, by digests: one row a cell is all that moves."""
    same = F.count_distinct("rows", "digest", "second_digest") == 1
    complete = F.count_distinct("model") == len(models)
    grouped = pair_digests(traces).groupBy("horizon_hours", "seed").agg((same & complete).alias("_agree"))
    return grouped.where(~F.col("_agree")).select("horizon_hours", "seed")


def differing_identities(traces: DataFrame, models: Sequence[str]) -> DataFrame:
    """The rows of ``identity_mismatches`` with unequal pairs; windows are compared only where digests differ."""
    suspects = F.broadcast(differing_groups(traces, models))  # at most a row for each horizon and seed of the grid
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("horizon_hours", "seed")]
    kept = traces.alias("t").join(suspects.alias("s"), same, "left_semi")
    return identity_mismatches(kept, models).where("unequal_pairs > 0")


def missing_pairs(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` does not have."""
    return left.select(*columns).distinct().join(right.select(*columns), list(columns), "left_anti")


def version_counts(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many different versions the finished cells carry."""
    return cells.agg(*[F.count_distinct(c).alias(f"{c}_versions") for c in columns])


def evidence_errors(
    cells: DataFrame, traces: DataFrame, grid: EvaluationGrid, runs: DataFrame | None = None,
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """All problems of a finished study as (check, key, message) rows."""
    key = F.concat_ws("/", "model", F.concat(F.lit("h"), "horizon_hours"), F.concat(F.lit("seed"), "seed"))
    missing = pending_cells(cells, traces).select(
        F.lit("missing_cell").alias("check"), key.alias("key"), F.lit("Missing predictions").alias("message")
    )
    rows = trace_problems(traces)
    invalid = rows.where("bad_probabilities > 0").select(
        F.lit("probability").alias("check"), key.alias("key"), F.lit("Invalid probabilities").alias("message")
    )
    repeated = rows.where("repeated_windows > 0").select(
        F.lit("identity").alias("check"), key.alias("key"), F.lit("Repeated window identities").alias("message")
    )
    unequal = differing_identities(traces, grid.models).select(
        F.lit("window_set").alias("check"),
        F.concat(F.lit("h"), "horizon_hours", F.lit("/seed"), "seed").alias("key"),
        F.lit("Window/label mismatch").alias("message"),
    )
    problems = missing.unionByName(invalid).unionByName(repeated).unionByName(unequal)
    if runs is not None:
        mixed = version_counts(runs, ["run_id"]).where("run_id_versions <> 1").select(
            F.lit("version").alias("check"), F.lit("all").alias("key"),
            F.lit("Completed cells do not share one version").alias("message"),
        )
        problems = problems.unionByName(mixed)
    if thresholds is not None:
        groups = cells.select("model", "horizon_hours").distinct()
        absent = groups.join(thresholds, ["model", "horizon_hours"], "left_anti").select(
            F.lit("threshold").alias("check"),
            F.concat_ws("/", "model", F.concat(F.lit("h"), "horizon_hours")).alias("key"),
            F.lit("Missing finalized group").alias("message"),
        )
        problems = problems.unionByName(absent)
    return problems


def evidence_report(cells: DataFrame, traces: DataFrame, metrics: DataFrame, errors: DataFrame) -> DataFrame:
    """One row that says whether a study is whole and consistent.

    The error list has at most a few entries per grid cell.
    """
    finished = traces.select(*CELL).distinct().join(cells, list(CELL), "left_semi")
    listed = errors.agg(
        F.array_sort(F.collect_list(F.concat_ws(": ", "message", "key"))).alias("errors")
    )
    counts = {
        "complete_cells": finished.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "expected_cells": cells.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "metric_rows": metrics.agg(F.count(F.lit(1)).alias("n")).scalar(),
    }
    report = listed.withColumns(counts)
    whole = (F.size("errors") == 0) & (F.col("complete_cells") == F.col("expected_cells"))
    return report.select(whole.alias("valid"), "complete_cells", "expected_cells", "metric_rows", "errors")


def require_valid(report: DataFrame) -> None:
    """Raise with the collected messages unless the one-row report is valid."""
    row = report.first()
    if not row["valid"]:
        raise ValueError(f"evidence is not valid: {'; '.join(row['errors'])}")


def fold_problems(folds: DataFrame, holdout_start: str) -> DataFrame:
    """Folds that are empty, reach the holdout, or overlap the one before.

    ``folds`` has ``fold``, ``validation_start`` and ``validation_end``, one row per
    configured fold.
    """
    before = F.lag("validation_end").over(Window.orderBy("validation_start"))
    start, end = F.col("validation_start"), F.col("validation_end")
    problem = (
        F.when((start >= end) | (end >= naive(holdout_start)), "the fold is empty or reaches the holdout")
        .when(F.col("_before") > start, "the fold begins inside the one before")
    )
    return folds.withColumn("_before", before).select("fold", problem.alias("problem"))


def thresholds_per_group(thresholds: DataFrame, keys: Sequence[str] = ("model", "horizon_hours")) -> DataFrame:
    """Keys that do not have exactly one threshold."""
    return thresholds.groupBy(*keys).agg(F.count(F.lit(1)).alias("records")).where("records <> 1")


def domain_check(df: DataFrame, expected: dict[str, Sequence]) -> DataFrame:
    """Per column: expected values present and missing, and how many others occur.

    Values are counted where they lie; no column's values are gathered in one place.
    """
    columns = list(expected)
    values = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column_name", "found")
        .groupBy("column_name", "found")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    known = F.lit(False)
    size = F.lit(0)
    for column, wanted in expected.items():
        here = F.col("column_name") == column
        known = known | (here & F.col("found").isin(*[str(v) for v in wanted]))
        size = F.when(here, len(set(wanted))).otherwise(size)
    known = F.coalesce(known, F.lit(False))
    return (
        values.groupBy("column_name")
        .agg(F.count_if(known).alias("present"), F.count_if(~known).alias("unexpected"))
        .withColumn("missing", size - F.col("present"))
        .withColumn("matches", (F.col("missing") == 0) & (F.col("unexpected") == 0))
    )


def require_domain(df: DataFrame, expected: dict[str, Sequence]) -> DataFrame:
    """The same table; raises when a column does not hold exactly the expected values."""
    require_columns(df.columns, expected, "evidence table")
    right = {row["column_name"] for row in domain_check(df, expected).where("matches").collect()}
    wrong = set(expected) - right
    if wrong:
        raise ValueError(f"Unexpected values in: {', '.join(sorted(wrong))}")
    return df
