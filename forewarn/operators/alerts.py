"""Alert runs: consecutive predicted windows, and which of them are false alarms."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.functions.ordered import previous_in_order, running_sums
from forewarn.functions.timeline import SECOND, floor_div, micros
from forewarn.spec import require_columns

# Windows of one segment are ordered inside slices of this width.
CHUNK_SECONDS = 7 * 86400
CELL = ("model", "horizon_hours", "seed")


def mark_run_starts(
    predictions: DataFrame,
    column: str,
    keys: Sequence[str] = CELL,
    step_seconds: int | None = None,
    segment_cols: Sequence[str] = ("segment_id",),
    tie_order: Sequence[str] = (),
) -> DataFrame:
    """Add ``starts_run``: predicted, and the previous window was not (or a step is missing)."""
    require_columns(
        predictions.columns, [*keys, *segment_cols, "window_start", "true_label", column], "predictions"
    )
    placed = predictions.withColumns(
        {"_t": micros("window_start"), "_predicted": F.col(column).cast("boolean")}
    ).withColumn("_chunk", floor_div(F.col("_t"), CHUNK_SECONDS * SECOND))
    linked = previous_in_order(
        placed,
        [*keys, *segment_cols],
        ["_chunk"],
        ["_t", *tie_order],
        {"_previous_predicted": "_predicted", "_previous_t": "_t"},
    )
    fresh = ~F.coalesce("_previous_predicted", F.lit(False))
    if step_seconds is not None:
        fresh = fresh | F.coalesce(F.col("_t") - F.col("_previous_t") > step_seconds * SECOND, F.lit(False))
    return linked.withColumn("starts_run", F.col("_predicted") & fresh).drop(
        "_previous_predicted", "_previous_t"
    )


def false_alert_episodes(
    predictions: DataFrame,
    column: str,
    keys: Sequence[str] = CELL,
    step_seconds: int | None = None,
    segment_cols: Sequence[str] = ("segment_id",),
    tie_order: Sequence[str] = (),
) -> DataFrame:
    """Per key, the number of alert runs whose first window is negative."""
    marked = mark_run_starts(predictions, column, keys, step_seconds, segment_cols, tie_order)
    return marked.groupBy(*keys).agg(
        F.count_if(F.col("starts_run") & (F.col("true_label") == 0)).alias("false_alert_episodes")
    )


def alert_runs(
    predictions: DataFrame,
    column: str,
    keys: Sequence[str] = CELL,
    step_seconds: int | None = None,
    segment_cols: Sequence[str] = ("segment_id",),
) -> DataFrame:
    """One row per alert run: start, end, number of windows and the first label."""
    marked = mark_run_starts(predictions, column, keys, step_seconds, segment_cols).withColumn(
        "_opens", F.col("starts_run").cast("long")
    )
    numbered = running_sums(marked, [*keys, *segment_cols], ["_chunk"], ["_t"], {"run": "_opens"})
    return (
        numbered.where("_predicted")
        .groupBy(*keys, *segment_cols, "run")
        .agg(
            F.min("window_start").alias("run_start"),
            F.max("window_end").alias("run_end"),
            F.count(F.lit(1)).alias("windows"),
            F.min_by("true_label", "_t").alias("first_label"),
        )
        .withColumn("is_false_alert", F.col("first_label") == 0)
    )
