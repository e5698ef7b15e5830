"""Chronological splits and development folds, purged of overlapping readings."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.functions.timeline import naive
from forewarn.spec import require_columns


def purge_overlap(train: DataFrame, test: DataFrame, asset_cols: Sequence[str] = ()) -> DataFrame:
    """Keep training windows that end by the time the earliest test window starts.

    Without ``asset_cols`` one time applies to all; with them, each asset has its own.
    """
    for frame in (train, test):
        require_columns(frame.columns, ["window_start", "window_end", *asset_cols], "split")
    if not asset_cols:
        earliest = test.agg(F.min("window_start").alias("_earliest")).scalar()
        return train.where(F.col("window_end") <= earliest)
    starts = test.groupBy(*asset_cols).agg(F.min("window_start").alias("_earliest"))
    return (
        train.join(starts, list(asset_cols), "left")
        .where(F.col("_earliest").isNull() | (F.col("window_end") <= F.col("_earliest")))
        .drop("_earliest")
    )


def chronological_split(windows: DataFrame, boundary: str) -> DataFrame:
    """Add ``split``: ``train``, ``test`` or ``purged``.

    A window belongs to the test side when it ends at or after the boundary.
    Training windows that touch the readings of any test window are purged.
    """
    require_columns(windows.columns, ["window_start", "window_end"], "windows")
    cut = naive(boundary)
    is_test = F.col("window_end") >= cut
    earliest = windows.where(is_test).agg(F.min("window_start").alias("_earliest")).scalar()
    return windows.withColumn(
        "split",
        F.when(is_test, "test").when(F.col("window_end") <= earliest, "train").otherwise("purged"),
    )


def split_problem(split_counts: DataFrame, boundary: str) -> DataFrame:
    """Turn split sizes into the text of the first broken rule, null when usable.

    Needs columns ``windows``, ``before`` (ending before the boundary), ``test`` and ``train``.
    """
    # Texts that audit reports keep as data (fixed values).
    text = (
        F.when(F.col("windows") == 0, "No complete feature windows were produced")
        .when(F.col("windows") < 5, "Need at least 5 windows for evaluation")
        .when(
            (F.col("before") == 0) | (F.col("test") == 0),
            f"Fixed holdout boundary {boundary} must leave windows on both sides",
        )
        .when(F.col("train") == 0, "Overlap purge removed every training window")
    )
    return split_counts.withColumn("split_error", text)


def fold_problems(fold_rows: DataFrame, folds: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Configured folds without training or without validation windows: (fold, train, validation)."""
    names = fold_rows.sparkSession.createDataFrame([(name,) for name, _, _ in folds], "fold string")
    counts = fold_rows.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("_train"), F.count_if(F.col("role") == "validation").alias("_held")
    )
    train, held = F.coalesce("_train", F.lit(0)), F.coalesce("_held", F.lit(0))
    return (
        names.join(counts, "fold", "left")
        .select("fold", train.alias("train"), held.alias("validation"))
        .where((F.col("train") == 0) | (F.col("validation") == 0))
    )


def require_folds(fold_rows: DataFrame, folds: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The same rows, after a check that each fold has both sides."""
    empty = sorted(row["fold"] for row in fold_problems(fold_rows, folds).collect())
    if empty:
        raise ValueError(f"folds with an empty side: {', '.join(empty)}")
    return fold_rows


def development_folds(windows: DataFrame, folds: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per window and fold it takes part in, with ``fold`` and ``role``.

    Role ``validation`` covers ends in [start, stop) of the fold; ``train`` covers
    earlier windows that share no readings with the validation part. A fold without
    validation windows gives no rows; see ``fold_problems`` and ``require_folds``.
    """
    require_columns(windows.columns, ["window_start", "window_end"], "windows")
    table = F.array(
        *[
            F.struct(F.lit(name).alias("fold"), naive(start).alias("start"), naive(stop).alias("stop"))
            for name, start, stop in folds
        ]
    )
    end = F.col("window_end")
    provisional = (
        windows.withColumn("_fold", F.explode(table))
        .withColumn(
            "role",
            F.when(end < F.col("_fold.start"), "train").when(end < F.col("_fold.stop"), "validation"),
        )
        .where(F.col("role").isNotNull())
        .withColumn("fold", F.col("_fold.fold"))
        .drop("_fold")
    )
    earliest = (
        provisional.where(F.col("role") == "validation")
        .groupBy("fold")
        .agg(F.min("window_start").alias("_earliest"))
    )
    # One row per configured fold.
    return (
        provisional.join(F.broadcast(earliest), "fold", "left")
        .where((F.col("role") == "validation") | (end <= F.col("_earliest")))
        .drop("_earliest")
    )


def split_bounds(split: DataFrame, keys: Sequence[str], role: str, train: str, test: str) -> DataFrame:
    """Latest training end against earliest test start, and whether they are disjoint."""
    bounds = split.groupBy(*keys).agg(
        F.count_if(F.col(role) == train).alias("train_windows"),
        F.count_if(F.col(role) == test).alias("test_windows"),
        F.max(F.when(F.col(role) == train, F.col("window_end"))).alias("latest_train_window_end"),
        F.min(F.when(F.col(role) == test, F.col("window_start"))).alias("earliest_test_window_start"),
    )
    return bounds.withColumn(
        "timestamp_intervals_disjoint",
        F.col("latest_train_window_end") <= F.col("earliest_test_window_start"),
    )


def fold_class_counts(folds: DataFrame, keys: Sequence[str] = ("horizon_hours", "fold", "role")) -> DataFrame:
    """Windows, both class counts and whether a fold side can train or score a classifier."""
    label = F.col("failure_within_horizon")
    counts = folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(label == 1).alias("positives"),
        F.count_if(label == 0).alias("negatives"),
    )
    return counts.withColumn("is_binary", (F.col("positives") > 0) & (F.col("negatives") > 0))


def class_weights(train: DataFrame, keys: Sequence[str] = ("horizon_hours",)) -> DataFrame:
    """Weight of a positive row: negatives per positive of the training rows."""
    counts = fold_class_counts(train, keys)
    return counts.select(
        *keys,
        "positives",
        "negatives",
        F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")).alias("positive_weight"),
    )
