"""Do the same sensors move the same way before each failure?"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions.quantiles import exact_percentiles
from forewarn.functions.timeline import hours_between, naive
from forewarn.spec import require_columns

NORMAL = "normal"
EXCLUDED = "near_failure_excluded"


def regime(
    onsets: Sequence[tuple[str, str]], lead_hours: float = 24, exclusion_hours: float = 48, strict: bool = False
) -> Column:
    """Name of the onset a window leads up to, ``normal``, or excluded as too close.

    By default closeness is judged on the smallest signed distance over all
    onsets, so it only acts before the first of them. ``strict`` excludes the
    approach to every onset.
    """
    distances = {name: hours_between(F.col("window_end"), naive(when)) for name, when in onsets}
    label = F.lit(NORMAL)
    for name, distance in distances.items():
        label = F.when(distance.between(0, lead_hours), F.lit(name)).otherwise(label)
    every = list(distances.values())
    if strict:
        close = F.lit(False)
        for distance in every:
            close = close | distance.between(0, exclusion_hours)
    else:
        close = (F.least(*every) if len(every) > 1 else every[0]).between(0, exclusion_hours)
    return F.when((label == NORMAL) & close, EXCLUDED).otherwise(label)


def regime_membership(labelled: DataFrame, onsets, **options) -> DataFrame:
    """Windows outside active failures with their ``regime``."""
    require_columns(labelled.columns, ["window_end", "in_failure"], "labelled windows")
    return labelled.where(~F.col("in_failure")).withColumn("regime", regime(onsets, **options))


def regime_effects(members: DataFrame, features: Sequence[str], onsets: Sequence[tuple[str, str]]) -> DataFrame:
    """Per feature and onset: shift of the median from normal, in normal interquartile ranges."""
    events = [name for name, _ in onsets]
    long = (
        members.where(F.col("regime").isin(NORMAL, *events))
        .select("regime", *[F.col(f).cast("double").alias(f) for f in features])
        .unpivot(["regime"], list(features), "feature", "reading")
        .where(F.col("reading").isNotNull())
    )
    # Keys are features x regimes, both fixed by parameters.
    stats = exact_percentiles(
        long, ["feature", "regime"], "reading", {"low": 0.25, "middle": 0.5, "high": 0.75}, count="windows"
    )
    per_regime = {
        name: F.max(
            F.when(
                F.col("regime") == name,
                F.struct("middle", (F.col("high") - F.col("low")).alias("iqr"), "windows"),
            )
        )
        for name in (NORMAL, *events)
    }
    wide = stats.groupBy("feature").agg(*[column.alias(f"_{name}") for name, column in per_regime.items()])
    normal = F.col(f"_{NORMAL}")
    found = wide.select(
        "feature",
        normal["middle"].alias("normal_median"),
        normal["iqr"].alias("normal_iqr"),
        F.explode(
            F.array(*[F.struct(F.lit(name).alias("event"), F.col(f"_{name}").alias("stats")) for name in events])
        ).alias("_item"),
    ).where(F.col("_item.stats").isNotNull())
    scale = F.when(F.col("normal_iqr") > 0, F.col("normal_iqr")).otherwise(1.0)
    middle = F.col("_item.stats.middle")
    return found.select(
        F.col("_item.event").alias("event"),
        "feature",
        "normal_median",
        "normal_iqr",
        middle.alias("event_median"),
        ((middle - F.col("normal_median")) / scale).alias("robust_standardized_difference"),
        F.col("_item.stats.windows").alias("event_windows"),
    )


def pivot_effects(effects: DataFrame, events: Sequence[str]) -> DataFrame:
    """Features down, events across; an event without windows stays null."""
    return (
        effects.groupBy("feature")
        .pivot("event", list(events))
        .agg(F.first("robust_standardized_difference"))
    )


def regime_summary(effects: DataFrame, events: Sequence[str]) -> DataFrame:
    """Pivoted effects with how consistently their signs agree."""
    signs = F.lit(0.0)
    for name in events:
        signs = signs + F.signum(F.col(name))
    consistency = F.abs(signs) / len(events)
    return pivot_effects(effects, events).withColumn("direction_consistency", consistency).withColumn(
        "all_events_same_direction", F.coalesce(F.col("direction_consistency") == 1.0, F.lit(False))
    )


def least_consistent(summary: DataFrame, count: int = 12) -> DataFrame:
    """The features whose shifts agree least; ties by name."""
    return summary.orderBy("direction_consistency", "feature").limit(count)


def effects_of(effects: DataFrame, features: DataFrame) -> DataFrame:
    """Effects of the listed features only."""
    return effects.join(features.select("feature"), "feature", "left_semi")
