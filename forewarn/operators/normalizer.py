"""Missing-value and scaling parameters fitted on training windows only."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.functions.missing import is_missing
from forewarn.functions.quantiles import exact_percentiles
from forewarn.sources.sinks import row_number_of_text

_PARAMETERS = "struct<fallback: double, mean: double, scale: double>"


def unknown_windows(steps: DataFrame, training_ids: DataFrame) -> DataFrame:
    """Training ids that the sequences do not contain."""
    return training_ids.join(steps.select("window_id").distinct(), "window_id", "left_anti")


def repeated_windows(training_ids: DataFrame) -> DataFrame:
    """Training ids given more than once."""
    return training_ids.groupBy("window_id").count().where("count > 1")


def id_fingerprint(ids: DataFrame, column: str = "window_id") -> DataFrame:
    """Order-independent digest of a set of ids: count and sum of digests that another engine can recompute."""
    return ids.agg(
        F.count(F.lit(1)).alias("ids"),
        F.coalesce(F.sum(row_number_of_text(F.col(column).cast("string"))), F.lit(0)).cast("string").alias("fingerprint"),
    )


def to_long(steps: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per window, step and channel."""
    return steps.select(*[F.col(c).cast("double").alias(c) for c in channels]).unpivot(
        [], list(channels), "channel", "reading"
    )


def fit_channels(long: DataFrame, standardized: Sequence[str] | None) -> DataFrame:
    """Per channel: median of known readings, then mean and population deviation after filling.

    ``long`` has ``channel`` and ``reading``; channels are a parameter set, so the
    fallback table that is broadcast has one row per channel. With
    ``standardized=None`` every channel is scaled. A channel without any reading
    ends the job with an error; ``empty_channels`` lists them beforehand.
    """
    known = exact_percentiles(long, ["channel"], "reading", {"_median": 0.5}, keys_are_parameters=True)
    empty = F.raise_error(F.concat(F.lit("no reading to learn from in channel "), "channel")).cast("double")
    filled = F.coalesce("reading", "fallback")
    moments = (
        long.join(F.broadcast(known), "channel", "left")
        .withColumn("fallback", F.coalesce("_median", empty))
        .groupBy("channel", "fallback")
        .agg(F.avg(filled).alias("_mean"), F.stddev_pop(filled).alias("_spread"))
    )
    scaled = F.lit(True) if standardized is None else F.col("channel").isin(*standardized)
    usable = (F.col("_spread") > 0) & (F.col("_spread") < float("inf"))
    return moments.select(
        "channel",
        "fallback",
        F.when(scaled, F.col("_mean")).otherwise(0.0).alias("mean"),
        F.when(scaled & usable, F.col("_spread")).otherwise(1.0).alias("scale"),
        scaled.alias("standardized"),
    )


def empty_channels(long: DataFrame) -> DataFrame:
    """Channels of which no reading is known."""
    counts = long.groupBy("channel").agg(F.count_if(~is_missing("reading")).alias("_known"))
    return counts.where(F.col("_known") == 0).select("channel")


def fit_normalizer(
    steps: DataFrame, training_ids: DataFrame, channels: Sequence[str], standardized: Sequence[str]
) -> DataFrame:
    """One parameter row per channel, from the named training windows.

    A reading inside two overlapping windows counts twice. The number of
    training windows is carried on every row.
    """
    training = steps.join(training_ids.select("window_id"), "window_id", "left_semi")
    count = training_ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    return fit_channels(to_long(training, channels), standardized).withColumn("training_windows", count)


def check_training_ids(steps: DataFrame, training_ids: DataFrame) -> None:
    """Raise unless the ids are present, unique and known (runs three small jobs)."""
    if training_ids.isEmpty():
        raise ValueError("no training window is named")
    if not repeated_windows(training_ids).isEmpty():
        raise ValueError("a training window is named twice")
    if not unknown_windows(steps, training_ids).isEmpty():
        raise ValueError("a training window has no sequence")


def apply_normalizer(steps: DataFrame, parameters: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Fill missing readings with the fallback, then centre and scale.

    A channel without parameters is an error. The parameters arrive as one map value (an entry per channel), so the wide
    rows are neither reshaped nor joined.
    """
    lookup = parameters.agg(
        F.map_from_entries(F.collect_list(F.struct("channel", F.struct("fallback", "mean", "scale")))).alias("m")
    ).scalar()
    with_map = steps.withColumn("_parameters", lookup)
    changed = {}
    for name in channels:
        missing = F.raise_error(F.lit(f"no parameters for channel {name}")).cast(_PARAMETERS)
        known = F.coalesce(F.col("_parameters")[name], missing)
        changed[name] = (F.coalesce(F.col(name).cast("double"), known["fallback"]) - known["mean"]) / known["scale"]
    return with_map.withColumns(changed).drop("_parameters")
