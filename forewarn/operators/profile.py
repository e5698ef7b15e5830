"""Descriptions of raw telemetry: cadence, sensors, missing values, horizons."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.functions.ordered import previous_in_order
from forewarn.functions.quantiles import exact_percentiles
from forewarn.functions.timeline import SECOND, micros, naive
from forewarn.operators.labels import label_horizons
from forewarn.operators.splits import split_problem
from forewarn.sources.telemetry import BLOCK_ROWS

# Percentiles reported for gaps and for sensors.
GAP_PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p99_9": 0.999}
SENSOR_PERCENTILES = {"p0_1": 0.001, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p99_9": 0.999}
# Resampling steps (seconds) offered besides the observed cadence.
RESAMPLING_SECONDS = (5, 10, 30, 60)


def arrival_gaps(df: DataFrame, timestamp: str, order: Sequence[str]) -> DataFrame:
    """Gap in seconds to the row that arrived before, over raw rows in arrival order.

    ``order`` is one running number, or a block name and a number inside it.
    An unparsed neighbour gives no gap. Rows are ordered inside blocks of at most
    a million arrivals.
    """
    placed = df.withColumn("_t", micros(timestamp))
    if len(order) == 1:
        placed = placed.withColumn("_block", F.floor(F.col(order[0]) / BLOCK_ROWS))
        chunk, within = ["_block"], [order[0]]
    else:
        chunk, within = list(order[:-1]), [order[-1]]
    # The last arrival of a block may be unparsed, so its timestamp travels with its position.
    linked = previous_in_order(placed, [], chunk, within, {"_previous_t": "_t"})
    gap = (F.col("_t") - F.col("_previous_t")) / float(SECOND)
    return linked.select("_t", F.col(timestamp).alias("timestamp"), gap.alias("gap_seconds"))


def cadence_summary(df: DataFrame, timestamp: str, order: Sequence[str]) -> DataFrame:
    """One row: parsed and unparsed rows, repeats, backward steps, span and gap percentiles."""
    gaps = arrival_gaps(df, timestamp, order)
    facts = gaps.agg(
        F.count("timestamp").alias("parsed"),
        F.count_if(F.col("timestamp").isNull()).alias("unparseable"),
        F.count_if(F.col("gap_seconds") <= 0).alias("non_increasing_adjacent_pairs"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.max(F.when(F.col("gap_seconds") > 0, F.col("gap_seconds"))).alias("max"),
    )
    repeats = (
        df.where(F.col(timestamp).isNotNull())
        .groupBy(timestamp)
        .agg((F.count(F.lit(1)) - 1).alias("_extra"))
        .agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicate_timestamps"))
    )
    positive = gaps.where(F.col("gap_seconds") > 0)
    percentiles = exact_percentiles(positive, [], "gap_seconds", GAP_PERCENTILES)
    packed = percentiles.select(F.struct(*GAP_PERCENTILES).alias("_p")).scalar()
    return (
        facts.withColumn("duplicate_timestamps", repeats.scalar())
        .withColumn("_p", packed)
        .select(
            "parsed", "unparseable", "duplicate_timestamps", "non_increasing_adjacent_pairs", "start", "end",
            *[F.col(f"_p.{name}").alias(name) for name in GAP_PERCENTILES], "max",
        )
        .withColumn("median_seconds", F.col("p50"))
    )


def common_gaps(df: DataFrame, timestamp: str, order: Sequence[str], count: int = 10) -> DataFrame:
    """The most frequent positive gaps; ties by the smaller gap."""
    return (
        arrival_gaps(df, timestamp, order)
        .where(F.col("gap_seconds") > 0)
        .groupBy("gap_seconds")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "gap_seconds")
        .limit(count)
    )


def sensor_percentiles(df: DataFrame, sensors: Sequence[str], approximate: bool = False) -> DataFrame:
    """Tail percentiles per sensor over raw rows; sensors without readings are absent.

    ``approximate`` trades exactness for a single pass.
    """
    long = (
        df.select(*[F.col(s).cast("double").alias(s) for s in sensors])
        .unpivot([], list(sensors), "sensor", "reading")
        .where(F.col("reading").isNotNull() & ~F.isnan("reading"))
    )
    if not approximate:
        return exact_percentiles(long, ["sensor"], "reading", SENSOR_PERCENTILES)
    names = list(SENSOR_PERCENTILES)
    estimate = F.approx_percentile("reading", [SENSOR_PERCENTILES[n] for n in names], 10000)
    return long.groupBy("sensor").agg(estimate.alias("_p")).select(
        "sensor", *[F.col("_p")[i].alias(name) for i, name in enumerate(names)]
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells (null or NaN) per column, for columns that have any."""
    from pyspark.sql.types import DoubleType, FloatType

    def absent(field):
        null = F.col(field.name).isNull()
        return null | F.isnan(field.name) if isinstance(field.dataType, (DoubleType, FloatType)) else null

    fields = list(df.schema)
    counts = df.agg(*[F.count_if(absent(f)).alias(f.name) for f in fields])
    return counts.unpivot([], [f.name for f in fields], "column_name", "missing").where("missing > 0")


def resampling_candidates(cadence: DataFrame, window_seconds: int) -> DataFrame:
    """Whole-second steps not finer than the observed median, and the steps per window."""
    floor = F.greatest(F.lit(1).cast("long"), F.ceil("median_seconds"))
    options = F.array_sort(
        F.array_distinct(F.array(floor, *[F.lit(s).cast("long") for s in RESAMPLING_SECONDS]))
    )
    return (
        cadence.where(F.col("median_seconds").isNotNull())
        .select(floor.alias("_floor"), F.explode(options).alias("interval_seconds"))
        .where(F.col("interval_seconds") >= F.col("_floor"))
        .select(
            "interval_seconds",
            F.ceil(F.lit(window_seconds) / F.col("interval_seconds")).alias("timesteps_per_window"),
        )
    )


def horizon_audit(labelled: DataFrame, horizons: Sequence[int], boundary: str) -> DataFrame:
    """Per horizon: window counts, split sizes and why a split is unusable, if it is.

    Every horizon has a row even when there are no windows at all.
    """
    cut = naive(boundary)
    predictive = ~F.col("in_failure")
    is_test = predictive & (F.col("window_end") >= cut)
    earliest = labelled.where(is_test).agg(F.min("window_start").alias("_e")).scalar()
    before = predictive & (F.col("window_end") < cut)
    train = before & (F.col("window_end") <= earliest)
    positive = F.col("failure_within_horizon") == 1
    rows = label_horizons(labelled, horizons).withColumns(
        {"_predictive": predictive, "_before": before, "_train": train, "_test": is_test, "_positive": positive}
    )
    counted = rows.groupBy("horizon_hours").agg(
        F.count_if("_predictive").alias("predictive_windows"),
        F.count_if(F.col("_predictive") & F.col("_positive")).alias("positive_windows"),
        F.count_if(F.col("_predictive") & ~F.col("_positive")).alias("negative_windows"),
        F.count_if("in_failure").alias("quarantined_failure_windows"),
        F.count_if("_before").alias("before"),
        F.count_if("_train").alias("train"),
        F.count_if("_test").alias("test"),
        F.count_if(F.col("_train") & F.col("_positive")).alias("_train_positive"),
        F.count_if(F.col("_test") & F.col("_positive")).alias("_test_positive"),
        F.max(F.when(F.col("_train"), F.col("window_end"))).alias("_latest"),
        F.min(F.when(F.col("_test"), F.col("window_start"))).alias("_earliest"),
    )
    total = labelled.agg(F.count(F.lit(1)).alias("windows"))
    listed = total.select(
        F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon_hours"), F.col("windows").alias("_all")
    )
    counts = ["predictive_windows", "positive_windows", "negative_windows", "quarantined_failure_windows",
              "before", "train", "test"]
    complete = listed.join(counted, "horizon_hours", "left").fillna(0, counts)
    # With windows but none predictive, the split itself is what fails.
    judged = split_problem(
        complete.withColumn(
            "windows", F.when(F.col("_all") == 0, 0).otherwise(F.greatest("predictive_windows", F.lit(1)))
        ),
        boundary,
    )
    usable = F.col("split_error").isNull()
    return judged.select(
        "horizon_hours", "predictive_windows", "positive_windows", "negative_windows",
        "quarantined_failure_windows", "split_error",
        F.when(usable, F.col("train")).alias("train_windows"),
        F.when(usable, F.col("_train_positive")).alias("train_positive"),
        F.when(usable, F.col("test")).alias("test_windows"),
        F.when(usable, F.col("_test_positive")).alias("test_positive"),
        F.when(usable, F.col("_latest")).alias("latest_train_window_end"),
        F.when(usable, F.col("_earliest")).alias("earliest_test_window_start"),
        F.when(usable, F.col("_latest") <= F.col("_earliest")).alias("timestamp_intervals_disjoint"),
    )
