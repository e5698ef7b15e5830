"""Percentiles of any span of days from sketches that are written once for each day.

A KLL sketch holds a bounded sample of a sensor's readings of one day; sketches of days merge into that of a span, so a
question about a year reads a few kilobytes for each day and none of its readings. A new day adds files and touches no
old one. Answers are readings whose rank is off by at most ``rank_error(k)`` of all readings, with 99 % confidence;
``exact_percentiles`` answers without error, from the readings.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.functions.missing import is_missing

#: Size of a sketch; its rank error falls with it.
K = 800


def rank_error(k: int = K) -> float:
    """How far the rank of an answer may be off, as a share of all readings (99 % confidence; fixed law of the sketch)."""
    return 2.296 / k**0.9021


def daily_sketches(
    readings: DataFrame, sensors: Sequence[str], timestamp: str, keys: Sequence[str] = (), k: int = K
) -> DataFrame:
    """``day``, ``sensor``, ``n`` and ``sketch`` of each sensor's known readings, per key."""
    day = F.to_date(timestamp).alias("day")
    long = readings.select(*keys, day, *[F.col(s).cast("double").alias(s) for s in sensors]).unpivot(
        [*keys, "day"], list(sensors), "sensor", "reading"
    )
    known = long.where(~is_missing("reading") & F.col("day").isNotNull())
    return known.groupBy(*keys, "day", "sensor").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("reading", F.lit(k)).alias("sketch")
    )


def add_days(sketches: DataFrame, path: str) -> int:
    """Store the sketches of days that are not stored yet; returns how many days these are.

    A day is complete when it is stored: it never changes afterwards.
    """
    spark = sketches.sparkSession
    try:
        known = spark.read.parquet(path).select("day").distinct()
        sketches = sketches.join(known, "day", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    days = sketches.select("day").distinct().count()
    if days:
        sketches.repartition("day").write.mode("append").partitionBy("day").parquet(path)
    return days


def sketch_percentiles(
    stored: DataFrame,
    probabilities: Mapping[str, float],
    first_day: str | None = None,
    last_day: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per key and sensor the readings at some ranks over a span of days (both ends included), with their number ``n``."""
    if first_day is not None:
        stored = stored.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        stored = stored.where(F.col("day") <= F.lit(last_day).cast("date"))
    merged = stored.groupBy(*keys, "sensor").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_all"))
    ranks = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    found = merged.withColumn("_at", F.kll_sketch_get_quantile_double("_all", ranks))
    return found.select(*keys, "sensor", "n", *[F.get("_at", F.lit(i)).alias(name) for i, name in enumerate(probabilities)])


def measured_rank_errors(
    found: DataFrame, readings: DataFrame, sensors: Sequence[str], probabilities: Mapping[str, float]
) -> DataFrame:
    """How far the ranks of found percentiles really are off: ``sensor``, ``rank`` and ``error``, from all readings.

    A value that stands for many equal readings covers a span of ranks; the error is the distance from that span.
    """
    answers = found.select("sensor", *probabilities).unpivot("sensor", list(probabilities), "rank", "answer")
    long = readings.select(*[F.col(s).cast("double").alias(s) for s in sensors]).unpivot([], list(sensors), "sensor", "reading")
    # A few answers for each sensor, both parameter sets.
    counted = (
        long.where(~is_missing("reading"))
        .join(F.broadcast(answers), "sensor")
        .groupBy("sensor", "rank")
        .agg(
            (F.count_if(F.col("reading") < F.col("answer")) / F.count(F.lit(1))).alias("below"),
            (F.count_if(F.col("reading") <= F.col("answer")) / F.count(F.lit(1))).alias("upto"),
        )
    )
    wanted = F.create_map(*[F.lit(x) for item in probabilities.items() for x in item])[F.col("rank")]
    return counted.select(
        "sensor", "rank", F.greatest(F.lit(0.0), F.col("below") - wanted, wanted - F.col("upto")).alias("error")
    )
