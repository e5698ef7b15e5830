"""Exact interpolated percentiles without one big sort per group.

The built-in ``percentile`` keeps every distinct value of a group in one
aggregation buffer. The form here never does.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions.ordered import running_sums

# Keeps every magnitude bucket positive: the smallest double is 2^-1074, at most
# 65536 buckets per octave.
_OFFSET = 1 << 27

# Ranges of value into which a bucket is cut before it is ordered.
SLICES = 1024


def magnitude_bucket(value: Column, per_octave: int = 4096) -> Column:
    """A coarse integer that never decreases as the double grows.

    It depends on the value alone, so no pass over the data is needed to place
    bucket borders and a re-run places every row in the same bucket.
    """
    size = F.abs(value)
    level = (
        F.when(size == float("inf"), F.lit(1 << 40))
        .otherwise(F.floor(F.log2(size) * F.lit(per_octave)).cast("long") + F.lit(_OFFSET))
    )
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(
        F.when(value > 0, level).otherwise(-level)
    )


def _rank(total: Column, probability: float) -> Column:
    return (total - 1) * F.lit(float(probability))


def _pick(probabilities: Mapping[str, float], value: str, start: Column, end: Column, total: Column):
    """Aggregates that fetch the two order statistics around each rank."""
    aggregates = []
    for name, probability in probabilities.items():
        low = F.floor(_rank(total, probability))
        high = F.ceil(_rank(total, probability))
        aggregates.append(F.max(F.when((start <= low) & (low < end), F.col(value))).alias(f"_low_{name}"))
        aggregates.append(F.max(F.when((start <= high) & (high < end), F.col(value))).alias(f"_high_{name}"))
    return aggregates


def _interpolate(df: DataFrame, keys, probabilities: Mapping[str, float], count: str | None) -> DataFrame:
    columns = []
    for name, probability in probabilities.items():
        rank = _rank(F.col("_count"), probability)
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        columns.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    if count is not None:
        columns.append(F.col("_count").alias(count))
    return df.select(*keys, *columns)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    count: str | None = None,
    keys_are_parameters: bool = False,
    per_octave: int = 4096,
) -> DataFrame:
    """Percentiles per key over any number of values.

    Pass one counts rows per magnitude bucket and finds the few buckets that
    contain a wanted rank. Where such a bucket holds one distinct value the rank
    is known already. Pass two looks only at rows of the remaining buckets and is
    skipped by Spark at run time when there are none.

    The table of buckets to refine holds at most ``2 * len(probabilities)`` rows
    per key. Spark picks the join by measured size; only where the keys are a
    parameter set (sensors, channels) may a caller pass ``keys_are_parameters`` to
    have the table broadcast. A bucket to refine is cut into ``SLICES`` equal
    ranges of value, which are ordered apart, so many readings in a narrow band
    don't meet in one task. ``per_octave`` trades rows in pass one against rows in
    pass two. NaN is a missing value. Keys must not be null.
    """
    keys = list(keys)
    placed = (
        df.select(*keys, F.col(value).cast("double").alias(value))
        .where(F.col(value).isNotNull() & ~F.isnan(value))
        .withColumn("_bucket", magnitude_bucket(F.col(value), per_octave))
    )
    per_bucket = placed.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_least"), F.max(value).alias("_most")
    )
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = per_bucket.withColumns(
        {"_stop": F.sum("_n").over(ordered), "_total": F.sum("_n").over(whole)}
    ).withColumn("_before", F.col("_stop") - F.col("_n"))
    holds_rank = F.lit(False)
    for probability in probabilities.values():
        for rank in (F.floor(_rank(F.col("_total"), probability)), F.ceil(_rank(F.col("_total"), probability))):
            holds_rank = holds_rank | ((F.col("_before") <= rank) & (rank < F.col("_stop")))
    ranked = ranked.where(holds_rank)
    settled = ranked.withColumn(value, F.when(F.col("_least") == F.col("_most"), F.col("_least"))).select(
        *keys, value, F.col("_before").alias("_start"), F.col("_stop").alias("_end"), "_total"
    )
    wanted = ranked.where(F.col("_least") < F.col("_most")).select(
        *keys, "_bucket", "_before", "_total", "_least", "_most"
    )

    survivors = (
        placed.join(F.broadcast(wanted) if keys_are_parameters else wanted, [*keys, "_bucket"])
        .groupBy(*keys, "_bucket", "_before", "_total", "_least", "_most", value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    share = (F.col(value) - F.col("_least")) / (F.col("_most") - F.col("_least"))
    sliced = survivors.withColumn("_slice", F.floor(share * SLICES).cast("int"))
    summed = running_sums(sliced, [*keys, "_bucket"], ["_slice"], [value], {"_upto": "_n"})
    refined = summed.withColumn("_end", F.col("_before") + F.col("_upto")).select(
        *keys, value, (F.col("_end") - F.col("_n")).alias("_start"), "_end", "_total"
    )
    picked = (
        settled.unionByName(refined)
        .groupBy(*keys)
        .agg(
            F.max("_total").alias("_count"),
            *_pick(probabilities, value, F.col("_start"), F.col("_end"), F.col("_total")),
        )
    )
    return _interpolate(picked, keys, probabilities, count)
