"""Shards of near-equal size by sampled splitters.

Records are ordered by a key. A sample of keys, drawn with chances in proportion to size, gives splitters at its
quantiles; records are dealt into the ranges between them, and a range that got too many records is divided by
splitters sampled inside it, again until none is too large. Each range is then ordered by itself, totals of the
ranges give every record its exact place in the whole order, and equal cuts of all bytes are the shards.

The order ends with a number given to each stored record, so records with equal keys, repeated rows too, can be
divided; shards differ by one record's size at most. Null keys come first, a null size counts as 0. An empty table
gives an empty result. Columns to be kept are named in ``carry``; names of other columns don't matter.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.llm.common import stage_table

#: Splitters of one level and sampled keys for each of them; both bound what the driver reads.
FANOUT = 64
OVERSAMPLING = 32


def _priority(record: str, size: str, level: int) -> Column:
    """The smallest of these are a sample without repeats, weighted by size (exponential clocks)."""
    uniform = (F.shiftrightunsigned(F.xxhash64(record, F.lit(level)), 11) + 1) / F.lit(2.0**53 + 2)
    return -F.log(uniform) / F.greatest(F.col(size), F.lit(1))


def shard_by_bytes(
    records: DataFrame,
    key: Sequence[Column],
    size: Column,
    shards: int = 16,
    carry: Sequence[str] = ("doc_id",),
    most_records: int = 2_000_000,
) -> DataFrame:
    """The carried columns with ``size``, ``shard`` (from 0) and ``slot`` (gapless in its shard).

    ``most_records`` is the size from which a range is divided further; one task orders one range.
    """
    dealt = stage_table(
        records.select(
            *[F.col(c).alias(f"_carry_{c}") for c in carry],
            F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
            *[c.alias(f"_key_{i}") for i, c in enumerate(key)],
        )
        .withColumn("_record", F.monotonically_increasing_id()),
        "shard-records",
    )
    place = F.struct(*[F.col(f"_key_{i}") for i in range(len(key))], "_record")
    dealt = dealt.select("*", place.alias("_place"), F.lit(0).cast("long").alias("_range"))
    level = 0
    while True:
        full = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_records)
        if level and full.isEmpty():
            break
        dealt = stage_table(_divided(dealt, None if level == 0 else full.select("_range"), level), "shard-ranges")
        level += 1
    return _cut(dealt, shards, carry)


def _divided(dealt: DataFrame, full: DataFrame | None, level: int) -> DataFrame:
    """Deal the records of all ranges (``full`` None) or of the full ones among splitters sampled there."""
    size = FANOUT * OVERSAMPLING
    chosen = dealt.select("_range", "_place", _priority("_record", "_size", level).alias("_priority"))
    if full is None:
        sample = chosen.orderBy("_priority", "_place").limit(size)
    else:
        first = Window.partitionBy("_range").orderBy("_priority", "_place")
        sample = chosen.join(full, "_range", "left_semi").withColumn("_nth", F.row_number().over(first))
        sample = sample.where(F.col("_nth") <= size)
    splitters = (
        sample.groupBy("_range")
        .agg(F.array_sort(F.collect_list("_place")).alias("_sorted"))
        .select(
            "_range",
            F.transform(
                F.sequence(F.lit(1), F.lit(FANOUT - 1)),
                lambda i: F.element_at("_sorted", (F.ceil(i * F.size("_sorted") / FANOUT)).cast("int")),
            ).alias("_splitters"),
        )
    )
    if full is None:
        splitters = F.broadcast(splitters)  # one row of FANOUT - 1 keys
    below = F.size(F.filter("_splitters", lambda s: s < F.col("_place")))
    joined = dealt.join(splitters, "_range", "left")
    return joined.select(
        *[c for c in dealt.columns if c != "_range"],
        (F.col("_range") * FANOUT + F.when(F.col("_splitters").isNull(), 0).otherwise(below)).alias("_range"),
    )


def _cut(dealt: DataFrame, shards: int, carry: Sequence[str]) -> DataFrame:
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.sum("_bytes").over(everything).alias("_all"),
        F.sum("_n").over(everything).alias("_all_n"),
    )
    inside = Window.partitionBy("_range").orderBy("_place")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    ordered = dealt.select(
        "_range",
        "_size",
        *[f"_carry_{c}" for c in carry],
        F.row_number().over(inside).cast("long").alias("_nth"),
        F.sum("_size").over(running).alias("_upto"),
    ).join(offsets, "_range")
    # The shard in which the middle of the record lies; without any bytes records are cut by number.
    middle = (F.col("_bytes_before") + F.col("_upto")) * 2 - F.col("_size")
    by_bytes = F.floor(middle * shards / (F.col("_all") * 2))
    by_number = F.floor((F.col("_n_before") + F.col("_nth") - 1) * shards / F.col("_all_n"))
    shard = F.least(F.when(F.col("_all") > 0, by_bytes).otherwise(by_number), F.lit(shards - 1)).cast("int")
    placed = stage_table(
        ordered.select(
            *[f"_carry_{c}" for c in carry],
            "_size",
            shard.alias("_shard"),
            (F.col("_n_before") + F.col("_nth") - 1).alias("_rank"),
        ),
        "shard-places",
    )
    starts = placed.groupBy("_shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(starts), "_shard").select(  # one row per shard
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
        F.col("_size").alias("size"),
        F.col("_shard").alias("shard"),
        (F.col("_rank") - F.col("_first")).alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, each ordered by slot in files that follow each other."""
    parted = sharded.repartitionByRange(*[F.col("shard"), F.col("slot")]).sortWithinPartitions("shard", "slot")
    parted.write.mode("errorifexists").partitionBy("shard").parquet(path)
