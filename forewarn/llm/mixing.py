"""Mixing sources to target weights: how often each document is repeated.

The words of each source are summed. Weights share all words among the sources; a source takes at most ``most`` times
what it has, and what it cannot take is shared again among the others by weight until no target is above its bound.
Target over size is a source's repetition rate: each document is taken floor(rate) times, and once more by a draw whose
chance is the fraction. Draws are seeded by hashes of the source and of the ids, so reruns agree.

Independent draws miss a target by several per cent where long documents hold much of a source. So a source's draws
are spread over its documents in the order of their sizes: from a start that the hash of the source draws, steps as long
as the fraction pass a whole number once for each copy. Each document's chance is still the fraction, and what is
taken misses the target by about the longest document at most.

Rows that agree in all columns are drawn one by one like others. A null text has no words, a null source is a source of
its own (the last in order), a null id comes before others of its size. A source without words has target 0 and its
documents are taken 0 times. An empty table gives no rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.llm.common import named, stage_table
from forewarn.llm.ranking import ranked

#: Weights of the sources in their order, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST_REPEATS = 3
SEED = 20_13

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, size: Column) -> DataFrame:
    """``doc_id``, ``source`` and ``size``, written once, as sums and decisions both read them."""
    source = F.col("source").cast("string")
    return stage_table(docs.select("doc_id", source.alias("source"), size.cast("long").alias("size")), "mix-sizes")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``rate`` of each source.

    Each round binds the sources above their bound and shares the rest anew; the driver reads three sums a round.
    """
    summed = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    summed = stage_table(
        summed.select("*", F.lit(0).alias("group"), F.col("source").isNull().alias("last")), "mix-sources"
    )
    placed = ranked(summed, "group", ["last", "source"], "mix-order")
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    bound = F.col("source_size") * most
    shared = stage_table(placed.select("source", "source_size", weight.alias("weight"), bound.alias("bound")), "mix-weights")
    wide = "decimal(38,0)"
    total = shared.agg(F.sum(F.col("source_size").cast(wide))).first()[0] or 0
    # A source is bound when its weight's share is more than its bound, compared as products of whole numbers.
    bound_now, rest, free = F.lit(False), total, None
    while True:
        sums = shared.agg(
            F.sum(F.when(bound_now, F.col("bound")).otherwise(0).cast(wide)).alias("bound"),
            F.sum(F.when(bound_now, 0).otherwise(F.col("weight")).cast(wide)).alias("weight"),
            F.count_if(bound_now).alias("n"),
        ).first()
        rest, free, n = total - (sums["bound"] or 0), sums["weight"] or 0, sums["n"]
        above = F.col("weight").cast(wide) * F.lit(int(rest)).cast(wide) > F.col("bound").cast(wide) * F.lit(int(free)).cast(wide)
        following = bound_now | above if free else bound_now
        if shared.where(following).count() == n:
            break
        shared = stage_table(shared.select("source", "source_size", "weight", "bound", following.alias("is_bound")), "mix-bound")
        bound_now = F.col("is_bound")
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(free or 1))
    target = F.when(bound_now, F.col("bound").cast("double")).otherwise(share)
    return shared.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _uniform(name: Column, seed: int) -> Column:
    """A number from 0 to 1 that a name and the seed decide: the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(name.cast("string"), F.lit("-")))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def decisions(sized: DataFrame, shares: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of a written table of sizes with ``source_size``, ``target``, ``copies`` and ``taken``."""
    turn, named = _uniform(F.col("doc_id"), seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    placed = ranked(sized.withColumns({"turn": turn, "named": named}), "named", ["size", "turn", "doc_id"], "mix-places")
    rates = shares.withColumnRenamed("source", "of_source")
    joined = placed.join(rates, placed["source"].eqNullSafe(rates["of_source"]))
    fraction, start = F.col("rate") - F.floor("rate"), _uniform(F.col("source"), seed)
    # Of the places of a source, in steps of the fraction from a drawn start, those at which a whole number is passed.
    drawn = F.floor(start + (F.col("place") + 1) * fraction) - F.floor(start + F.col("place") * fraction)
    copies = F.floor("rate") + drawn
    return joined.select(
        *sized.columns, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with."""
    # The caller's columns travel in one struct, so their names can be any, and each row gets a number.
    plain = docs.select(
        F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
        "doc_id",
        F.col("source").cast("string").alias("source"),
        size.cast("long").alias("size"),
        F.monotonically_increasing_id().alias("number"),
    )
    plain = stage_table(plain, "mix-documents")
    sized = plain.select("doc_id", "source", "size", "number")
    taken = decisions(sized, targets(sized, weights, most), seed).where(F.col("copies") > 0).select("number", "copies")
    emitted = plain.join(taken, "number").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return emitted.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
