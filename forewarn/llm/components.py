"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.llm.common import stage_table


def connected_components(links: DataFrame) -> DataFrame:
    """For links (a, b) one row (node, component) per linked node; a component is named by its least node.

    Each round points every node and its larger neighbours to the least neighbour, from the larger side and then from the
    smaller, so chains shorten to stars in few rounds; the rounds end when no link changes. Nothing is collected and
    no neighbour list is built; every round is written to the shared folder. Null ends and self-links are ignored.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b")
    pairs = ends.where("a IS NOT NULL AND b IS NOT NULL AND u <> v").select("u", "v").distinct()
    pairs = stage_table(pairs, "components")
    mark = _mark(pairs)
    while mark[0]:
        # Every larger neighbour of a node is pointed to the node's least neighbour (or the node itself).
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Then a node and its smaller neighbours are pointed to the least of them.
        large = stage_table(large.distinct(), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = stage_table(stars, "components")
        after = _mark(pairs)
        if after == mark:
            break
        mark = after
    names = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return names.unionByName(names.select(F.col("component").alias("node"), "component").distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Number and digest of the links; the same twice means that nothing moved."""
    row = pairs.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))
    ).first()
    return tuple(row)
