"""Places of rows in a global order, without a task that sees a whole group.

Rows are range-partitioned and sorted; a row's place is its place in its partition plus the rows of its group in the
partitions before. Only counts, one row for each group and partition, meet in a window. The order ends with a number
given to each stored record, so rows that agree in all keys are divided among partitions too; which of them comes
first is then fixed by the written table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forewarn.llm.common import stage_table

# Bits below the partition's number in monotonically_increasing_id().
_PARTITION_BITS = 33


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """The rows with ``place`` (from 0 in the group) and ``total`` (rows of the group).

    ``rows`` should be a written table, ``group`` a column without nulls; nulls in ``order`` come first.
    """
    keys = [group, *order, "_record"]
    numbered = rows.withColumn("_record", F.monotonically_increasing_id())
    spread = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_record")
    placed = stage_table(spread.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", _PARTITION_BITS)
    counts = placed.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = Window.partitionBy(group)  # a row for each partition
    offsets = counts.select(
        group,
        "_part",
        (F.sum("_n").over(parts.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(parts).alias("total"),
    )
    return (
        placed.withColumn("_part", part)
        .join(offsets, [group, "_part"])
        .withColumn("place", F.col("_at") + F.col("_shift"))
        .drop("_part", "_at", "_shift")
    )
