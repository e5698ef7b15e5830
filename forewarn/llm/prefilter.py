"""A filter on keys by a bitmap of fixed size, so that large rows without a partner stay out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.llm.common import named, stage_table

#: Bits of the bitmap; 4 MB, whatever the number of keys.
BITS = 1 << 25
_ROW_BITS = 32768  # bits in a row of Spark's bitmap functions


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def likely_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among ``keys`` (one column), and few others.

    Keys are hashed into ``BITS`` bits; none is lost, and the more bits are set, the more other rows pass. A join
    afterwards settles it. The broadcast bitmap has at most ``BITS / 32768`` rows of 4 KB.
    """
    return split(rows, key, keys)[0]


def split(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``likely_in`` and all other rows, none of which has its key among ``keys``."""
    (name,) = keys.columns
    bits = keys.where(F.col(name).isNotNull()).select(_bit(F.col(name)).alias("bit"))
    bitmap = bits.groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bitmap")
    )
    bitmap = F.broadcast(stage_table(bitmap, "prefilter"))
    bit = _bit(F.col(key))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, CAST(_at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, CAST(_at % 8 AS INT))")) != 0
    # The rows' own columns go through in a struct, so they can have any names.
    held = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]).alias("row")
    placed = rows.select(held, F.bitmap_bucket_number(bit).alias("_bucket"), F.bitmap_bit_position(bit).alias("_at"))
    joined = placed.join(bitmap, "_bucket", "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    columns = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(rows.columns)]
    return joined.where("_hit").select(*columns), joined.where("NOT _hit").select(*columns)
