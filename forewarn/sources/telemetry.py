"""Telemetry scans: explicit schema, column coercion and arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forewarn.functions.missing import number_or_null
from forewarn.spec import TelemetrySpec, require_columns

# Rows of one block are numbered; a block is never larger than this many rows.
BLOCK_ROWS = 1_000_000


def scan_csv(
    spark: SparkSession, path: str | list[str], spec: TelemetrySpec, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Read raw CSV as text columns plus arrival order.

    Every column is read as a string so that one bad cell never drops a row; a
    missing path raises. ``row_block`` is (file, offset of the input split) and
    ``row_order`` counts rows inside it. The header must list the columns in the
    order asset columns, required columns, extra columns.
    """
    names = [*spec.asset_cols, *spec.required, *extra]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return (
        spark.read.schema(schema)
        .csv(path, header=True, enforceSchema=False)
        .select(
            "*",
            F.concat_ws(
                "#",
                F.col("_metadata.file_path"),
                F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0"),
            ).alias("row_block"),
            F.monotonically_increasing_id().alias("row_order"),
        )
    )


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read parquet plus arrival order from the file's own row numbers."""
    row = F.col("_metadata.row_index")
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select(
        "*",
        F.concat_ws(
            "#",
            F.col("_metadata.file_path"),
            F.lpad(F.floor(row / BLOCK_ROWS).cast("string"), 19, "0"),
        ).alias("row_block"),
        row.alias("row_order"),
    )


def parse_timestamp(column: Column, source_type: T.DataType, pattern: str | None = None) -> Column:
    """A zone-free timestamp; anything unparseable becomes null."""
    if isinstance(source_type, T.StringType):
        if pattern is not None:
            return F.try_to_timestamp(column, F.lit(pattern)).cast("timestamp_ntz")
        return column.try_cast("timestamp_ntz")
    return column.cast("timestamp_ntz")


def coerce(df: DataFrame, spec: TelemetrySpec, pattern: str | None = None) -> DataFrame:
    """Parse the timestamp and every channel; bad cells become null, rows stay."""
    require_columns(df.columns, spec.required, "telemetry")
    stamp = parse_timestamp(F.col(spec.timestamp), df.schema[spec.timestamp].dataType, pattern)
    return df.withColumns(
        {spec.timestamp: stamp} | {name: number_or_null(F.col(name)) for name in spec.channels}
    )
