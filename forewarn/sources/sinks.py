"""Writers: quarantine, partitioned traces, reports, fingerprints and stage tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forewarn.functions.timeline import micros


def write_quarantine(quarantined: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write rejected rows, only if there are any; returns whether something was written."""
    if quarantined.isEmpty():
        return False
    out = quarantined
    if fmt == "csv":
        out = out.withColumn("reasons", F.array_join("reasons", "|"))
    out.write.mode("overwrite").format(fmt).option("header", True).save(path)
    return True


def write_validated(flagged: DataFrame, path: str) -> dict[str, int]:
    """Write valid and rejected rows in one pass, as ``is_valid=true`` and ``is_valid=false``, and count them on the way.

    The counts are those of ``validation_report`` but for the segments. They are taken in the tasks that write, whose
    output counts once however often a task is tried.
    """
    counted = Observation("validated")
    observed = flagged.observe(
        counted,
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if("is_valid").alias("valid_rows"),
        F.count_if(~F.col("is_valid")).alias("quarantined_rows"),
        F.count_if("duplicate_timestamp").alias("duplicate_timestamps"),
    )
    observed.write.mode("errorifexists").partitionBy("is_valid").parquet(path)
    return counted.get


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_validated``; a filter on ``is_valid`` opens one of its two folders."""
    return spark.read.parquet(path).withColumn("is_valid", F.col("is_valid").cast("boolean"))


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str] = ("model", "horizon_hours")) -> None:
    """Write a table partitioned by grid keys, so that readers prune by folder."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_named_traces(traces: DataFrame, path: str) -> None:
    """Write traces as gzip CSV, one folder ``<model>_h<hours>.csv`` per model and horizon."""
    name = F.concat("model", F.lit("_h"), "horizon_hours", F.lit(".csv"))
    traces.withColumn("name", name).drop("model", "horizon_hours").write.mode("overwrite").partitionBy(
        "name"
    ).option("header", True).option("compression", "gzip").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write a one-row report as JSON with the fields in schema order."""
    report.coalesce(1).write.mode("overwrite").json(path)


def _plain_text(field: T.StructField) -> Column:
    """A column as text that any engine can write: doubles in millionths, times in microseconds."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        column = F.round(column.cast("double") * 1e6).cast("long")
    elif isinstance(field.dataType, T.TimestampNTZType):
        column = micros(column)
    return F.coalesce(column.cast("string"), F.lit("~"))


def row_number_of_text(text: Column) -> Column:
    """The first 60 bits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")


def table_fingerprint(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-independent digest that repeated rows do not cancel, for each value of the keys.

    It is the sum of digests of the rows' texts (all columns, or those named, in their order), so another engine can
    recompute it.
    """
    names = df.columns if columns is None else columns
    text = F.concat_ws("|", *[_plain_text(df.schema[name]) for name in names])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_number_of_text(text)), F.lit(0)).cast("string").alias("fingerprint"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of small files, for tying a report to its sources."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a temporary folder is chosen.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="forewarn-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Write a stage result to the shared folder and read it back.

    Cuts the lineage between stages with several consumers; the files survive
    the loss of executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
