"""What the text operators share: table access, shipping code to workers, Arrow batches in tasks."""

from __future__ import annotations

import ctypes
import gc
import os
from pathlib import Path
from typing import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forewarn.sources.sinks import stage_table

__all__ = ["documents", "embeddings", "forget_after", "map_rows", "sealed", "ship", "stage_table", "table", "unsealed",
           "with_changed"]

# Rows of one Arrow batch handed back to Spark, and bytes of an incoming one turned into Python values at a time.
OUT_ROWS = 2000
IN_BYTES = 4 << 20
#: Bytes of one Arrow batch between Spark and a Python task: rows are texts, and 10,000 of them can be any size.
BATCH_BYTES = 8 << 20

# What empties the caches of a Python worker, and whose they are; workers live on for other stages.
_CACHES: list[Callable[[], object]] = []
_OWNER: list[str] = []


def forget_after(clear: Callable[[], object]) -> None:
    """Have a module's cache emptied when the worker goes on to another kind of work."""
    _CACHES.append(clear)


def enter(owner: str) -> None:
    """Begin a partition's work: what other work left in this worker's caches goes back to the system."""
    if _OWNER != [owner]:
        for clear in _CACHES:
            clear()
        give_back()
        _OWNER[:] = [owner]


def give_back() -> None:
    """Return memory that is not used any more to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def named(column: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def sealed(df: DataFrame, text: str) -> DataFrame:
    """``row``, a struct of all columns but the text, and ``text``: no name of the caller's meets a helper's name."""
    others = [named(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c != text]
    return df.select(F.struct(*others, F.lit(0).alias("none")).alias("row"), named(text).alias("text"))


def unsealed(columns: Sequence[str], text: str) -> list[Column]:
    """The columns that ``sealed`` put away, in their order and under their names."""
    return [(F.col("text") if c == text else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``IN_BYTES`` (or one row)."""
    size = max(1, int(batch.num_rows * IN_BYTES / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def ship(spark: SparkSession) -> None:
    """Prepare a session for work in Python tasks: bounded batches, and this package where the driver found it.

    A cluster gets the package by ``--py-files`` or an installed wheel; then nothing is added. A session that asks for
    smaller batches keeps them.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(bound).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[Sequence]], schema: str) -> DataFrame:
    """Apply a generator of rows to each partition, by Arrow batches.

    ``rows`` gets an iterator over the partition's rows as tuples and yields output rows in the
    order of ``schema``. Memory is bounded by one input and one output batch, of which a slice is in Python values.
    """
    spark = df.sparkSession
    ship(spark)
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    owner = f"{rows.__module__}.{rows.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)

        def incoming() -> Iterator[tuple]:
            for batch in batches:
                for part in slices(batch):
                    yield from zip(*[column.to_pylist() for column in part.columns])

        waiting: list[Sequence] = []
        for row in rows(incoming()):
            waiting.append(row)
            if len(waiting) >= OUT_ROWS:
                yield _batch(waiting, arrow)
                waiting = []
        if waiting:
            yield _batch(waiting, arrow)

    return df.mapInArrow(run, schema)


def with_changed(
    df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], change: Callable[..., Sequence], kind: str = "string"
) -> DataFrame:
    """The table with the columns ``outputs`` set to what ``change`` makes of the row's ``inputs``, by Arrow batches.

    Columns need plain names (see ``sealed``); those that are no output pass through untouched.
    """
    ship(df.sparkSession)
    kept = [field for field in df.schema if field.name not in outputs]
    schema = T.StructType([*kept, *[T.StructField(name, T._parse_datatype_string(kind)) for name in outputs]])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(T._parse_datatype_string(kind))
    names = [field.name for field in kept]
    owner = f"{change.__module__}.{change.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        for batch in batches:
            for part in slices(batch):
                rows = zip(*[part.column(name).to_pylist() for name in inputs])
                made = list(zip(*[change(*row) for row in rows]))
                arrays = [part.column(name) for name in names] + [pa.array(values, arrow) for values in made]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *outputs])

    return df.mapInArrow(run, schema)


def _batch(rows: list[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
