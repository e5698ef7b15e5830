"""Code and numbers on their way between Spark and Python tasks."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python tasks import this package from where the driver found it; changes nothing where it is installed."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def matrix(lists: pa.Array, width: int, dtype: type = np.float64) -> np.ndarray:
    """A column of equally long lists as rows of a matrix; missing numbers become NaN."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(lists), width)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1)))
