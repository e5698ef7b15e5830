"""Results of grid cells that are either whole or not there.

A batch of cells is written under a name that nothing else uses. What was stored is read back, counted and digested,
and one small file with a row for each cell is then added to the manifest: that file is the commit. Readers see cells
that the manifest names and nothing else, so a write that broke half way, whatever it left behind, is no result, and
what is still to be run follows from the manifest alone. The layout under ``root``:

    cells/batch=<name>/<key>=<value>/...   rows of the cells
    manifest/                              batch, key columns, config, rows, fingerprint, committed_at
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.sources.sinks import table_fingerprint

CELL = ("model", "horizon_hours", "seed")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet folder, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same &= left[key].eqNullSafe(right[key])
    return same


def committed_cells(spark: SparkSession, root: str, config: str | None = None, keys: Sequence[str] = CELL) -> DataFrame | None:
    """One manifest row for each committed cell (of one configuration); None if there is no manifest.

    If a cell was committed twice by writers that ran side by side, its first commit counts.
    """
    manifest = _stored(spark, f"{root}/manifest")
    if manifest is None:
        return None
    if config is not None:
        manifest = manifest.where(F.col("config") == config)
    others = [c for c in manifest.columns if c not in (*keys, "config")]
    first = F.min_by(F.struct(*others), F.struct("committed_at", "batch")).alias("_first")
    return manifest.groupBy(*keys, "config").agg(first).select(*keys, "config", "_first.*")


def commit_cells(rows: DataFrame, root: str, config: str, keys: Sequence[str] = CELL) -> int:
    """Write the cells that are not committed yet, then commit them; returns how many they are.

    ``rows`` holds all rows of its cells. Cells that the manifest has stay as they are, so a repeated commit changes
    nothing. An error before the last step leaves the manifest, and with it every reader, untouched.
    """
    spark, keys = rows.sparkSession, list(keys)
    known = committed_cells(spark, root, config, keys)
    if known is not None:
        known = known.select(*keys)
        rows = rows.join(known, _matches(rows, known, keys), "left_anti")
    batch = uuid.uuid4().hex
    path = f"{root}/cells/batch={batch}"
    rows.write.mode("errorifexists").partitionBy(*keys).parquet(path)
    stored = _stored(spark, path)
    if stored is None:
        return 0
    entries = table_fingerprint(stored, keys, sorted(stored.columns)).select(
        F.lit(batch).alias("batch"), *keys, F.lit(config).alias("config"), "rows", "fingerprint",
        F.current_timestamp().alias("committed_at"),
    )
    # One file, put in its place by one rename: all cells of the batch appear at once.
    entries.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    found = committed_cells(spark, root, config, keys)
    return found.where(F.col("batch") == batch).count()


def read_cells(spark: SparkSession, root: str, config: str | None = None, keys: Sequence[str] = CELL) -> DataFrame | None:
    """Rows of all committed cells; folders that no commit names are not opened."""
    known = committed_cells(spark, root, config, keys)
    if known is None:
        return None
    cells = spark.read.option("mergeSchema", False).parquet(f"{root}/cells")
    wanted = known.select("batch", *keys)
    return cells.join(wanted, _matches(cells, wanted, ["batch", *keys]), "left_semi").drop("batch")


def pending_in_manifest(cells: DataFrame, root: str, config: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Cells of a grid that are not committed under this configuration."""
    known = committed_cells(cells.sparkSession, root, config, keys)
    return cells if known is None else cells.join(known.select(*keys), _matches(cells, known, keys), "left_anti")


def damaged_cells(spark: SparkSession, root: str, keys: Sequence[str] = CELL) -> DataFrame | None:
    """Committed cells whose rows are not those that were committed: ``rows`` and ``found`` (null if all are gone)."""
    known = committed_cells(spark, root, None, keys)
    if known is None:
        return None
    cells = spark.read.parquet(f"{root}/cells")
    # The batch's name is no part of the rows.
    columns = sorted(c for c in cells.columns if c != "batch")
    now = table_fingerprint(cells, ["batch", *keys], columns)
    joined = known.join(now, _matches(known, now, ["batch", *keys]), "left")
    changed = ~known["fingerprint"].eqNullSafe(now["fingerprint"])
    return joined.where(changed).select(*[known[k] for k in keys], known["config"], known["rows"], now["rows"].alias("found"))

