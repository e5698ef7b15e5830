"""Readers of stored evidence: prediction traces, result tables and thresholds."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forewarn.operators.checks import require_domain
from forewarn.operators.reports import require_rows
from forewarn.spec import EvaluationGrid, require_columns

THRESHOLD_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("horizon_hours", T.IntegerType()),
        T.StructField("selection_scope", T.StringType()),
        T.StructField("seeds", T.ArrayType(T.IntegerType())),
        T.StructField("reference_threshold", T.DoubleType()),
        T.StructField(
            "operational",
            T.StructType(
                [
                    T.StructField("threshold", T.DoubleType()),
                    T.StructField("development_f2", T.DoubleType()),
                    T.StructField("development_false_alert_episodes", T.LongType()),
                ]
            ),
        ),
    ]
)

_NAME = r"([^/=]+)_h(\d+)\.csv"

# Columns of a stored trace file; the model and horizon may also sit in its name.
_TRACE_TYPES = {
    "seed": "int",
    "window_id": "string",
    "segment_id": "long",
    "window_start": "timestamp_ntz",
    "window_end": "timestamp_ntz",
    "true_label": "int",
    "probability": "double",
    "hours_to_next_failure": "double",
}


def _named_traces(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV traces named ``<model>_h<hours>.csv[.gz]``, as a file or as a folder of part files.

    The last ``_h`` of the name separates model and hours.
    """
    raw = spark.read.csv(pattern, header=True)
    name = F.col("_metadata.file_path")
    typed = {c: F.col(c).try_cast(kind) for c, kind in _TRACE_TYPES.items() if c in raw.columns}
    return raw.withColumns(
        {
            "model": F.regexp_extract(name, _NAME, 1),
            "horizon_hours": F.regexp_extract(name, _NAME, 2).cast("int"),
        }
        | typed
    )


def scan_named_traces(spark: SparkSession, root: str, holdout_event: str) -> DataFrame:
    """All development and holdout trace files, with ``event`` (the fold, or the holdout)."""
    columns = ["model", "horizon_hours", *_TRACE_TYPES, "event"]
    development = _named_traces(spark, f"{root}/development/*.csv*").withColumn("event", F.col("fold"))
    holdout = _named_traces(spark, f"{root}/holdout/*.csv*").withColumn("event", F.lit(holdout_event))
    return development.select(*columns).unionByName(holdout.select(*columns))


def scan_trace(
    spark: SparkSession, path: str, model: str, horizon_hours: int, event: str
) -> DataFrame:
    """One model, horizon and event of a partitioned trace table; only its folder is read."""
    return spark.read.parquet(path).where(
        (F.col("model") == model) & (F.col("horizon_hours") == horizon_hours) & (F.col("event") == event)
    )


def load_trace(spark: SparkSession, path: str, model: str, horizon_hours: int, event: str) -> DataFrame:
    """The same, raising when there are no rows."""
    return require_rows(
        scan_trace(spark, path, model, horizon_hours, event), f"no predictions of {model}, {horizon_hours} h, for {event}"
    )


def read_thresholds(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """Nested threshold records from JSON: one per line, or one document holding a list."""
    return spark.read.schema(THRESHOLD_SCHEMA).json(path, multiLine=one_document)


def load_metrics(metrics: DataFrame, grid: EvaluationGrid) -> DataFrame:
    """A metric table that covers exactly the grid's models, horizons and seeds."""
    return require_domain(
        metrics, {"model": grid.models, "horizon_hours": grid.horizons, "seed": grid.seeds}
    )


def load_eventwise(eventwise: DataFrame, grid: EvaluationGrid) -> DataFrame:
    """An event table that covers exactly the grid's events."""
    return require_domain(eventwise, {"event": grid.events})


def load_regimes(summary: DataFrame, effects: DataFrame, events: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Regime tables with the needed columns, covering exactly the given events."""
    require_columns(summary.columns, ["feature", *events, "direction_consistency"], "regime summary")
    require_columns(
        effects.columns, ["event", "feature", "robust_standardized_difference", "event_windows"], "regime effects"
    )
    return summary, require_domain(effects, {"event": events})
