"""Small hand-made inputs for the operator tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from forewarn.spec import TelemetrySpec

SPEC = TelemetrySpec(order_cols=("row_order",))
START = datetime(2020, 2, 1)
NTZ = T.TimestampNTZType()


def telemetry(spark, seconds, overrides=None):
    """One reading per entry of ``seconds``; ``overrides`` maps row number -> {column: value}."""
    overrides = overrides or {}
    rows = []
    for i, s in enumerate(seconds):
        comp = (i // 60) % 2
        row = {
            "timestamp": START + timedelta(seconds=s), "TP2": 2.0 + 7 * comp, "TP3": 8.0, "H1": 8.0, "DV_pressure": 0.0,
            "Reservoirs": 8.0, "Oil_temperature": 60.0, "Motor_current": 3.0 + 5 * comp, "COMP": float(comp), "row_order": i,
        }
        row.update(overrides.get(i, {}))
        rows.append(tuple(row.values()))
    schema = T.StructType(
        [T.StructField("timestamp", NTZ)]
        + [T.StructField(c, T.DoubleType()) for c in SPEC.channels]
        + [T.StructField("row_order", T.LongType())]
    )
    return spark.createDataFrame(rows, schema)


def at(hours: float) -> datetime:
    return START + timedelta(hours=hours)


def windows(spark, spans, **columns):
    """Windows of segment 0 from (start hours, end hours) pairs."""
    rows = [(0, at(a), at(b)) for a, b in spans]
    schema = T.StructType(
        [T.StructField("segment_id", T.LongType()), T.StructField("window_start", NTZ), T.StructField("window_end", NTZ)]
    )
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({name: F.lit(value) for name, value in columns.items()})


def predictions(spark, rows):
    """Rows of (seed, fold, segment, start hours, label, probability[, hours to failure])."""
    full = [
        ("xgboost", 1, r[0], r[1], r[2], f"{r[2]}:{r[3]}", at(r[3]), at(r[3] + 1), r[4], r[5], r[6] if len(r) > 6 else None)
        for r in rows
    ]
    schema = (
        "model string, horizon_hours int, seed int, fold string, segment_id long, window_id string, "
        "window_start timestamp_ntz, window_end timestamp_ntz, true_label int, probability double, hours_to_next_failure double"
    )
    return spark.createDataFrame(full, schema)
