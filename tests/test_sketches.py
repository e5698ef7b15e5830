"""Percentiles from daily sketches against exact ones, and days that stay as they were written."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from forewarn.operators.sketches import add_days, daily_sketches, measured_rank_errors, rank_error, sketch_percentiles

RANKS = {"low": 0.001, "half": 0.5, "high": 0.99}


def readings(spark, days, n=4000, seed=1):
    draw = random.Random(seed)
    rows = []
    for day in days:
        for i in range(n):
            rows.append((f"2024-01-{day:02d} {i % 24:02d}:00:00", draw.lognormvariate(0, 3), 7.0, 100 + draw.random() * 1e-9,
                         draw.choice([None, float("nan"), float(day)])))
    df = spark.createDataFrame(rows, "t string, skewed double, constant double, narrow double, holes double")
    return df.withColumn("ts", df["t"].cast("timestamp_ntz")).drop("t")


SENSORS = ("skewed", "constant", "narrow", "holes")


def test_percentiles_of_a_span_are_within_their_error(spark, tmp_path):
    path, data = str(tmp_path / "s"), readings(spark, range(1, 9))
    assert add_days(daily_sketches(data, SENSORS, "ts"), path) == 8
    stored = spark.read.parquet(path)
    span = data.where("ts >= '2024-01-03' AND ts < '2024-01-07'")
    found = sketch_percentiles(stored, RANKS, "2024-01-03", "2024-01-06")
    errors = measured_rank_errors(found, span, SENSORS, RANKS).collect()
    assert len(errors) == 12 and max(r["error"] for r in errors) <= rank_error()
    by = {r["sensor"]: r for r in found.collect()}
    assert by["constant"]["half"] == 7.0 and by["skewed"]["n"] == 16_000
    assert by["holes"]["n"] == span.where("holes IS NOT NULL AND NOT isnan(holes)").count()


def test_a_new_day_touches_no_old_one(spark, tmp_path):
    path = tmp_path / "s"
    add_days(daily_sketches(readings(spark, [1, 2], 200), SENSORS, "ts"), str(path))
    before = {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in path.rglob("*.parquet")}
    # Day 2 comes again, with other readings: it is stored already.
    assert add_days(daily_sketches(readings(spark, [2, 3], 300, seed=2), SENSORS, "ts"), str(path)) == 1
    after = {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in path.rglob("*.parquet")}
    assert before.items() <= after.items() and {f.parent.name for f in set(after) - set(before)} == {"day=2024-01-03"}
    counts = {r["sensor"]: r["n"] for r in sketch_percentiles(spark.read.parquet(str(path)), RANKS).collect()}
    assert counts["constant"] == 200 + 200 + 300
    assert add_days(daily_sketches(readings(spark, [2, 3], 10), SENSORS, "ts"), str(path)) == 0


def test_sketches_by_machine(spark):
    data = readings(spark, [1], 100).withColumn("machine", F.lit("m"))
    more = readings(spark, [1], 50, seed=5).withColumn("machine", F.lit("n"))
    found = sketch_percentiles(daily_sketches(data.unionByName(more), ["skewed"], "ts", ["machine"]), RANKS, keys=["machine"])
    assert {r["machine"]: r["n"] for r in found.collect()} == {"m": 100, "n": 50}


def test_error_falls_with_the_size_of_a_sketch():
    assert rank_error(200) == pytest.approx(0.0193, abs=0.001) and rank_error(800) < 0.006
