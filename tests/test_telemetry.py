from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forewarn.functions.quantiles import exact_percentiles, magnitude_bucket
from forewarn.operators.profile import cadence_summary, common_gaps, missing_counts, resampling_candidates, sensor_percentiles
from forewarn.operators.segments import assign_segments, segment_profile
from forewarn.operators.validation import quarantined_rows, valid_rows, validate, validation_report
from forewarn.operators.windows import degenerate_windows, feature_columns, require_rates, window_features
from forewarn.plans.audit import audit_report, audit_tables, write_audit
from forewarn.sources.sinks import read_validated, table_fingerprint, write_quarantine, write_validated
from forewarn.sources.telemetry import coerce, scan_csv, scan_parquet
from forewarn.spec import FAILURES, WindowPolicy
from tests.fixtures import SPEC, START, telemetry

CARRY = (SPEC.volatility,)


def cut(df, policy):
    valid = valid_rows(validate(coerce(df, SPEC), SPEC))
    segmented = assign_segments(valid, SPEC, policy.max_gap_seconds, carry=CARRY)
    return segmented, segment_profile(segmented, SPEC)


def build(df, policy):
    segmented, profile = cut(df, policy)
    return window_features(segmented, profile, SPEC, policy)


def test_gap_opens_a_second_segment_with_its_own_windows(spark):
    seconds = [i if i < 2000 else i + 60 for i in range(4000)]
    policy = WindowPolicy(1200, 600)
    segmented, profile = cut(telemetry(spark, seconds), policy)
    assert profile.count() == 2
    windows = window_features(segmented, profile, SPEC, policy)
    assert {r["segment_id"] for r in windows.collect()} == {0, 1}
    bounds = {r["segment_id"]: (r["segment_start"], r["segment_end"]) for r in profile.collect()}
    for row in windows.collect():
        first, last = bounds[row["segment_id"]]
        assert row["window_start"] >= first and row["window_end"] <= last + timedelta(seconds=1)


@pytest.mark.parametrize("gap,segments", [(30, 1), (31, 2)])
def test_gap_limit_is_exclusive(spark, gap, segments):
    assert cut(telemetry(spark, [0, 10, 10 + gap, 20 + gap]), WindowPolicy())[1].count() == segments


def test_segments_do_not_depend_on_the_slice_width(spark):
    seconds = sorted(set(np.random.default_rng(5).integers(0, 20000, 600).tolist()))
    valid = valid_rows(validate(coerce(telemetry(spark, seconds), SPEC), SPEC))
    expected = (pd.Series(seconds).diff().fillna(0) > 30).cumsum().tolist()
    for width in (7, 60, 3600, 10**6):
        rows = assign_segments(valid, SPEC, 30, carry=CARRY, chunk_seconds=width).orderBy("timestamp").collect()
        assert [r["segment_id"] for r in rows] == expected
        for before, row in zip([None, *rows], rows):
            same = before is not None and before["segment_id"] == row["segment_id"]
            assert row["previous_timestamp"] == (before["timestamp"] if same else None)
            assert row["previous_Motor_current"] == (before["Motor_current"] if same else None)


def test_coverage_follows_the_observed_cadence(spark):
    rows = build(telemetry(spark, range(0, 7200, 10)), WindowPolicy()).collect()
    assert len(rows) == 3
    assert {r["cadence_seconds"] for r in rows} == {10.0} and min(r["rows"] for r in rows) >= 288


def test_out_of_range_row_is_quarantined(spark):
    flagged = validate(coerce(telemetry(spark, range(100), {3: {"Oil_temperature": 999.0}}), SPEC), SPEC)
    assert valid_rows(flagged).count() == 99
    assert [r["reasons"] for r in quarantined_rows(flagged).collect()] == [["Oil_temperature_out_of_range"]]


def test_repeats_are_judged_before_validity(spark):
    df = telemetry(spark, [0, 1, 1, 2], {1: {"TP2": 99.0}})
    flagged = validate(coerce(df, SPEC), SPEC)
    assert sorted(r["row_order"] for r in quarantined_rows(flagged).collect()) == [1, 2]


def test_many_copies_and_missing_stamps(spark):
    seconds = [0] * 300 + list(range(1, 101))
    df = telemetry(spark, seconds, {i: {"timestamp": None} for i in range(350, 400)})
    flagged = validate(coerce(df, SPEC), SPEC)
    assert flagged.count() == 400
    assert flagged.where("duplicate_timestamp").count() == 299
    assert flagged.where("array_contains(reasons, 'timestamp_missing')").count() == 50
    report = validation_report(flagged, segment_profile(assign_segments(valid_rows(flagged), SPEC, 30), SPEC)).first()
    assert (report["input_rows"], report["valid_rows"], report["segments"]) == (400, 51, 1)


def test_flag_and_reasons_agree(spark):
    df = telemetry(spark, [0, 0, 1, 2, 3, 4], {2: {"timestamp": None}, 3: {"TP2": None}, 4: {"COMP": None}})
    flagged = validate(coerce(df, SPEC), SPEC)
    assert flagged.where("is_valid <> (size(reasons) = 0)").count() == 0 and flagged.where("is_valid").count() == 2


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="COMP"):
        validate(telemetry(spark, [0]).drop("COMP"), SPEC)


def test_nan_counts_as_missing(spark):
    df = telemetry(spark, range(4), {1: {"TP3": float("nan")}, 2: {"COMP": 2.0}})
    reasons = {r["row_order"]: r["reasons"] for r in quarantined_rows(validate(coerce(df, SPEC), SPEC)).collect()}
    assert reasons == {1: ["TP3_out_of_range"], 2: ["COMP_not_binary"]}


def test_rate_uses_elapsed_time_not_row_count(spark):
    dense = build(telemetry(spark, [0, 600, 1800], {0: {"TP2": 2.0}, 1: {"TP2": 4.0}, 2: {"TP2": 8.0}}), WindowPolicy(3600, 3600, 3600, 0.1))
    sparse = build(telemetry(spark, [0, 1800], {0: {"TP2": 2.0}, 1: {"TP2": 8.0}}), WindowPolicy(3600, 3600, 3600, 0.1))
    # Both segments are shorter than a window, so look at the raw aggregates of a longer tail.
    assert dense.count() == 0 and sparse.count() == 1
    assert sparse.first()["TP2_roc_per_hour"] == pytest.approx(12.0)
    longer = telemetry(spark, [0, 600, 1800, 3700], {0: {"TP2": 2.0}, 1: {"TP2": 4.0}, 2: {"TP2": 8.0}})
    assert build(longer, WindowPolicy(3600, 3600, 3600, 0.1)).first()["TP2_roc_per_hour"] == pytest.approx(12.0)


def test_windows_without_elapsed_time_are_found_and_can_fail(spark):
    policy = WindowPolicy(600, 600, 3600, 0.1)
    windows = build(telemetry(spark, [0, 600, 1200, 1800]), policy)
    assert degenerate_windows(windows, SPEC).count() == windows.count() > 0
    with pytest.raises(Exception, match="span no time"):
        require_rates(windows, SPEC).collect()


def naive_windows(seconds, values, policy, cadence):
    found, start = [], seconds[0]
    while start + policy.window_seconds <= seconds[-1] + cadence:
        inside = [(s, v) for s, v in zip(seconds, values) if start <= s < start + policy.window_seconds]
        expected = max(1, round(policy.window_seconds / cadence))
        if len(inside) >= max(1, int(np.floor(expected * policy.min_coverage))):
            v = np.array([x for _, x in inside])
            found.append((start - seconds[0], len(inside), v.mean(), v.std(), np.abs(np.diff(v)).mean()))
        start += policy.step_seconds
    return found


@pytest.mark.parametrize("policy", [WindowPolicy(600, 300, 60, 0.5), WindowPolicy(500, 200, 60, 0.5), WindowPolicy(300, 700, 60, 0.5)])
def test_windows_equal_a_naive_loop(spark, policy):
    rng = np.random.default_rng(11)
    seconds = np.cumsum(rng.integers(1, 50, 400)).tolist()
    values = rng.uniform(0, 20, 400).round(3).tolist()
    df = telemetry(spark, seconds, {i: {"Motor_current": v} for i, v in enumerate(values)})
    rows = build(df, policy).orderBy("window_start").collect()
    positive = np.diff(seconds)
    expected = naive_windows(seconds, values, policy, float(np.median(positive)))
    first = START + timedelta(seconds=seconds[0])
    got = [((r["window_start"] - first).total_seconds(), r["rows"], r["Motor_current_mean"], r["Motor_current_std"], r["motor_current_volatility"]) for r in rows]
    assert len(got) == len(expected) > 5
    np.testing.assert_allclose(np.array(got), np.array(expected), rtol=1e-9)


def test_thirty_eight_features(spark):
    windows = build(telemetry(spark, range(0, 7200, 10)), WindowPolicy())
    assert len(feature_columns(windows)) == 38 and set(feature_columns(windows)) == set(SPEC.feature_names)


def test_cadence_profile_in_arrival_order(spark):
    df = telemetry(spark, [0, 10, 20, 15, 15, 40, 50], {1: {"timestamp": None}})
    row = cadence_summary(coerce(df, SPEC), "timestamp", ["row_order"]).first()
    assert (row["parsed"], row["unparseable"], row["duplicate_timestamps"], row["non_increasing_adjacent_pairs"]) == (6, 1, 1, 2)
    assert row["max"] == 25.0 and row["median_seconds"] == 17.5
    gaps = common_gaps(coerce(df, SPEC), "timestamp", ["row_order"])
    assert [(r["gap_seconds"], r["count"]) for r in gaps.collect()] == [(10.0, 1), (25.0, 1)]


@pytest.mark.parametrize("per_octave", [1, 64, 65536])
def test_percentiles_equal_numpy(spark, per_octave):
    rng = np.random.default_rng(3)
    values = {"wide": rng.normal(0, 1e6, 500), "ties": rng.integers(-3, 4, 500).astype(float),
              "tiny": rng.uniform(-1e-300, 1e-300, 101), "hot": np.array([5.0] * 400 + [1.0, 9.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("wide", None)]
    probabilities = {"a": 0.0, "b": 0.001, "c": 0.25, "d": 0.5, "e": 0.999, "f": 1.0}
    found = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probabilities, "n", per_octave=per_octave)
    for row in found.collect():
        vs = values[row["k"]]
        assert row["n"] == len(vs)
        np.testing.assert_allclose([row[c] for c in probabilities], np.percentile(vs, [100 * p for p in probabilities.values()]), rtol=1e-12, atol=0)


def test_magnitude_buckets_never_decrease(spark):
    values = sorted([0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, float("inf"), float("-inf"), *np.random.default_rng(1).normal(0, 100, 300).tolist()])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    buckets = [r[0] for r in rows.orderBy("i").select(magnitude_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_sensor_percentiles_skip_empty_sensors(spark):
    df = coerce(telemetry(spark, range(50)), SPEC).withColumn("H1", F.lit(None).cast("double"))
    rows = {r["sensor"]: r for r in sensor_percentiles(df, list(SPEC.analogue)).collect()}
    assert "H1" not in rows and len(rows) == 6 and rows["TP3"]["p50"] == 8.0
    approximate = sensor_percentiles(df, ["TP3"], approximate=True).first()
    assert approximate["p99_9"] == 8.0


def test_missing_counts_only_affected_columns(spark):
    df = telemetry(spark, range(5), {0: {"TP2": None}, 1: {"TP2": float("nan")}})
    assert [(r["column_name"], r["missing"]) for r in missing_counts(df).collect()] == [("TP2", 2)]


def audit(spark, df, policy=WindowPolicy(1200, 600), boundary="2020-02-01 02:00:00", failures=(("2020-02-01 03:00:00", "2020-02-01 04:00:00", "x"),)):
    return audit_tables(df, SPEC, policy, failures, (1, 3), boundary)


def test_audit_content(spark):
    seconds = [10 * i + (120 if i >= 750 else 0) for i in range(1500)]
    tables = audit(spark, telemetry(spark, seconds))
    report = audit_report(tables).first()
    assert report["timestamp"]["median_seconds"] == 10.0 and report["segments"] == 2
    assert report["sequence_resampling_candidates"][0]["interval_seconds"] == 10
    assert report["sequence_resampling_candidates"][0]["timesteps_per_window"] == 120
    horizon = report["horizons"][0]
    assert horizon["horizon_hours"] == 1 and horizon["split_error"] is None
    assert horizon["timestamp_intervals_disjoint"] and horizon["train_windows"] > 0 < horizon["test_windows"]


def test_audit_keeps_the_split_problem_as_data(spark):
    tables = audit(spark, telemetry(spark, range(0, 15000, 10)), boundary="2021-01-01 00:00:00")
    errors = {r["split_error"] for r in tables["horizons"].collect()}
    assert errors == {"Fixed holdout boundary 2021-01-01 00:00:00 must leave windows on both sides"}


def test_audit_without_windows(spark):
    tables = audit(spark, telemetry(spark, range(30)), policy=WindowPolicy())
    rows = tables["horizons"].collect()
    assert [r["horizon_hours"] for r in sorted(rows)] == [1, 3]
    assert {r["split_error"] for r in rows} == {"No complete feature windows were produced"}
    assert {r["predictive_windows"] for r in rows} == {0}


def test_audit_is_byte_stable(spark, tmp_path):
    df = telemetry(spark, range(0, 9000, 10))
    texts = []
    for name in ("a", "b"):
        write_audit(audit(spark, df), str(tmp_path / name))
        texts.append(b"".join(p.read_bytes() for part in ("report", "segments") for p in sorted((tmp_path / name / part).glob("part-*.json"))))
    assert texts[0] == texts[1] and b"schema_version" in texts[0]


def test_quarantine_is_written_only_when_needed(spark, tmp_path):
    clean = validate(coerce(telemetry(spark, range(10)), SPEC), SPEC)
    assert not write_quarantine(quarantined_rows(clean), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    dirty = validate(coerce(telemetry(spark, range(10), {2: {"TP2": 50.0}}), SPEC), SPEC)
    assert write_quarantine(quarantined_rows(dirty), str(tmp_path / "some"), "csv")
    assert spark.read.csv(str(tmp_path / "some"), header=True).count() == 1


def test_report_is_counted_while_rows_are_written(spark, tmp_path):
    dirty = validate(coerce(telemetry(spark, [*range(10), 3, 3], {2: {"TP2": 50.0}}), SPEC), SPEC)
    report = validation_report(dirty, segment_profile(assign_segments(valid_rows(dirty), SPEC, 30), SPEC)).first().asDict()
    report.pop("segments")
    assert write_validated(dirty, str(tmp_path / "rows")) == report and report["duplicate_timestamps"] == 2
    stored = read_validated(spark, str(tmp_path / "rows"))
    assert sorted(stored.where("is_valid").select("TP2").collect()) == sorted(valid_rows(dirty).select("TP2").collect())
    assert stored.where("NOT is_valid").count() == report["quarantined_rows"]
    nothing = write_validated(dirty.limit(0), str(tmp_path / "none"))
    assert set(nothing.values()) == {0}


def test_csv_scan_keeps_rows_order_and_bad_cells(spark, tmp_path):
    lines = ["timestamp," + ",".join(SPEC.channels)]
    lines += [f"2020-02-01 00:00:{s:02d}" + ",1,1,1,1,1,1,1,1" for s in range(5)]
    lines += ["oops,1,1,1,1,1,1,1,1", "2020-02-01 00:00:09,bad,1,1,1,1,1,1,1", "2020-02-01 00:00:01,1,1,1,1,1,1,1,1"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    spec = SPEC.__class__()
    raw = scan_csv(spark, str(tmp_path / "t.csv"), spec)
    flagged = validate(coerce(raw, spec, "yyyy-MM-dd HH:mm:ss"), spec)
    assert flagged.count() == 8
    assert sorted(tuple(r["reasons"]) for r in quarantined_rows(flagged).collect()) == [
        ("TP2_out_of_range",), ("duplicate_timestamp",), ("timestamp_missing",)]
    with pytest.raises(Exception):
        scan_csv(spark, str(tmp_path / "absent.csv"), spec).count()


def test_parquet_scan_numbers_rows(spark, tmp_path):
    telemetry(spark, range(20)).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = scan_parquet(spark, str(tmp_path / "p")).drop("row_order").count(), scan_parquet(spark, str(tmp_path / "p"))
    assert rows[0] == 20


def test_fingerprint_ignores_order_but_not_copies(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    same = df.orderBy(F.desc("a")).repartition(7)
    twice = df.unionByName(df.where("a = 3")).unionByName(df.where("a = 3"))
    prints = [table_fingerprint(d).first()["fingerprint"] for d in (df, same, twice)]
    assert prints[0] == prints[1] != prints[2]


def test_resampling_candidates_start_at_the_observed_step(spark):
    rows = resampling_candidates(spark.createDataFrame([(9.2,)], "median_seconds double"), 1200)
    assert [(r[0], r[1]) for r in rows.collect()] == [(10, 120), (30, 40), (60, 20)]


def test_published_failures_are_half_open():
    assert len(FAILURES) == 4 and FAILURES[1][0] == "2020-05-29 23:30:00"
