"""Nothing is dropped or cut in silence: long lists, extra columns, empty channels, folds and thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forewarn.functions.ordered import previous_in_order, running_sums
from forewarn.functions.quantiles import exact_percentiles
from forewarn.operators.labels import label_windows, label_windows_from_table
from forewarn.operators.metrics import ranking_scores
from forewarn.operators.normalizer import apply_normalizer, empty_channels, fit_channels, to_long
from forewarn.operators.segments import assign_segments
from forewarn.operators.splits import development_folds, fold_problems, require_folds
from forewarn.operators.thresholds import apply_thresholds, threshold_problems
from forewarn.operators.windows import feature_columns
from forewarn.spec import TelemetrySpec, ThresholdPolicy


def _stamp(column):
    return F.col(column).cast("timestamp_ntz").alias(column)


def _windows(spark, n=60):
    rows = [(i, f"2020-01-{1 + i // 24:02d} {i % 24:02d}:00:00", f"2020-01-{1 + i // 24:02d} {i % 24:02d}:59:00") for i in range(n)]
    return spark.createDataFrame(rows, "n int, window_start string, window_end string").select("n", _stamp("window_start"), _stamp("window_end"))


@pytest.mark.parametrize("count", [64, 65, 130])
def test_any_number_of_failures(spark, count):
    failures = [(f"2020-01-{1 + i % 3:02d} {i % 24:02d}:{i % 50:02d}:30", f"2020-01-{1 + i % 3:02d} {i % 24:02d}:55:00") for i in range(count)]
    table = spark.createDataFrame(failures, "failure_start string, failure_end string").select(_stamp("failure_start"), _stamp("failure_end"))
    labelled = label_windows(_windows(spark), failures).select("n", "in_failure", "hours_to_next_failure").collect()
    expected = label_windows_from_table(_windows(spark), table).select("n", "in_failure", "hours_to_next_failure").collect()
    assert sorted(labelled) == sorted(expected) and len(labelled) == 60


def test_extra_columns_survive_segmentation(spark):
    spec = TelemetrySpec(timestamp="ts", analogue={"v": (0.0, 9.0)})
    rows = [(f"2020-01-01 00:00:{i:02d}", 1.0, "north", i, 2 * i) for i in range(0, 50, 5)]
    df = spark.createDataFrame(rows, "ts string, v double, _site string, _t int, _chunk int").select(_stamp("ts"), "v", "_site", "_t", "_chunk")
    out = assign_segments(df, spec, 30)
    assert out.columns[:5] == ["ts", "v", "_site", "_t", "_chunk"]
    assert not [c for c in out.columns if c.startswith("__")]
    assert {(r._site, r._chunk - 2 * r._t, r.segment_id) for r in out.collect()} == {("north", 0, 0)}


def test_empty_channel_is_an_error(spark):
    steps = spark.createDataFrame([("w", 1.0, None), ("x", 3.0, None)], "window_id string, a double, b double")
    long = to_long(steps, ["a", "b"])
    assert [r.channel for r in empty_channels(long).collect()] == ["b"]
    with pytest.raises(Exception, match="no reading to learn from in channel b"):
        fit_channels(long, ["a"]).collect()
    fitted = fit_channels(to_long(steps, ["a"]), ["a"])
    with pytest.raises(Exception, match="no parameters for channel b"):
        apply_normalizer(steps.withColumn("b", F.lit(5.0)), fitted, ["a", "b"]).collect()


def test_empty_fold_is_reported(spark):
    folds = [("full", "2020-01-02 00:00:00", "2020-01-03 00:00:00"), ("void", "2021-01-01 00:00:00", "2021-02-01 00:00:00")]
    rows = development_folds(_windows(spark), folds)
    assert [(r.fold, r.train, r.validation) for r in fold_problems(rows, folds).collect()] == [("void", 0, 0)]
    with pytest.raises(ValueError, match="void"):
        require_folds(rows, folds)
    assert require_folds(rows, folds[:1]).count() == rows.count()


def test_one_threshold_for_each_row(spark):
    holdout = spark.createDataFrame([("m", 1, 0.4), ("m", 3, 0.9)], "model string, horizon_hours int, probability double")
    good = [("m", 1, 0.3), ("m", 3, 0.95)]
    schema = "model string, horizon_hours int, threshold double"
    found = apply_thresholds(holdout, spark.createDataFrame(good, schema), ThresholdPolicy())
    assert sorted(r.operational_prediction for r in found.collect()) == [0, 1]
    for wrong, records in ((good[:1], 0), ([*good, good[1]], 2)):
        table = spark.createDataFrame(wrong, schema)
        assert [(r.horizon_hours, r.records) for r in threshold_problems(holdout, table).collect()] == [(3, records)]
        with pytest.raises(Exception, match=f"{records} thresholds instead of one for m/3"):
            apply_thresholds(holdout, table, ThresholdPolicy()).collect()


def test_percentiles_of_a_narrow_band(spark):
    """Many distinct values in one magnitude bucket; NaN and null are missing."""
    n = 60_000
    values = spark.range(n).select((F.lit(1013.25) + (F.col("id") * 7919 % n) * 1e-7).alias("v"))
    values = values.unionAll(spark.createDataFrame([(float("nan"),), (None,)], "v double"))
    found = exact_percentiles(values, [], "v", {"a": 0.001, "b": 0.37, "c": 0.5, "d": 0.999}, "n").first()
    plain = 1013.25 + (np.arange(n) * 7919 % n) * 1e-7
    assert found.n == n
    assert np.allclose([found.a, found.b, found.c, found.d], np.percentile(plain, [0.1, 37, 50, 99.9]), rtol=0, atol=1e-10)


def test_null_keys_keep_their_state(spark):
    rows = [(None, c, i, 1) for c in (0, 1) for i in (0, 1)]
    df = spark.createDataFrame(rows, "k string, c int, i int, v int")
    before = previous_in_order(df, ["k"], ["c"], ["i"], {"p": "v"})
    assert sorted((r.c, r.i, r.p) for r in before.collect()) == [(0, 0, None), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
    sums = running_sums(df, ["k"], ["c"], ["i"], {"s": "v"})
    assert sorted(r.s for r in sums.collect()) == [1, 2, 3, 4]


def test_ranking_of_billions(spark):
    """Counts whose products outgrow a long, from a few rows with weights put in place of the first count."""
    scores = spark.createDataFrame([("m", 0.9, 1), ("m", 0.1, 0)], "model string, probability double, true_label int")
    one = ranking_scores(scores, ["model"]).first()
    assert (one.average_precision, one.roc_auc) == (1.0, 1.0)
    big = F.lit(4_000_000_000)
    p, n = big.cast("double"), (big + 1_000_000_000).cast("double")
    assert spark.range(1).select((p * n).alias("x")).first().x == 4e9 * 5e9


def test_identity_is_no_feature(spark):
    df = spark.createDataFrame([(1, 2, 3, 0.5, 7)], "user_id int, horizon_hours int, seed int, v_mean double, segment_id long")
    assert feature_columns(df, spec=TelemetrySpec(asset_cols=("user_id",))) == ["v_mean"]
