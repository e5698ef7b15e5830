import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forewarn.operators.normalizer import apply_normalizer, check_training_ids, fit_normalizer, id_fingerprint
from forewarn.operators.sequences import OBSERVED, pack_sequences, resample_windows, sequence_channels, windows_without_source
from forewarn.operators.windows import predictive_windows
from forewarn.spec import SequencePolicy, WindowPolicy
from tests.fixtures import SPEC, telemetry, windows

SEQUENCE = SequencePolicy()


def source(spark, seconds, overrides=None, segment=0):
    return telemetry(spark, seconds, overrides).withColumn("segment_id", F.lit(segment).cast("long"))


def accepted(spark, spans, in_failure=False):
    return predictive_windows(windows(spark, spans, cadence_seconds=10.0, in_failure=in_failure), SPEC)


def test_one_sequence_per_predictive_window(spark):
    rows = source(spark, range(0, 3600, 10), {i: {"COMP": float((i // 3 + 1) % 2)} for i in range(360)})
    kept = accepted(spark, [(0, 1)]).unionByName(accepted(spark, [(0, 1)], in_failure=True))
    packed = pack_sequences(resample_windows(rows, kept, SPEC, SEQUENCE), SPEC, SEQUENCE).collect()
    assert len(packed) == 1
    values = np.array(packed[0]["sequence"], dtype=float)
    channels = sequence_channels(SPEC)
    assert values.shape == (120, 9) and set(values[:, channels.index(OBSERVED)]) == {1.0}
    assert values[:4, channels.index("COMP")].tolist() == [1.0, 0.0, 1.0, 0.0]


def test_segments_do_not_mix(spark):
    rows = source(spark, range(0, 3600, 10), {i: {"TP2": 1.0} for i in range(360)}).unionByName(
        source(spark, range(0, 3600, 10), {i: {"TP2": 9.0} for i in range(360)}, segment=1)
    )
    both = accepted(spark, [(0, 1)]).drop("window_id")
    both = predictive_windows(both.unionByName(both.withColumn("segment_id", F.lit(1).cast("long"))), SPEC)
    found = resample_windows(rows, both, SPEC, SEQUENCE).groupBy("segment_id").agg(F.min("TP2"), F.max("TP2"))
    assert {tuple(r) for r in found.collect()} == {(0, 1.0, 1.0), (1, 9.0, 9.0)}


def test_short_holes_are_filled_and_long_ones_are_not(spark):
    seconds = [s for s in range(0, 3600, 10) if not 300 <= s < 330 and not 600 <= s < 660]
    steps = resample_windows(source(spark, seconds), accepted(spark, [(0, 1)]), SPEC, SEQUENCE)
    row = {r["step"]: r for r in steps.where("step in (10, 20, 21)").collect()}
    assert row[10]["TP3"] == 8.0 and row[20]["TP3"] == 8.0 and row[21]["TP3"] is None and row[21]["COMP"] is None
    assert {row[s][OBSERVED] for s in row} == {0.0}


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_filling_equals_pandas(spark, limit):
    rng = np.random.default_rng(limit)
    seconds = sorted(rng.choice(3600, 110, replace=False).tolist())
    tp2 = rng.uniform(0, 10, len(seconds)).round(2).tolist()
    rows = source(spark, seconds, {i: {"TP2": v, "COMP": float(i % 2)} for i, v in enumerate(tp2)})
    steps = resample_windows(rows, accepted(spark, [(0, 1)]), SPEC, SequencePolicy(30, 120, limit)).orderBy("step").toPandas()
    frame = pd.DataFrame({"bin": [s // 30 for s in seconds], "TP2": tp2, "COMP": [i % 2 for i in range(len(seconds))]})
    means = frame.groupby("bin").mean().reindex(range(120))
    expected = means["TP2"].interpolate(method="linear", limit=limit, limit_area="inside")
    np.testing.assert_allclose(steps["TP2"].astype(float), expected, rtol=1e-9)
    np.testing.assert_allclose(steps["COMP"].astype(float), means["COMP"].ffill(limit=limit), rtol=1e-9)


def test_shared_bins_equal_bins_per_window(spark):
    from forewarn.operators.segments import assign_segments, segment_profile
    from forewarn.operators.windows import window_features

    rng = np.random.default_rng(9)
    seconds = np.cumsum(rng.integers(1, 28, 900)).tolist()
    policy = WindowPolicy(3600, 1800, 30, 0.5)
    readings = telemetry(spark, seconds, {i: {"TP2": float(v)} for i, v in enumerate(rng.uniform(0, 9, 900))})
    segmented = assign_segments(readings, SPEC, 30, carry=(SPEC.volatility,))
    found = window_features(segmented, segment_profile(segmented, SPEC), SPEC, policy).withColumn("in_failure", F.lit(False))
    kept = predictive_windows(found, SPEC)
    columns = ["window_id", "step", "TP2", "COMP", OBSERVED]
    shared = resample_windows(segmented, kept, SPEC, SEQUENCE, policy).select(*columns).orderBy("window_id", "step").toPandas()
    single = resample_windows(segmented, kept, SPEC, SEQUENCE).select(*columns).orderBy("window_id", "step").toPandas()
    assert len(shared) == kept.count() * 120 > 0
    pd.testing.assert_frame_equal(shared, single, rtol=1e-9)


def test_windows_that_cannot_be_resampled_are_named(spark):
    kept = accepted(spark, [(0, 1), (5, 6)])
    lost = kept.where("window_end > timestamp_ntz'2020-02-01 03:00:00'").drop("window_id").withColumn("segment_id", F.lit(7).cast("long"))
    found = windows_without_source(source(spark, range(0, 3600, 10)), kept.unionByName(predictive_windows(lost, SPEC)), SPEC, 3600)
    assert sorted(r["problem"] for r in found.collect()) == ["the segment has no readings", "the window has no readings"]


def steps_table(spark):
    rows = [("a", 0, 1.0, 1.0, 0.5), ("b", 0, 3.0, 0.0, 1.0), ("c", 0, 1000.0, 1.0, 1.0), ("c", 1, None, 0.0, 1.0)]
    return spark.createDataFrame(rows, f"window_id string, step int, TP2 double, COMP double, {OBSERVED} double")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "window_id string")


def test_normaliser_sees_training_windows_only(spark):
    channels = ("TP2", "COMP", OBSERVED)
    fitted = fit_normalizer(steps_table(spark), ids(spark, "a", "b"), channels, ("TP2",))
    row = {r["channel"]: r for r in fitted.collect()}
    assert (row["TP2"]["fallback"], row["TP2"]["mean"], row["TP2"]["scale"]) == (2.0, 2.0, 1.0)
    assert (row["COMP"]["mean"], row["COMP"]["scale"], row["TP2"]["training_windows"]) == (0.0, 1.0, 2)
    done = apply_normalizer(steps_table(spark), fitted, channels)
    by = {(r["window_id"], r["step"]): r for r in done.collect()}
    assert by["c", 1]["TP2"] == 0.0 and by["a", 0]["TP2"] == -1.0
    assert by["a", 0]["COMP"] == 1.0 and by["a", 0][OBSERVED] == 0.5


@pytest.mark.parametrize("names,message", [((), "no training window"), (("a", "a"), "twice"), (("a", "zz"), "no sequence")])
def test_training_ids_are_checked(spark, names, message):
    with pytest.raises(ValueError, match=message):
        check_training_ids(steps_table(spark), ids(spark, *names))


def test_id_fingerprint_ignores_order(spark):
    assert id_fingerprint(ids(spark, "a", "b", "c")).first() == id_fingerprint(ids(spark, "c", "a", "b")).first()


def test_history_must_be_covered(spark):
    with pytest.raises(ValueError, match="make up"):
        resample_windows(source(spark, [0, 1]), accepted(spark, [(0, 1)]), SPEC, SEQUENCE, WindowPolicy(1800, 900))


def test_long_windows_are_filled_in_time_linear_in_their_steps(spark):
    """One window of 40,000 steps against a plain fill; a frame read anew for each step would not end here."""
    import random
    import time

    from forewarn.operators.sequences import fill_short_holes
    from forewarn.spec import TelemetrySpec

    spec = TelemetrySpec(analogue={"a": (0.0, 9.0), "b": (0.0, 9.0)}, digital=("d",), timestamp="ts")
    draw = random.Random(1)
    steps = 40_000
    rows = [("w", i, *[draw.choice([None, draw.random() * 9]) for _ in "ab"], draw.choice([None, 0.0, 1.0])) for i in range(steps)]
    binned = spark.createDataFrame(rows, "window_id string, step int, a double, b double, d double")
    start = time.time()
    got = {r["step"]: r for r in fill_short_holes(binned, spec, 2).select("step", "a", "b", "d").collect()}
    assert time.time() - start < 60
    for place, name in ((2, "a"), (3, "b")):
        known = [i for i in range(steps) if rows[i][place] is not None]
        for left, right in zip(known, known[1:]):
            for i in range(left + 1, right):
                line = rows[left][place] + (rows[right][place] - rows[left][place]) / (right - left) * (i - left)
                want = line if i - left <= 2 else None
                assert (got[i][name] is None) if want is None else abs(got[i][name] - want) < 1e-9
        assert all(got[i][name] is None for i in range(known[-1] + 1, steps))
    for i in range(steps):
        near = next((rows[j][4] for j in (i, i - 1, i - 2) if j >= 0 and rows[j][4] is not None), None)
        assert got[i]["d"] == near
