import random

import pytest
from pyspark.sql import functions as F

from forewarn.operators.checks import fold_problems
from forewarn.operators.labels import label_horizon, label_windows, label_windows_from_table
from forewarn.operators.regimes import regime, regime_effects, regime_summary
from forewarn.operators.splits import chronological_split, development_folds, purge_overlap, split_bounds
from tests.fixtures import at, windows

FAILURE = (("2020-02-01 10:00:00", "2020-02-01 12:00:00", "leak"),)


def one(spark, start, end, horizon=1):
    return label_horizon(label_windows(windows(spark, [(start, end)]), FAILURE), horizon).first()


def test_window_over_the_end_of_a_failure_is_active(spark):
    assert one(spark, 11.5, 12.5)["in_failure"]


def test_window_that_ends_at_the_onset_is_a_positive_at_zero_hours(spark):
    row = one(spark, 9, 10)
    assert (row["in_failure"], row["failure_within_horizon"], row["hours_to_next_failure"]) == (False, 1, 0.0)


def test_window_that_starts_at_the_end_is_past_the_failure(spark):
    row = one(spark, 12, 13)
    assert (row["in_failure"], row["failure_within_horizon"], row["hours_to_next_failure"]) == (False, 0, None)


def test_negative_horizon_is_refused(spark):
    with pytest.raises(ValueError, match="non-negative"):
        one(spark, 1, 2, -1)


@pytest.mark.parametrize("chunk", [3600, 5 * 3600, 10**7])
def test_table_labels_equal_brute_force(spark, chunk):
    rng = random.Random(4)
    spans = [(h / 4, h / 4 + 1) for h in rng.sample(range(400), 120)]
    intervals = [(a, a + rng.choice([0.25, 1, 6])) for a in (rng.randrange(400) / 4 for _ in range(25))]
    failures = spark.createDataFrame([("m", at(a), at(b)) for a, b in intervals], "asset string, failure_start timestamp_ntz, failure_end timestamp_ntz")
    # A second machine's failures must not leak into the first.
    failures = failures.unionByName(failures.withColumn("asset", F.lit("other")).limit(3))
    found = label_windows_from_table(windows(spark, spans, asset="m"), failures, ["asset"], chunk)
    got = sorted((r["window_start"], r["in_failure"], r["hours_to_next_failure"]) for r in found.collect())
    expected = []
    for start, end in spans:
        active = any(a < end and b > start for a, b in intervals)
        following = [a - end for a, _ in intervals if a >= end]
        expected.append((at(start), active, min(following) if following else None))
    assert got == sorted(expected, key=lambda r: r[0])


def test_split_is_chronological_and_purged(spark):
    rows = chronological_split(windows(spark, [(h, h + 1) for h in range(10)]), "2020-02-01 08:00:00").collect()
    sides = {s: [r for r in rows if r["split"] == s] for s in ("train", "test", "purged")}
    assert len(sides["train"]) == 7 and len(sides["test"]) == 3
    assert max(r["window_end"] for r in sides["train"]) <= min(r["window_start"] for r in sides["test"])


def test_overlapping_windows_are_purged(spark):
    spans = [(h / 2, h / 2 + 1) for h in range(10)]
    split = chronological_split(windows(spark, spans), "2020-02-01 04:30:00")
    assert split.where("split = 'train'").count() == 6
    bounds = split_bounds(split, [], "split", "train", "test").first()
    assert bounds["timestamp_intervals_disjoint"]


def test_split_ignores_labels(spark):
    spans = [(48 * h, 48 * h + 1) for h in range(40)]
    sides = []
    for label in (0, 1):
        df = windows(spark, spans, failure_within_horizon=label)
        sides.append(sorted((r["window_start"], r["split"]) for r in chronological_split(df, "2020-03-20 00:00:00").collect()))
    assert sides[0] == sides[1]


def test_purge_per_asset(spark):
    train = windows(spark, [(0, 1), (4, 5)], asset="a").unionByName(windows(spark, [(0, 1), (4, 5)], asset="b"))
    test = windows(spark, [(4.5, 5.5)], asset="a")
    assert purge_overlap(train, test, ["asset"]).count() == 3
    assert purge_overlap(train, test.drop("asset").withColumn("asset", F.lit("a"))).count() == 2


def test_folds_exclude_the_onset_window_and_purge(spark):
    df = windows(spark, [(h / 2, h / 2 + 1) for h in range(40)])
    folds = development_folds(df, [("f", "2020-02-01 10:00:00", "2020-02-01 12:00:00")])
    rows = folds.collect()
    validation = [r for r in rows if r["role"] == "validation"]
    assert max(r["window_end"] for r in validation) == at(11.5)
    assert max(r["window_end"] for r in rows if r["role"] == "train") <= min(r["window_start"] for r in validation)


def test_fold_table_check(spark):
    rows = [("a", at(0), at(5)), ("b", at(4), at(8)), ("c", at(9), at(99))]
    folds = spark.createDataFrame(rows, "fold string, validation_start timestamp_ntz, validation_end timestamp_ntz")
    problems = {r["fold"]: r["problem"] for r in fold_problems(folds, "2020-02-02 00:00:00").collect()}
    assert problems["a"] is None and "begins inside" in problems["b"] and "reaches the holdout" in problems["c"]


def test_regime_names_and_exclusion_quirk(spark):
    onsets = (("first", "2020-02-05 00:00:00"), ("second", "2020-02-15 00:00:00"))
    hours = {"lead": 96, "near": 96 - 30, "early": 96 - 60, "second_near": 96 + 240 - 30}
    df = windows(spark, [(h - 1, h) for h in hours.values()])
    for strict, expected in ((False, "normal"), (True, "near_failure_excluded")):
        found = {r["window_end"]: r["regime"] for r in df.withColumn("regime", regime(onsets, strict=strict)).collect()}
        assert found[at(hours["lead"])] == "first" and found[at(hours["near"])] == "near_failure_excluded"
        assert found[at(hours["early"])] == "normal" and found[at(hours["second_near"])] == expected


def test_effects_and_direction(spark):
    onsets = (("a", "x"), ("b", "x"), ("c", "x"))
    rows = [("normal", float(v), 1.0) for v in (0, 1, 2, 3, 4)] + [("a", 8.0, 1.0), ("b", 6.0, 1.0), ("c", 4.0, 0.0)]
    effects = regime_effects(spark.createDataFrame(rows, "regime string, f double, flat double"), ["f", "flat"], onsets)
    by = {(r["feature"], r["event"]): r for r in effects.collect()}
    assert by["f", "a"]["robust_standardized_difference"] == 3.0 and by["f", "a"]["normal_iqr"] == 2.0
    assert by["flat", "c"]["robust_standardized_difference"] == -1.0
    summary = {r["feature"]: r for r in regime_summary(effects, ["a", "b", "c", "absent"][:3]).collect()}
    assert summary["f"]["direction_consistency"] == 1.0 and summary["f"]["all_events_same_direction"]
    assert not summary["flat"]["all_events_same_direction"]
    partial = regime_summary(effects.where("event <> 'c'"), ["a", "b", "c"]).first()
    assert partial["c"] is None and partial["direction_consistency"] is None and not partial["all_events_same_direction"]


def _slow_labels(spans, failures):
    out = []
    for asset, start, end in spans:
        own = [(a, b) for m, a, b in failures if m == asset]
        after = [a for a, _ in own if a >= end]
        out.append((asset, start, end, any(a < end and b > start for a, b in own), min(after) - end if after else None))
    return out


@pytest.mark.parametrize("rows_per_slice", [7, 60, 100_000])
def test_as_of_match_where_most_failures_fall_into_one_minute(spark, rows_per_slice):
    import random

    from forewarn.functions.slices import slice_borders, slice_number

    draw = random.Random(3)
    crowded = [10_000_000 + draw.randrange(60) for _ in range(540)]
    failures = [(draw.choice("ab"), t, t + draw.choice([0, 1, 5, 4000])) for t in [*crowded, *(draw.randrange(20_000_000) for _ in range(60))]]
    ends = [draw.choice([10_000_030, draw.randrange(20_000_000), 10_000_000 + draw.randrange(90)]) for _ in range(400)]
    spans = [(draw.choice("ab"), e - draw.choice([1, 30, 3600]), e) for e in ends] + [("c", 5, 9)]
    stamp = "CAST(timestamp_seconds({}) AS TIMESTAMP_NTZ)"

    def table(rows, a, b):
        df = spark.createDataFrame(rows, f"asset string, {a}_s long, {b}_s long")
        return df.select("asset", *[F.expr(stamp.format(f"{c}_s")).alias(c) for c in (a, b)], *([] if a == "failure_start" else [f"{a}_s", f"{b}_s"]))

    windows, broken = table(spans, "window_start", "window_end"), table(failures, "failure_start", "failure_end")
    found = label_windows_from_table(windows, broken, ["asset"], rows_per_slice)
    hours = F.round(F.col("hours_to_next_failure") * 3600).cast("long")
    got = sorted(map(tuple, found.select("asset", "window_start_s", "window_end_s", "in_failure", hours).collect()), key=str)
    assert got == sorted(_slow_labels(spans, failures), key=str)
    # Slices follow the rows, not the clock: none is more than twice as large as it should be.
    times = spark.createDataFrame([(10**9 * t,) for t in range(100)] + [(5 * 10**10 + i,) for i in range(900)], "t long")
    borders = slice_borders(times, "t", 50)
    counts = times.groupBy(slice_number(F.col("t"), borders).alias("s")).count().collect()
    assert len(counts) >= 18 and max(r["count"] for r in counts) <= 100


def test_slice_numbers_count_the_borders_at_or_below(spark):
    from forewarn.functions.slices import slice_number

    borders = [i * i for i in range(200)]
    values = spark.range(-5, 40_100, 7)
    wrong = values.select("id", slice_number(F.col("id"), borders).alias("s"))
    expected = F.when(F.col("id") < 0, 0).otherwise(F.least(F.floor(F.sqrt("id")) + 1, F.lit(200)))
    assert wrong.where(F.col("s") != expected).isEmpty()
    assert spark.range(1).select(slice_number(F.lit(None).cast("long"), borders)).first()[0] == 0
