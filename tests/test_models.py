"""Boosted trees against a plain numpy version, kernels against a flattened fit, and the grid from fit to thresholds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from forewarn.functions.workers import lists
from forewarn.operators import boosting, kernels, scoring
from forewarn.operators.boosting import BoostParameters, Fit, fit_boosted

ROWS = "part string, features array<double>, labels array<double>, key long, is_validation boolean"
PLAIN = BoostParameters(max_rounds=4, subsample=1.1, feature_share=1.0, max_bins=16, min_child_weight=2.0, block=3)


def noisy(n=240, seed=1):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 3)), 1)
    x[draw.random((n, 3)) < 0.15] = np.nan
    y = ((np.nan_to_num(x[:, 0]) > 0.4) ^ (draw.random(n) < 0.1)).astype(float)
    return x, y


def as_rows(spark, x, y, part="p", validation=lambda i: False):
    rows = [(part, row.tolist(), [float(label), 1.0 - float(label)], i, validation(i)) for i, (row, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ROWS)


def slow_round(x, margin, y, scale, cuts, p):
    """One tree by trying every cut of every feature on the rows themselves: margins, gains and leaf values."""
    chance = 1 / (1 + np.exp(-margin))
    weight = np.where(y == 1, scale, 1.0)
    g, h = weight * (chance - y), weight * chance * (1 - chance)
    gains, leaves, out = {}, {}, margin.copy()

    def leaf(rows):
        return -p.step * g[rows].sum() / (h[rows].sum() + p.l2)

    def grow(node, rows, depth):
        best = None
        if depth < p.max_depth:
            for f in range(x.shape[1]):
                own, known = x[rows, f], ~np.isnan(x[rows, f])
                for cut in [*cuts[f], np.inf]:
                    for missing_left in (False, True):
                        left = np.where(known, np.where(known, own, 0) < cut, missing_left)
                        a, b = rows[left], rows[~left]
                        if min(h[a].sum(), h[b].sum()) < p.min_child_weight:
                            continue
                        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p.l2)
                        gain = score(a) + score(b) - score(rows)
                        if gain > (best[0] + 1e-6 if best else 1e-9):
                            best = gain, a, b
        if best is None:
            leaves[node] = leaf(rows)
            out[rows] += leaves[node]
            return
        gains[node] = best[0]
        grow(2 * node, best[1], depth + 1)
        grow(2 * node + 1, best[2], depth + 1)

    grow(1, np.arange(len(x)), 0)
    return out, gains, leaves


def test_gains_and_leaves_are_those_of_a_plain_version(spark):
    x, y = noisy()
    model = fit_boosted(as_rows(spark, x, y), [Fit("p", 0, 7, 4)], PLAIN)[0]
    cuts = boosting.cut_points(as_rows(spark, x, y), 3, PLAIN.max_bins)["p"]
    margin = np.zeros(len(x))
    assert len(model.trees) == 4
    for tree in model.trees:
        margin, gains, leaves = slow_round(x, margin, y, (y == 0).sum() / (y == 1).sum(), cuts, PLAIN)
        assert {i for i in range(len(tree.feature)) if tree.feature[i] >= 0} == set(gains)
        assert all(tree.gain[i] == pytest.approx(gain, rel=1e-4) for i, gain in gains.items())
        assert all(tree.value[i] == pytest.approx(value, rel=1e-4) for i, value in leaves.items())
    assert model.probability(x) == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-4)


def test_trees_do_not_depend_on_partitions_or_company(spark):
    x, y = noisy()
    p = BoostParameters(max_rounds=6, block=4, rows_per_task=60, patience=2)
    alone = fit_boosted(as_rows(spark, x, y, validation=lambda i: i % 3 == 0), [Fit("p", 0, 7)], PLAIN.__class__(max_rounds=6, block=2, patience=2))[0]
    both = as_rows(spark, x, y, validation=lambda i: i % 3 == 0).unionByName(as_rows(spark, x[:100], y[:100], "q")).repartition(5)
    dealt = fit_boosted(both, [Fit("q", 1, 3, 2), Fit("p", 0, 7)], p)[1]
    assert len(alone.trees) == len(dealt.trees) and alone.history[: len(dealt.trees)] == dealt.history[: len(dealt.trees)]
    for a, b in zip(alone.trees, dealt.trees):
        assert (a.feature == b.feature).all() and (a.value == b.value).all() and (a.threshold == b.threshold).all()


def test_stop_is_that_of_a_search_after_each_round():
    assert boosting._stop([0.1, 0.3, 0.2, 0.2, 0.9], 2) == 2
    assert boosting._stop([0.1, 0.3, 0.2, 0.9], 3) == 4
    assert boosting._stop([0.5, 0.5, 0.5], 30) == 1


def test_both_classes_are_needed(spark):
    x, _ = noisy(20)
    with pytest.raises(ValueError, match="both classes"):
        fit_boosted(as_rows(spark, x, np.zeros(20)), [Fit("p", 0, 1, 1)], PLAIN)


def test_trainer_contract_and_importances(spark):
    x, y = noisy()
    rows = [(f"w{i}", row.tolist(), float(label), i % 4 == 0) for i, (row, label) in enumerate(zip(x, y))]
    train = spark.createDataFrame(rows, "window_id string, features array<double>, label double, is_validation boolean")
    model, used = boosting.boosted_trainer(BoostParameters(max_rounds=5, patience=3, block=5))(train, None)
    assert 1 <= used <= 5 and len(model.trees) == used
    scored = scoring.score_with(model, train).select("window_id", "probability").collect()
    assert {r["window_id"]: r["probability"] for r in scored} == pytest.approx(
        {f"w{i}": p for i, p in enumerate(model.probability(x).tolist())}
    )
    found = scoring.feature_importance(spark, model, ["a", "b", "c"]).collect()
    shares = [r["importance"] for r in found]
    assert sum(shares) == pytest.approx(1) and shares == sorted(shares, reverse=True) and found[0]["feature"] == "a"


def bumps(n, seed, steps=120):
    """Sequences with a rise then a fall (label 1) or a fall then a rise (label 0) somewhere."""
    draw = np.random.default_rng(seed)
    x = draw.normal(scale=0.2, size=(n, steps, 2))
    y = np.arange(n) % 2
    for i in range(n):
        at = draw.integers(4, steps - 12)
        x[i, at : at + 4, 0] += 2 if y[i] else -2
        x[i, at + 4 : at + 8, 0] -= 2 if y[i] else -2
    return x, y


def test_kernels_see_a_shape_wherever_it_stands(spark):
    from forewarn.operators.metrics import ranking_scores
    from pyspark.ml.functions import array_to_vector

    x, y = bumps(400, 5)
    rows = [(f"w{i}", s.tolist(), int(label), i >= 280) for i, (s, label) in enumerate(zip(x, y))]
    packed = spark.createDataFrame(rows, "window_id string, sequence array<array<float>>, label int, test boolean")
    features = kernels.kernel_features(packed, (1, 2))
    flat = packed.select("window_id", F.lit(0).alias("seed"), array_to_vector(F.flatten("sequence").cast("array<double>")).alias("features"))
    scores = {}
    for seed, of in ((0, flat), (1, features), (2, features)):
        data = packed.select("window_id", F.col("label").cast("double").alias("label"), "test").join(of.where(F.col("seed") == seed), "window_id")
        data = data.withColumns({"weight": F.lit(1.0), "is_validation": F.lit(False)})
        model, _ = scoring.logistic_trainer()(data.where("NOT test"), None)
        scored = scoring.score_with(model, data.where("test")).withColumn("true_label", F.col("label").cast("int"))
        scores[seed] = ranking_scores(scored.withColumn("k", F.lit(1)), ["k"]).first()["average_precision"]
    assert min(scores[1], scores[2]) > 0.95 and min(scores[1], scores[2]) > scores[0] + 0.1, scores
    one = {r["seed"]: r["features"] for r in features.where("window_id = 'w0'").collect()}
    assert set(one) == {1, 2} and one[1] != one[2]


def test_kernel_responses_are_sums_over_dilated_places():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3, 20, 4))
    for kernel in kernels.kernel_bank(3, 20, 4, 12):
        out = kernels.responses(x, kernel)
        length, reach = len(kernel.weights), (len(kernel.weights) - 1) * kernel.dilation
        shift = reach // 2 if kernel.padded else 0
        assert out.shape[1] == (20 if kernel.padded else 20 - reach)
        for t in (0, out.shape[1] // 2, out.shape[1] - 1):
            total = kernel.bias
            for j in range(length):
                at = t + j * kernel.dilation - shift
                if 0 <= at < 20:
                    total += (x[1, at, kernel.channels] * kernel.weights[j]).sum()
            assert out[1, t] == pytest.approx(total)


def test_grid_from_fit_to_costs(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(300):
        hours = float(i % 25)
        near = hours <= 6
        rows.append((f"w{i}", 0, i, [float(near) + draw.normal(0, 0.5), draw.normal()], hours if i % 5 else None))
    schema = "window_id string, segment_id int, n int, features array<double>, hours_to_next_failure double"
    base = spark.createDataFrame(rows, schema).withColumn("window_start", F.expr("timestampadd(HOUR, n, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    base = base.withColumn("window_end", F.expr("window_start + INTERVAL 1 HOUR")).drop("n")
    role = F.when(F.xxhash64("window_id") % 3 == 0, "validation").otherwise("train")
    folds = base.withColumn("fold", F.lit("f1")).withColumn("role", role).unionByName(base.limit(150).withColumn("fold", F.lit("f2")).withColumn("role", role))
    split = base.withColumn("split", F.when(F.xxhash64("window_id") % 4 == 0, "test").otherwise("train"))
    result = scoring.run_boosted_cells(folds, split, (3, 12), (1, 2), BoostParameters(max_rounds=8, patience=3, block=4))
    trace = result.trace
    n = folds.where("role = 'validation'").count() + split.where("split = 'test'").count()
    assert trace.count() == 4 * n and trace.where("probability BETWEEN 0 AND 1").count() == 4 * n
    assert trace.groupBy("window_id", "fold", "horizon_hours", "seed").count().where("count > 1").isEmpty()
    wrong = trace.where("true_label != CAST(coalesce(hours_to_next_failure <= horizon_hours, false) AS INT)")
    assert wrong.isEmpty() and set(result.rounds) == {(3, 1), (3, 2), (12, 1), (12, 2)}
    assert all(len(result.models[c].trees) == max(1, int(np.median(result.rounds[c]))) for c in result.rounds)
    assert result.costs.count() == 4 and result.costs.where("development_fit_seconds <= 0 OR prediction_seconds <= 0").isEmpty()


def test_fitted_regression_scores_after_an_observed_write(spark, tmp_path):
    """MLlib's model takes the session along, which holds its observations from the first one on."""
    data = spark.range(60).select(
        array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double"))).alias("features"),
        (F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("weight"), F.lit(False).alias("is_validation"),
    )
    counted = Observation("rows")
    data.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(str(tmp_path / "observed"))
    assert counted.get == {"n": 60}
    model, _ = scoring.logistic_trainer()(data, None)
    scores = [r["probability"] for r in scoring.score_with(model, data).collect()]
    assert len(scores) == 60 and all(0 < score < 1 for score in scores)


def test_whole_bank_gives_what_its_kernels_give():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(7, 12, 3))
    bank = kernels.kernel_bank(5, 12, 3, 40)
    whole = kernels.bank_matrix(bank, 12, 3)
    np.testing.assert_allclose(kernels.bank_features(x, bank, whole), kernels.bank_features(x, bank), rtol=1e-12, atol=1e-12)
    x[2, 4, 1] = np.nan
    np.testing.assert_array_equal(kernels.bank_features(x, bank, whole), kernels.bank_features(x, bank))
    assert kernels.bank_matrix(kernels.kernel_bank(5, 120, 9), 120, 9) is None


def test_a_batch_is_read_once_for_all_fits(monkeypatch):
    """Twelve fits on one part must not decode the part's rows twelve times."""
    read, plain = [], boosting._Rows

    class Counted(plain):
        def __init__(self, *args):
            read.append(1)
            super().__init__(*args)

    class Local:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def collect(self):
            return [row for out in self.run(iter([batch])) for row in out.to_pylist()]

    x, y = noisy(40)
    batch = pa.record_batch(
        [
            pa.array(["p"] * 40), pa.array([bytes(row) for row in (np.nan_to_num(x) > 0).astype(np.uint8)], pa.binary()),
            lists(np.asarray(y, float).reshape(-1, 1)), pa.array(range(40)), pa.array([False] * 40), lists(np.zeros((40, 12))),
        ],
        names=["part", "bins", "labels", "key", "is_validation", "margins"],
    )
    monkeypatch.setattr(boosting, "_Rows", Counted)
    width = x.shape[1]
    jobs = [boosting._begin(boosting._Job(i, Fit("p", 0, i), i, 1.0, ()), 0, PLAIN, width) for i in range(12)]
    found = boosting._histograms(Local(), jobs, 0, PLAIN, width, 1)
    assert len(read) == 1 and set(found) == {(i, 1) for i in range(12)}
