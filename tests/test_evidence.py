import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forewarn.operators.alerts import alert_runs, false_alert_episodes
from forewarn.operators.checks import domain_check, evidence_errors, evidence_report, experiment_cells, pending_cells, require_domain, require_valid, trace_problems
from forewarn.operators.metrics import eventwise_metrics, in_event_order, policy_metrics, ranking_metrics, ranking_problems, seed_summary
from forewarn.operators.reports import event_timeline, failure_time, filter_rows, policy_summary, require_rows, seed_band, threshold_for
from forewarn.operators.thresholds import apply_thresholds, candidate_thresholds, complete_groups, select_threshold, sweep_thresholds, threshold_records
from forewarn.sources.traces import load_trace, read_thresholds, scan_named_traces
from forewarn.sources.sinks import write_named_traces, write_partitioned
from forewarn.spec import FOLDS, HOLDOUT_FAILURE, EvaluationGrid, ThresholdPolicy
from tests.fixtures import predictions

CELL = ["model", "horizon_hours", "seed"]


def scored(spark, labels, scores):
    return predictions(spark, [(1, "may_failure", 0, i / 2, y, float(p)) for i, (y, p) in enumerate(zip(labels, scores))])


def test_ranking_metrics_of_a_perfect_order(spark):
    row = ranking_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), CELL).first()
    assert (row["average_precision"], row["ap_lift_over_prevalence"], row["roc_auc"]) == (1.0, 2.0, 1.0)
    assert row["median_score_gap"] == pytest.approx(0.7)


def test_ranking_metrics_equal_brute_force_with_ties(spark):
    rng = random.Random(8)
    labels = [int(rng.random() < 0.3) for _ in range(200)]
    scores = [rng.choice([0.0, 1e-14, 0.2, 0.5, 0.5000001, 0.9, rng.random()]) for _ in labels]
    row = ranking_metrics(scored(spark, labels, scores), CELL).first()
    positives = [p for y, p in zip(labels, scores) if y]
    negatives = [p for y, p in zip(labels, scores) if not y]
    average_precision, seen = 0.0, 0
    for cut in sorted(set(scores), reverse=True):
        tp, n = sum(p >= cut for p in positives), sum(p >= cut for p in scores)
        average_precision += (tp - seen) / len(positives) * tp / n
        seen = tp
    auc = sum((a > b) + (a == b) / 2 for a in positives for b in negatives) / len(positives) / len(negatives)
    assert row["average_precision"] == pytest.approx(average_precision) and row["roc_auc"] == pytest.approx(auc)
    assert row["positive_score_median"] == pytest.approx(float(np.median(positives)))


@pytest.mark.parametrize("labels,scores,text", [([0, 0], [0.1, 0.2], "classes is missing"), ([0, 1], [0.1, 1.2], "number from 0 to 1"), ([0, 2], [0.1, 0.2], "neither 0 nor 1")])
def test_unusable_traces_are_described(spark, labels, scores, text):
    assert text in ranking_problems(scored(spark, labels, scores), CELL).first()["problem"]


def test_one_class_gives_null_scores(spark):
    row = ranking_metrics(scored(spark, [0, 0], [0.1, 0.2]), CELL).first()
    assert row["average_precision"] is None and row["roc_auc"] is None


def test_episodes_restart_after_gaps_and_segments(spark):
    rows = [(1, None, 0, 0, 0, 0.9), (1, None, 0, 0.5, 0, 0.9), (1, None, 0, 2, 0, 0.9), (1, None, 1, 2.5, 0, 0.9)]
    df = predictions(spark, rows).withColumn("prediction", F.lit(1))
    assert false_alert_episodes(df, "prediction", step_seconds=1800).first()["false_alert_episodes"] == 3
    assert false_alert_episodes(df, "prediction").first()["false_alert_episodes"] == 2
    runs = alert_runs(df, "prediction", step_seconds=1800).collect()
    assert sorted(r["windows"] for r in runs) == [1, 1, 2]


def test_run_that_starts_on_a_positive_is_not_false(spark):
    df = predictions(spark, [(1, None, 0, 0, 1, 0.9), (1, None, 0, 0.5, 0, 0.9)]).withColumn("prediction", F.lit(1))
    assert false_alert_episodes(df, "prediction", step_seconds=1800).first()["false_alert_episodes"] == 0


def test_candidates(spark):
    values = candidate_thresholds(ThresholdPolicy())
    assert len(values) == 91 and values == np.arange(0.05, 0.955, 0.01).tolist()


def test_threshold_tie_prefers_the_highest(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.5, 0.8, 0.9])
    policy = ThresholdPolicy(start=0.4, stop=0.6, step=0.1)
    best = select_threshold(sweep_thresholds(df, policy, 1800)).first()
    assert (best["threshold"], best["development_f_beta"], best["development_false_alert_episodes"]) == (0.6, 1.0, 0)


@pytest.mark.parametrize("per_seed", [False, True])
def test_sweep_equals_trying_every_candidate(spark, per_seed):
    rng = random.Random(21)
    rows = [
        (seed, rng.choice(["may_failure", "june_failure"]), segment, start / 2, int(rng.random() < 0.2), rng.choice([0.05, 0.5, 0.95, round(rng.random(), 2)]))
        for seed in (17, 42, 89) for segment in (0, 1) for start in sorted(rng.sample(range(900), 60))
    ]
    policy, folds = ThresholdPolicy(), ["may_failure", "june_failure"]
    sweep = sweep_thresholds(predictions(spark, rows), policy, 1800, seeds=(17, 42, 89), folds=folds, per_seed=per_seed)
    got = {r["candidate"]: r for r in sweep.collect()}
    place = {17: 0, 42: 1, 89: 2}
    ordered = sorted(rows, key=lambda r: ((r[0],) if per_seed else ()) + (r[2], r[3], place[r[0]], folds.index(r[1])))
    for i, threshold in enumerate(candidate_thresholds(policy)):
        tp = sum(r[4] == 1 and r[5] >= threshold for r in rows)
        fp = sum(r[4] == 0 and r[5] >= threshold for r in rows)
        fn = sum(r[4] == 1 for r in rows) - tp
        episodes, before = 0, None
        for r in ordered:
            group = (r[0] if per_seed else None, r[2])
            continues = before is not None and before[0] == group and before[1] and (r[3] - before[2]) * 3600 <= 1800
            episodes += r[5] >= threshold and not continues and r[4] == 0
            before = (group, r[5] >= threshold, r[3])
        assert (got[i]["tp"], got[i]["fp"], got[i]["fn"], got[i]["false_alert_episodes"]) == (tp, fp, fn, episodes)
        assert got[i]["f_beta"] == pytest.approx(5 * tp / (5 * tp + 4 * fn + fp) if tp else 0.0)
    assert len(got) == 91


def full_study(spark, grid):
    rng = random.Random(2)
    rows = []
    for fold in ("may_failure", "june_failure", None):
        base = {"may_failure": 0, "june_failure": 500, None: 1000}[fold]
        for i in range(12):
            rows.append((0, fold, 0, base + i / 2, int(i >= 9), round(0.1 + 0.07 * i, 3), (11 - i) / 2))
    cells = experiment_cells(spark, grid)
    return predictions(spark, rows).drop("model", "horizon_hours", "seed").join(F.broadcast(cells.drop("position")))


def test_whole_study_has_two_rows_per_cell_and_is_valid(spark):
    grid = EvaluationGrid()
    traces = full_study(spark, grid).cache()
    dev, hold = traces.where("fold is not null"), traces.where("fold is null").drop("fold")
    chosen = select_threshold(sweep_thresholds(dev, ThresholdPolicy(), 1800, seeds=grid.seeds, folds=["may_failure", "june_failure"]))
    metrics = policy_metrics(apply_thresholds(hold, chosen, ThresholdPolicy()), ThresholdPolicy(), 1800)
    assert metrics.count() == 72
    row = metrics.where("threshold_policy = 'development_selected'").first()
    assert (row["tp"], row["fp"], row["average_precision"], row["balanced_accuracy"]) == (3, 0, 1.0, 1.0)
    assert row["held_out_event_detected"] and row["first_alert_lead_hours"] == 1.0
    assert row["evaluated_days"] == pytest.approx(0.25)
    cells = experiment_cells(spark, grid)
    report = evidence_report(cells, hold, metrics, evidence_errors(cells, hold, grid, thresholds=chosen))
    require_valid(report)
    lost = hold.where("NOT (model = 'tcn' AND seed = 17 AND horizon_hours = 6)")
    broken = evidence_report(cells, lost, metrics, evidence_errors(cells, lost, grid))
    with pytest.raises(ValueError, match="tcn/h6/seed17"):
        require_valid(broken)
    assert pending_cells(cells, lost).count() == 1 and complete_groups(lost, grid.seeds).count() == 11
    events = in_event_order(eventwise_metrics(traces, grid.holdout_event), grid.events, "horizon_hours", "model", "seed").collect()
    assert [r["event"] for r in events[::36]] == list(grid.events) and {r["average_precision"] for r in events} == {1.0}
    summary = policy_summary(metrics, model="tcn", horizon_hours=3).collect()
    assert len(summary) == 2 and {r["event_detection_rate"] for r in summary} == {1.0}
    traces.unpersist()


def test_cells_are_in_report_order(spark):
    cells = experiment_cells(spark, EvaluationGrid()).orderBy("position").collect()
    assert len(cells) == 36
    assert (cells[0]["model"], cells[0]["horizon_hours"], cells[0]["seed"]) == ("xgboost", 1, 17)
    assert (cells[35]["model"], cells[35]["horizon_hours"], cells[35]["seed"]) == ("attention_tcn", 12, 89)


def test_seed_summary_uses_the_sample_deviation(spark):
    rows = [("tcn", 1, s, "may_failure", 0.1, v, v * 10, 0.5, 0.0) for s, v in ((17, 0.1), (42, 0.2), (89, 0.3))]
    rows.append(("xgboost", 1, 17, "may_failure", 0.1, 0.4, 4.0, 0.5, 0.0))
    df = spark.createDataFrame(rows, "model string, horizon_hours int, seed int, event string, prevalence double, average_precision double, ap_lift_over_prevalence double, roc_auc double, median_score_gap double")
    found = {r["model"]: r for r in seed_summary(df).collect()}
    assert found["tcn"]["seeds"] == 3 and found["tcn"]["average_precision_std"] == pytest.approx(0.1)
    assert found["xgboost"]["average_precision_std"] is None


def test_trace_problems(spark):
    df = predictions(spark, [(1, None, 0, 0, 0, 0.5), (1, None, 0, 0, 0, 0.5), (1, None, 0, 1, 0, float("nan"))])
    row = trace_problems(df).first()
    assert (row["rows"], row["bad_probabilities"], row["repeated_windows"]) == (3, 1, 1)


def test_timeline_and_band(spark):
    rows = [(s, None, 0, h, 0, p, hours) for s, h, p, hours in ((1, 0, 0.2, 2.0), (2, 0, 0.4, 2.0), (1, 1, 0.6, 1.0), (2, 1, 0.8, 1.0), (1, 2, 0.9, -1.0), (1, 3, 0.9, 30.0))]
    df = predictions(spark, rows)
    timeline = event_timeline(df).orderBy(F.desc("hours_to_next_failure")).collect()
    assert [(r[0], round(r[1], 6)) for r in timeline] == [(2.0, 0.3), (1.0, 0.7)]
    assert seed_band(df).count() == 4 and seed_band(df, seed=2).count() == 2


def test_filters_and_lookups(spark, tmp_path):
    df = predictions(spark, [(1, None, 0, 0, 0, 0.5), (2, None, 0, 1, 0, 0.5)])
    assert filter_rows(df, model=None, seed=2).count() == 1
    with pytest.raises(ValueError, match="No evidence"):
        require_rows(filter_rows(df, seed=3))
    chosen = spark.createDataFrame([("tcn", 1, 0.3, 0.5, 2)], "model string, horizon_hours int, threshold double, development_f_beta double, development_false_alert_episodes long")
    path = str(tmp_path / "thresholds")
    threshold_records(chosen, ThresholdPolicy(), (17, 42)).write.json(path)
    records = read_thresholds(spark, path)
    assert threshold_for(records, "tcn", 1, "development_selected") == 0.3
    assert threshold_for(records, "tcn", 9, "reference_0.5") == 0.5
    with pytest.raises(ValueError, match="thresholds instead of one"):
        threshold_for(records, "tcn", 3, "development_selected")
    (tmp_path / "list.json").write_text('[{"model": "tcn", "horizon_hours": 6, "seeds": [17],\n "operational": {"threshold": 0.4}}]')
    assert threshold_for(read_thresholds(spark, str(tmp_path / "list.json"), one_document=True), "tcn", 6, "x") == 0.4
    assert failure_time("june_failure", FOLDS, "july_holdout", HOLDOUT_FAILURE) == "2020-06-05 10:00:00"
    with pytest.raises(ValueError, match="no failure is known"):
        failure_time("august", FOLDS, "july_holdout", HOLDOUT_FAILURE)


def test_domain_checks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 2)], "model string, seed int")
    rows = {r["column_name"]: r for r in domain_check(df, {"model": ("a", "b", "c"), "seed": (1, 2)}).collect()}
    assert (rows["model"]["present"], rows["model"]["missing"], rows["model"]["unexpected"]) == (2, 1, 1)
    require_domain(df, {"seed": (1, 2)})
    with pytest.raises(ValueError, match="model"):
        require_domain(df, {"model": ("a", "b")})


def test_trace_files_by_name_and_by_partition(spark, tmp_path):
    df = predictions(spark, [(1, "may_failure", 0, 0, 0, 0.5), (2, None, 0, 1, 1, 0.25)])
    write_named_traces(df.where("fold is not null").withColumn("model", F.lit("attention_tcn")), str(tmp_path / "development"))
    write_named_traces(df.where("fold is null").withColumn("horizon_hours", F.lit(12)), str(tmp_path / "holdout"))
    found = {(r["model"], r["horizon_hours"], r["event"], r["probability"]) for r in scan_named_traces(spark, str(tmp_path), "july_holdout").collect()}
    assert found == {("attention_tcn", 1, "may_failure", 0.5), ("xgboost", 12, "july_holdout", 0.25)}
    path = str(tmp_path / "parts")
    write_partitioned(df.withColumn("event", F.coalesce("fold", F.lit("july_holdout"))), path)
    assert load_trace(spark, path, "xgboost", 1, "may_failure").count() == 1
    with pytest.raises(ValueError, match="no predictions"):
        load_trace(spark, path, "xgboost", 1, "june_failure")


def test_digests_find_swaps_and_repeats_and_agree_with_the_full_comparison(spark):
    from forewarn.operators.checks import differing_groups, differing_identities, identity_mismatches

    models = ("a", "b", "c")
    rows = [(m, h, s, f"w{i}", i % 2) for m in models for h in (1, 6) for s in (1, 2, 3) for i in range(20)]

    def found(changed):
        traces = spark.createDataFrame(changed, "model string, horizon_hours int, seed int, window_id string, true_label int")
        full = identity_mismatches(traces, models).where("unequal_pairs > 0")
        got = sorted(map(tuple, differing_identities(traces, models).collect()))
        assert got == sorted(map(tuple, full.collect()))
        return sorted(map(tuple, differing_groups(traces, models).collect())), got

    assert found(rows) == ([], [])
    assert found(rows[::-1]) == ([], [])
    swapped = [("b", 6, 2, "w3", 0) if r == ("b", 6, 2, "w3", 1) else r for r in rows]
    assert found(swapped) == ([(6, 2)], [(6, 2, 21, 2)])
    # Two labels exchanged leave counts and sums of labels as they were.
    crossed = [(*r[:4], 1 - r[4]) if r[:3] == ("c", 1, 3) and r[3] in ("w4", "w5") else r for r in rows]
    assert found(crossed)[0] == [(1, 3)]
    # A repeated row is no other set, but not the same rows either; a missing one is both.
    assert found([*rows, rows[0]]) == ([(1, 1)], [])
    assert found(rows[1:]) == ([(1, 1)], [(1, 1, 20, 1)])
    assert found([r for r in rows if r[:3] != ("a", 6, 1)]) == ([(6, 1)], [(6, 1, 20, 20)])
