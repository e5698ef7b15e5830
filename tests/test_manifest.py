"""Cells are whole or absent: broken writes, repeated commits, side-by-side writers and damaged files."""

import pytest
from pyspark.sql import functions as F

from forewarn.operators.checks import experiment_cells
from forewarn.sources.manifest import commit_cells, committed_cells, damaged_cells, pending_in_manifest, read_cells
from forewarn.spec import EvaluationGrid

GRID = EvaluationGrid(models=("a", "b"), horizons=(1, 6), seeds=(1, 2))


def traces(spark, cells, n=3):
    rows = [(m, h, s, f"w{i}", i / 7) for m, h, s in cells for i in range(n)]
    return spark.createDataFrame(rows, "model string, horizon_hours int, seed int, window_id string, probability double")


def held(spark, root, config="c"):
    found = read_cells(spark, root, config)
    return sorted(tuple(r) for r in found.select("model", "horizon_hours", "seed", "window_id").collect())


def cells_of(df):
    return sorted((r["model"], r["horizon_hours"], r["seed"]) for r in df.collect())


def test_nothing_is_read_before_a_commit_and_all_is_pending(spark, tmp_path):
    root = str(tmp_path / "r")
    assert read_cells(spark, root) is None and committed_cells(spark, root) is None and damaged_cells(spark, root) is None
    assert pending_in_manifest(experiment_cells(spark, GRID), root, "c").count() == 8


def test_a_write_that_breaks_half_way_leaves_no_visible_cell(spark, tmp_path):
    root = str(tmp_path / "r")
    assert commit_cells(traces(spark, [("a", 1, 1)]), root, "c") == 1
    broken = traces(spark, [("b", 1, 1), ("b", 6, 2)]).repartition(4, "horizon_hours")
    broken = broken.withColumn("probability", F.when(F.col("horizon_hours") == 6, F.raise_error(F.lit("lost"))).otherwise(F.col("probability")))
    with pytest.raises(Exception, match="lost"):
        commit_cells(broken, root, "c")
    # Files without a commit, as a job that died after writing leaves them.
    traces(spark, [("b", 1, 1)]).write.partitionBy("model", "horizon_hours", "seed").parquet(f"{root}/cells/batch=dead")
    assert {row[0] for row in held(spark, root)} == {"a"}
    assert ("b", 1, 1) in cells_of(pending_in_manifest(experiment_cells(spark, GRID), root, "c"))
    assert commit_cells(traces(spark, [("b", 1, 1)]), root, "c") == 1
    assert len(held(spark, root)) == 6 and damaged_cells(spark, root).isEmpty()


def test_a_repeated_commit_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "r")
    rows = traces(spark, [("a", 1, 1), ("a", 1, 2)])
    assert commit_cells(rows, root, "c") == 2
    before = sorted(map(tuple, committed_cells(spark, root).collect()))
    assert commit_cells(rows.withColumn("probability", F.lit(0.5)), root, "c") == 0
    assert commit_cells(rows.limit(0), root, "c") == 0
    assert sorted(map(tuple, committed_cells(spark, root).collect())) == before
    # New cells of the same table are added; another configuration has cells of its own.
    assert commit_cells(traces(spark, [("a", 1, 1), ("b", 6, 2)]), root, "c") == 1
    assert commit_cells(rows, root, "other") == 2
    assert cells_of(pending_in_manifest(experiment_cells(spark, GRID), root, "other")) == [
        ("a", 6, 1), ("a", 6, 2), ("b", 1, 1), ("b", 1, 2), ("b", 6, 1), ("b", 6, 2)]
    assert len(held(spark, root)) == 9 and len(held(spark, root, "other")) == 6


def test_the_first_of_two_commits_of_a_cell_counts(spark, tmp_path):
    root = str(tmp_path / "r")
    commit_cells(traces(spark, [("a", 1, 1)]), root, "c")
    # A writer that did not see the first commit.
    late = committed_cells(spark, root).withColumn("batch", F.lit("late")).withColumn("committed_at", F.expr("committed_at + INTERVAL 1 HOUR"))
    traces(spark, [("a", 1, 1)], 9).write.partitionBy("model", "horizon_hours", "seed").parquet(f"{root}/cells/batch=late")
    late.write.mode("append").parquet(f"{root}/manifest")
    assert len(held(spark, root)) == 3 and committed_cells(spark, root).count() == 1


def test_damaged_cells_are_named(spark, tmp_path):
    root = str(tmp_path / "r")
    commit_cells(traces(spark, [("a", 1, 1), ("b", 6, 2)]), root, "c")
    assert damaged_cells(spark, root).isEmpty()
    (batch,) = {r["batch"] for r in committed_cells(spark, root).collect()}
    more = traces(spark, [("b", 6, 2)], 1).select("window_id", "probability")
    more.write.mode("append").parquet(f"{root}/cells/batch={batch}/model=b/horizon_hours=6/seed=2")
    assert [(r["model"], r["rows"], r["found"]) for r in damaged_cells(spark, root).collect()] == [("b", 3, 4)]
