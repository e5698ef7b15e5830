"""The telemetry study run on the ``events`` table.

``events`` stands in for a machine log: ``value`` and the number inside
``props`` are the analogue channels, click/view events the digital one, and
``event_id`` the arrival order. Everything below grows with that table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.operators.labels import label_horizons, label_windows
from forewarn.operators.regimes import regime_membership
from forewarn.operators.segments import assign_segments, segment_profile
from forewarn.operators.sequences import resample_windows
from forewarn.operators.splits import chronological_split, development_folds
from forewarn.operators.validation import valid_rows, validate
from forewarn.operators.windows import predictive_windows, window_features
from forewarn.sources.sinks import stage_table
from forewarn.sources.telemetry import coerce
from forewarn.spec import EvaluationGrid, SequencePolicy, TelemetrySpec, ThresholdPolicy, WindowPolicy

FAILURES = (
    ("2024-01-08 06:00:00", "2024-01-08 10:00:00", "leak"),
    ("2024-01-15 12:00:00", "2024-01-15 18:00:00", "leak"),
    ("2024-01-22 00:00:00", "2024-01-22 05:30:00", "leak"),
    ("2024-01-27 14:30:00", "2024-01-27 19:00:00", "leak"),
)
FOLDS = (
    ("may_failure", "2024-01-12 00:00:00", "2024-01-15 12:00:00"),
    ("june_failure", "2024-01-19 00:00:00", "2024-01-22 00:00:00"),
)
HOLDOUT_START = "2024-01-24 00:00:00"
# Onsets whose lead-up is compared with normal operation.
ONSETS = (
    ("may_failure", "2024-01-15 12:00:00"),
    ("june_failure", "2024-01-22 00:00:00"),
    ("july_holdout", "2024-01-27 14:30:00"),
)
GRID = EvaluationGrid(folds=FOLDS)
THRESHOLDS = ThresholdPolicy()
SEQUENCE = SequencePolicy(bin_seconds=300, steps=12, max_fill=1)

_COMMON = dict(
    timestamp="ts",
    digital=("active",),
    difference=("k", "value"),
    duty="active",
    volatility="value",
    order_cols=("event_id",),
)
CLEAN = TelemetrySpec(analogue={"value": (0.0, 1000.0), "k": (0.0, 100.0)}, **_COMMON)
# A tight range and minute timestamps, so that every rejection rule has work to do.
DIRTY = TelemetrySpec(analogue={"value": (0.0, 200.0), "k": (0.0, 100.0)}, **_COMMON)
# One machine per user, with windows of a day because each user reports rarely.
FLEET = TelemetrySpec(analogue={"value": (0.0, 1000.0), "k": (0.0, 100.0)}, asset_cols=("user_id",), **_COMMON)


@dataclass(frozen=True)
class Study:
    """One study: where the data is and which policy cuts it."""

    spark: SparkSession
    sf_dir: str
    policy: WindowPolicy = WindowPolicy(3600, 1800, 1200, 0.5)
    spec: TelemetrySpec = CLEAN
    segment_table: DataFrame | None = None
    window_table: DataFrame | None = None

    def with_stored_readings(self) -> Study:
        """The same study with its ordered readings kept as a stage, for uses that read them several times."""
        if self.segment_table is not None:
            return self
        segmented = assign_segments(
            self.valid(), self.spec, self.policy.max_gap_seconds, carry=(self.spec.volatility,),
            keep=lambda ordered: stage_table(ordered, "readings"),
        )
        return replace(self, segment_table=segmented)

    def with_stored_windows(self) -> Study:
        """The same study with its windows kept as a stage, for uses that read them several times."""
        study = self.with_stored_readings()
        return replace(study, window_table=stage_table(study.windows(), "windows"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw(self, minute_stamps: bool = False) -> DataFrame:
        stamp = F.col("ts").cast("timestamp_ntz")
        if minute_stamps:
            stamp = F.date_trunc("minute", stamp).cast("timestamp_ntz")
        return self.table("events").select(
            "event_id",
            *self.spec.asset_cols,
            stamp.alias("ts"),
            "value",
            F.get_json_object("props", "$.k").alias("k"),
            F.col("event_type").isin("click", "view").cast("int").alias("active"),
        )

    def flagged(self, minute_stamps: bool = False) -> DataFrame:
        return validate(coerce(self.raw(minute_stamps), self.spec), self.spec)

    def valid(self, minute_stamps: bool = False) -> DataFrame:
        return valid_rows(self.flagged(minute_stamps))

    def segmented(self) -> DataFrame:
        if self.segment_table is not None:
            return self.segment_table
        return assign_segments(
            self.valid(), self.spec, self.policy.max_gap_seconds, carry=(self.spec.volatility,)
        )

    def profile(self) -> DataFrame:
        return segment_profile(self.segmented(), self.spec)

    def windows(self) -> DataFrame:
        if self.window_table is not None:
            return self.window_table
        study = self.with_stored_readings()
        return window_features(study.segmented(), study.profile(), self.spec, self.policy)

    def labelled(self) -> DataFrame:
        return label_windows(self.windows(), FAILURES)

    def predictive(self) -> DataFrame:
        return predictive_windows(self.labelled(), self.spec)

    def by_horizon(self) -> DataFrame:
        return label_horizons(self.predictive(), GRID.horizons)

    def split(self) -> DataFrame:
        return chronological_split(self.predictive(), HOLDOUT_START)

    def folds(self) -> DataFrame:
        return development_folds(self.predictive(), FOLDS)

    def traces(self) -> DataFrame:
        """Development and holdout predictions of every grid cell.

        Scores are a fixed integer rule over the window's own data, so that every
        engine computes the same ones: no model is involved.
        """
        development = (
            self.folds().where(F.col("role") == "validation").drop("role")
        )
        holdout = self.split().where(F.col("split") == "test").drop("split").withColumn(
            "fold", F.lit(None).cast("string")
        )
        columns = ["window_id", "segment_id", "window_index", "window_start", "window_end", "rows",
                   "hours_to_next_failure", "fold"]
        scored = label_horizons(
            development.select(*columns).unionByName(holdout.select(*columns)), GRID.horizons
        )
        numbered = F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("m")) for i, m in enumerate(GRID.models, 1)])
        )
        seeds = F.explode(F.array(*[F.lit(s) for s in GRID.seeds]))
        step = F.col("rows") * 7 + F.col("window_index") * 31 + F.col("seed") * 13 * F.col("_model.m")
        return (
            scored.withColumn("_model", numbered)
            .withColumn("seed", seeds)
            .select(
                F.col("_model.model").alias("model"),
                "horizon_hours",
                "seed",
                "fold",
                "window_id",
                "segment_id",
                "window_start",
                "window_end",
                F.col("failure_within_horizon").alias("true_label"),
                (F.pmod(step, F.lit(101)) / 100.0).alias("probability"),
                "hours_to_next_failure",
            )
        )

    def stored_traces(self) -> DataFrame:
        """The traces as a stored stage: everything downstream reads them several times."""
        return stage_table(self.with_stored_windows().traces(), "traces", ("model", "horizon_hours"))

    def steps(self) -> DataFrame:
        study = self.with_stored_readings()
        return resample_windows(study.segmented(), study.predictive(), self.spec, SEQUENCE, self.policy)

    def regime_members(self, **options) -> DataFrame:
        return regime_membership(self.labelled(), ONSETS, **options)
