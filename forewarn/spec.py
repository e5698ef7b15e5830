"""Parameters of a telemetry study: columns, ranges, window policy and evaluation grid."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping

# Inclusive plausible range of each analogue sensor.
ANALOGUE_RANGES = {
    "TP2": (-0.5, 12.0),
    "TP3": (-0.5, 12.0),
    "H1": (-0.5, 12.0),
    "DV_pressure": (-1.0, 3.0),
    "Reservoirs": (-0.5, 12.0),
    "Oil_temperature": (-20.0, 150.0),
    "Motor_current": (-1.0, 30.0),
}

# Published failure intervals (start, end, kind).
FAILURES = (
    ("2020-04-18 00:00:00", "2020-04-18 23:59:00", "air_leak"),
    ("2020-05-29 23:30:00", "2020-05-30 06:00:00", "air_leak"),
    ("2020-06-05 10:00:00", "2020-06-07 14:30:00", "air_leak"),
    ("2020-07-15 14:30:00", "2020-07-15 19:00:00", "air_leak"),
)

# Development folds (name, validation start, validation end) and the holdout boundary.
FOLDS = (
    ("may_failure", "2020-05-22 23:30:00", "2020-05-29 23:30:00"),
    ("june_failure", "2020-05-30 06:00:00", "2020-06-05 10:00:00"),
)
HOLDOUT_EVENT = "july_holdout"
HOLDOUT_START = "2020-07-08 14:30:00"
HOLDOUT_FAILURE = "2020-07-15 14:30:00"

# Evaluation grid, in report order.
MODELS = ("xgboost", "tcn", "attention_tcn")
HORIZONS = (1, 3, 6, 12)
SEEDS = (17, 42, 89)

# Display names used by report tables.
MODEL_LABELS = {"xgboost": "XGBoost", "tcn": "TCN", "attention_tcn": "Attention-TCN"}
EVENT_LABELS = {
    "may_failure": "May development",
    "june_failure": "June development",
    "july_holdout": "July holdout",
}


@dataclass(frozen=True)
class TelemetrySpec:
    """Which columns a telemetry table has and how its rows are judged.

    ``asset_cols`` names the machine a row belongs to; empty means one machine.
    ``order_cols`` gives the arrival (file) order, used to decide which copy of a
    repeated timestamp came first.
    """

    timestamp: str = "timestamp"
    analogue: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(ANALOGUE_RANGES))
    digital: tuple[str, ...] = ("COMP",)
    difference: tuple[str, str] = ("TP3", "TP2")
    duty: str = "COMP"
    volatility: str = "Motor_current"
    asset_cols: tuple[str, ...] = ()
    order_cols: tuple[str, ...] = ("row_block", "row_order")

    @property
    def channels(self) -> tuple[str, ...]:
        return (*self.analogue, *self.digital)

    @property
    def required(self) -> tuple[str, ...]:
        return (self.timestamp, *self.channels)

    @property
    def feature_names(self) -> tuple[str, ...]:
        per_sensor = [
            f"{sensor}_{part}"
            for sensor in self.analogue
            for part in ("mean", "std", "min", "max", "roc_per_hour")
        ]
        return (*per_sensor, "pressure_diff_mean", "comp_duty_cycle", "motor_current_volatility")


@dataclass(frozen=True)
class WindowPolicy:
    """Sliding-window and continuity rules, in seconds."""

    window_seconds: int = 3600
    step_seconds: int = 1800
    max_gap_seconds: int = 30
    min_coverage: float = 0.8

    def __post_init__(self) -> None:
        if self.window_seconds <= 0 or self.step_seconds <= 0:
            raise ValueError("windows and steps need a positive length")
        if not 0 < self.min_coverage <= 1:
            raise ValueError("coverage must be above 0 and at most 1")


@dataclass(frozen=True)
class SequencePolicy:
    """Fixed-step resampling of one window."""

    bin_seconds: int = 30
    steps: int = 120
    max_fill: int = 1


@dataclass(frozen=True)
class ThresholdPolicy:
    """Candidate thresholds and the weight of recall when choosing one."""

    reference: float = 0.5
    start: float = 0.05
    stop: float = 0.95
    step: float = 0.01
    beta: float = 2.0


@dataclass(frozen=True)
class EvaluationGrid:
    """Models, horizons and seeds of a study, in report order."""

    models: tuple[str, ...] = MODELS
    horizons: tuple[int, ...] = HORIZONS
    seeds: tuple[int, ...] = SEEDS
    folds: tuple[tuple[str, str, str], ...] = FOLDS
    holdout_event: str = HOLDOUT_EVENT

    @property
    def events(self) -> tuple[str, ...]:
        return (*[name for name, _, _ in self.folds], self.holdout_event)


def require_columns(columns: list[str], needed, what: str) -> None:
    """Raise with the missing names; looks at the schema only, no job runs."""
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
