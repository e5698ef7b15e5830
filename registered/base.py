"""Registry and the SQL building blocks the queries are checked against.

The SQL is written plainly (window functions over whole tables, range joins,
one pass per threshold candidate) so that it does not share the Spark design.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forewarn.plans import events_study as es
from forewarn.plans.events_study import Study
from forewarn.spec import WindowPolicy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGITS = 6
# Medians of whole microseconds end in half a microsecond, a tie at six digits.
FINER = {"cadence_seconds": 9}


def query(name: str, sql: str | None = None):
    """Register a query of (study) -> DataFrame with its SQL counterpart."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(Study(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles so that two engines print the same digits."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), FINER.get(field.name, DIGITS))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def rounded(body: str, *columns: str) -> str:
    """Round the named columns of a SELECT the way ``tidy`` does."""
    changes = ", ".join(f"round({c}, {FINER.get(c, DIGITS)}) + 0.0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({changes}) FROM ({body})"


def digest(text: str) -> str:
    """SQL for the number that ``row_number_of_text`` makes of a text."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS UBIGINT)"


def _timestamp(text: str) -> str:
    return f"TIMESTAMP '{text}'"


FAILURE_ROWS = ", ".join(f"({_timestamp(a)}, {_timestamp(b)}, '{k}')" for a, b, k in es.FAILURES)
FOLD_ROWS = ", ".join(
    f"({i}, '{n}', {_timestamp(a)}, {_timestamp(b)})" for i, (n, a, b) in enumerate(es.FOLDS, 1)
)
ONSET_ROWS = ", ".join(f"('{n}', {_timestamp(t)})" for n, t in es.ONSETS)
MODEL_ROWS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(es.GRID.models, 1))
SEED_ROWS = ", ".join(f"({i}, {s})" for i, s in enumerate(es.GRID.seeds, 1))
HORIZON_ROWS = ", ".join(f"({h})" for h in es.GRID.horizons)
HOLDOUT = _timestamp(es.HOLDOUT_START)
SENSORS = ("value", "k")
FEATURES = es.CLEAN.feature_names


def _iso(column: str) -> str:
    return (
        f"strftime({column}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN epoch_us({column}) % 1000000 = 0 THEN '' ELSE strftime({column}, '.%f') END"
    )


def _feature_sql() -> str:
    parts = []
    hours = "((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0)"
    for s in SENSORS:
        parts += [
            f"avg({s}) AS {s}_mean",
            f"stddev_pop({s}) AS {s}_std",
            f"min({s}) AS {s}_min",
            f"max({s}) AS {s}_max",
            f"CASE WHEN {hours} > 0 THEN (arg_max({s}, ts) - arg_min({s}, ts)) / {hours} END AS {s}_roc_per_hour",
        ]
    parts += [
        "avg(k - value) AS pressure_diff_mean",
        "avg(active) AS comp_duty_cycle",
        "avg(CASE WHEN previous_timestamp >= window_start THEN abs(value - previous_value) END)"
        " AS motor_current_volatility",
    ]
    return ",\n    ".join(parts)


def telemetry_ctes(
    policy: WindowPolicy = WindowPolicy(3600, 1800, 1200, 0.5),
    asset: str | None = None,
    minute: bool = False,
    value_limit: float = 1000.0,
) -> str:
    """Raw rows to labelled windows."""
    a = f"{asset}, " if asset else ""
    by = f"PARTITION BY {asset} " if asset else ""
    same = f" AND x.{asset} = y.{asset}" if asset else ""
    stamp = "date_trunc('minute', ts)" if minute else "ts"
    size, step = policy.window_seconds, policy.step_seconds
    aid = f"{asset}::VARCHAR || ':' || " if asset else ""
    return f"""
raw AS (
  SELECT event_id, {a}CAST({stamp} AS TIMESTAMP) AS ts, value,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END AS active
  FROM events),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY {a}ts ORDER BY event_id) > 1 AND ts IS NOT NULL AS duplicate_timestamp
  FROM raw),
judged AS (
  SELECT *, NOT duplicate_timestamp AND ts IS NOT NULL
    AND coalesce(value BETWEEN 0.0 AND {value_limit}, false) AND coalesce(k BETWEEN 0.0 AND 100.0, false) AS is_valid
  FROM flagged),
valid AS (SELECT * FROM judged WHERE is_valid),
gapped AS (
  SELECT *, lag(ts) OVER (w) AS before_ts, lag(value) OVER (w) AS before_value
  FROM valid WINDOW w AS ({by}ORDER BY ts)),
started AS (
  SELECT *, coalesce(epoch_us(ts) - epoch_us(before_ts) > {policy.max_gap_seconds}000000, true) AS starts FROM gapped),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER ({by}ORDER BY ts) - 1 AS BIGINT) AS segment_id FROM started),
segmented AS (
  SELECT event_id, {a}ts, value, k, active, segment_id,
    min(ts) OVER (PARTITION BY {a}segment_id) AS segment_start,
    CASE WHEN NOT starts THEN before_ts END AS previous_timestamp,
    CASE WHEN NOT starts THEN before_value END AS previous_value
  FROM numbered),
profile AS (
  SELECT {a}segment_id, count(*) AS rows, min(ts) AS segment_start, max(ts) AS segment_end,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS duration_hours,
    quantile_cont(CASE WHEN epoch_us(ts) > epoch_us(previous_timestamp)
      THEN CAST(epoch_us(ts) - epoch_us(previous_timestamp) AS DOUBLE) END, 0.5) / 1000000.0 AS cadence_seconds
  FROM segmented GROUP BY {a}segment_id),
starts AS (
  SELECT {a}segment_id, cadence_seconds, unnest(generate_series(0, CAST(floor(
      (epoch_us(segment_end) - epoch_us(segment_start) + cadence_seconds * 1000000 - {size}000000)
      / {step}000000) AS BIGINT))) AS window_index, segment_start
  FROM profile WHERE cadence_seconds <= {size}),
bounds AS (
  SELECT *, segment_start + to_seconds(window_index * {step}) AS window_start,
    segment_start + to_seconds(window_index * {step} + {size}) AS window_end
  FROM starts),
windows AS (
  SELECT {', '.join('x.' + c for c in ([asset] if asset else []) + ['segment_id', 'window_index', 'window_start', 'window_end'])},
    count(*) AS rows, any_value(cadence_seconds) AS cadence_seconds,
    {_feature_sql()}
  FROM bounds x JOIN segmented y ON x.segment_id = y.segment_id{same}
    AND y.ts >= x.window_start AND y.ts < x.window_end
  GROUP BY ALL
  HAVING count(*) >= greatest(1, floor(greatest(1, round_even({size} / any_value(cadence_seconds), 0)) * {policy.min_coverage}))),
failures AS (SELECT * FROM (VALUES {FAILURE_ROWS}) AS t(failure_start, failure_end, failure_type)),
labelled AS (
  SELECT w.*,
    EXISTS (SELECT 1 FROM failures f WHERE f.failure_start < w.window_end AND f.failure_end > w.window_start) AS in_failure,
    (SELECT min(epoch_us(f.failure_start) - epoch_us(w.window_end)) FROM failures f
      WHERE f.failure_start >= w.window_end) / 3600000000.0 AS hours_to_next_failure
  FROM windows w),
predictive AS (
  SELECT *, {aid}segment_id || ':' || {_iso('window_start')} || ':' || {_iso('window_end')} AS window_id
  FROM labelled WHERE NOT in_failure),
horizons AS (SELECT * FROM (VALUES {HORIZON_ROWS}) AS t(horizon_hours)),
by_horizon AS (
  SELECT p.*, h.horizon_hours, CAST(coalesce(hours_to_next_failure <= h.horizon_hours, false) AS INTEGER)
    AS failure_within_horizon
  FROM predictive p, horizons h),
split AS (
  SELECT *, CASE WHEN window_end >= {HOLDOUT} THEN 'test'
    WHEN window_end <= (SELECT min(window_start) FROM predictive WHERE window_end >= {HOLDOUT}) THEN 'train'
    ELSE 'purged' END AS split
  FROM predictive),
folds AS (SELECT * FROM (VALUES {FOLD_ROWS}) AS t(position, fold, validation_start, validation_end)),
fold_rows AS (
  SELECT p.*, f.fold, CASE WHEN p.window_end >= f.validation_start THEN 'validation' ELSE 'train' END AS role
  FROM predictive p JOIN folds f ON p.window_end < f.validation_end),
fold_split AS (
  SELECT r.* FROM fold_rows r
  WHERE role = 'validation' OR window_end <= (
    SELECT min(v.window_start) FROM fold_rows v WHERE v.role = 'validation' AND v.fold = r.fold)),
models AS (SELECT * FROM (VALUES {MODEL_ROWS}) AS t(m, model)),
seeds AS (SELECT * FROM (VALUES {SEED_ROWS}) AS t(s, seed)),
traced AS (
  SELECT window_id, segment_id, window_index, window_start, window_end, rows, hours_to_next_failure, fold
  FROM fold_split WHERE role = 'validation'
  UNION ALL
  SELECT window_id, segment_id, window_index, window_start, window_end, rows, hours_to_next_failure, NULL
  FROM split WHERE split = 'test'),
traces AS (
  SELECT model, horizon_hours, seed, fold, window_id, segment_id, window_start, window_end,
    CAST(coalesce(hours_to_next_failure <= horizon_hours, false) AS INTEGER) AS true_label,
    ((rows * 7 + window_index * 31 + seed * 13 * m) % 101) / 100.0::DOUBLE AS probability,
    hours_to_next_failure
  FROM traced, horizons, models, seeds)"""


def sql(body: str, extra: str = "", **options) -> str:
    """A query over the telemetry building blocks."""
    more = f",\n{extra}" if extra else ""
    return f"WITH {telemetry_ctes(**options)}{more}\n{body}"
