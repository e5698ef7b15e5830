"""Fixed-step sequences and their normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from forewarn.operators.normalizer import (
    apply_normalizer,
    fit_channels,
    fit_normalizer,
    id_fingerprint,
    repeated_windows,
    unknown_windows,
)
from forewarn.operators.sequences import (
    OBSERVED,
    pack_sequences,
    resample_windows,
    rows_in_windows,
    sequence_channels,
    windows_without_source,
)
from forewarn.plans.events_study import CLEAN, SEQUENCE
from forewarn.sources.sinks import stage_table
from registered.base import digest, query, rounded, sql

CHANNELS = sequence_channels(CLEAN)
STANDARDIZED = tuple(CLEAN.analogue)

# Named bins, neighbours by window functions, one row per window and step.
STEP_CTES = """binned AS (
  SELECT p.window_id, CAST(floor((epoch_us(s.ts) - epoch_us(p.window_start)) / 300000000.0) AS INTEGER) AS step,
    count(*) AS rows_in_bin, avg(s.value) AS value, avg(s.k) AS k, avg(s.active) AS active
  FROM predictive p JOIN segmented s ON s.segment_id = p.segment_id AND s.ts >= p.window_start AND s.ts < p.window_end
  GROUP BY 1, 2),
gridded AS (
  SELECT p.segment_id, p.window_id, p.window_start, p.window_end, p.cadence_seconds, CAST(g.step AS INTEGER) AS step,
    b.rows_in_bin, b.value, b.k, b.active
  FROM predictive p CROSS JOIN generate_series(0, 11) AS g(step)
  LEFT JOIN binned b ON b.window_id = p.window_id AND b.step = g.step),
neighbours AS (
  SELECT *, last_value(value IGNORE NULLS) OVER l AS lv, first_value(value IGNORE NULLS) OVER r AS rv,
    last_value(CASE WHEN value IS NOT NULL THEN step END IGNORE NULLS) OVER l AS ls,
    first_value(CASE WHEN value IS NOT NULL THEN step END IGNORE NULLS) OVER r AS rs,
    last_value(k IGNORE NULLS) OVER l AS lk, first_value(k IGNORE NULLS) OVER r AS rk,
    lag(active) OVER (PARTITION BY window_id ORDER BY step) AS la
  FROM gridded WINDOW
    l AS (PARTITION BY window_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    r AS (PARTITION BY window_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
steps AS (
  SELECT segment_id, window_id, window_start, window_end, step,
    coalesce(value, CASE WHEN step - ls <= 1 THEN lv + (rv - lv) / (rs - ls) * (step - ls) END) AS value,
    coalesce(k, CASE WHEN step - ls <= 1 THEN lk + (rk - lk) / (rs - ls) * (step - ls) END) AS k,
    coalesce(active, la) AS active,
    CASE WHEN rows_in_bin IS NULL THEN 0.0 ELSE least(1.0, rows_in_bin / greatest(1.0, 300.0 / cadence_seconds)) END
      AS bin_observed_fraction
  FROM neighbours)"""

FITTED = """training AS (
  SELECT s.* FROM steps s JOIN split p ON p.window_id = s.window_id WHERE p.split = 'train'),
long AS (
  SELECT 'value' AS channel, value AS reading FROM training UNION ALL SELECT 'k', k FROM training
  UNION ALL SELECT 'active', active FROM training UNION ALL SELECT 'bin_observed_fraction', bin_observed_fraction FROM training),
fallbacks AS (SELECT channel, quantile_cont(reading, 0.5) AS fallback FROM long GROUP BY 1),
parameters AS (
  SELECT l.channel, f.fallback, CASE WHEN l.channel IN ('value', 'k') THEN avg(coalesce(reading, fallback)) ELSE 0.0 END AS mean,
    CASE WHEN l.channel IN ('value', 'k') AND stddev_pop(coalesce(reading, fallback)) > 0
      THEN stddev_pop(coalesce(reading, fallback)) ELSE 1.0 END AS scale,
    l.channel IN ('value', 'k') AS standardized
  FROM long l JOIN fallbacks f ON f.channel = l.channel GROUP BY l.channel, f.fallback)"""


@query(
    "ts8_resampled_bins",
    rounded(
        sql("SELECT window_id, step, rows_in_bin, value, k, active FROM gridded WHERE rows_in_bin IS NOT NULL", STEP_CTES),
        "value", "k", "active",
    ),
)
def ts8(study):
    """Bin means before filling, only bins that have readings."""
    windows = study.predictive().select("segment_id", "window_id", "window_start", "window_end")
    contained = rows_in_windows(
        study.segmented().select("segment_id", "ts", *CLEAN.channels), windows, CLEAN, study.policy.window_seconds
    )
    seconds = F.timestamp_diff("MICROSECOND", F.col("window_start"), F.col("ts"))
    step = F.floor(seconds / (SEQUENCE.bin_seconds * 1_000_000)).cast("int")
    return contained.groupBy("window_id", step.alias("step")).agg(
        F.count(F.lit(1)).alias("rows_in_bin"), *[F.avg(c).alias(c) for c in CLEAN.channels]
    )


@query(
    "ts9_interpolated_channels",
    rounded(sql("SELECT window_id, step, value, k FROM steps", STEP_CTES), "value", "k"),
)
def ts9(study):
    return study.steps().select("window_id", "step", "value", "k")


@query("ts10_forward_filled_channel", rounded(sql("SELECT window_id, step, active FROM steps", STEP_CTES), "active"))
def ts10(study):
    return study.steps().select("window_id", "step", "active")


@query(
    "ts11_observed_fraction",
    rounded(sql("SELECT window_id, step, bin_observed_fraction FROM steps", STEP_CTES), OBSERVED),
)
def ts11(study):
    return study.steps().select("window_id", "step", OBSERVED)


@query(
    "ts11_observed_fraction_segment_cadence",
    rounded(sql("SELECT window_id, step, bin_observed_fraction FROM steps", STEP_CTES), OBSERVED),
)
def ts11_fallback(study):
    """Windows without a cadence of their own take the one of their segment; bins are counted per window."""
    windows = study.predictive().withColumn("cadence_seconds", F.lit(None).cast("double"))
    steps = resample_windows(study.segmented(), windows, CLEAN, SEQUENCE, profile=study.profile())
    return steps.select("window_id", "step", OBSERVED)


@query(
    "ts12_packed_sequences",
    rounded(
        sql(
            """SELECT window_id, CAST(count(*) AS INTEGER) AS steps, 4 AS channels,
                 sum((step + 1) * (CAST(CAST(coalesce(value, -1) AS FLOAT) AS DOUBLE)
                   + 2 * CAST(CAST(coalesce(k, -1) AS FLOAT) AS DOUBLE)
                   + 3 * CAST(CAST(coalesce(active, -1) AS FLOAT) AS DOUBLE)
                   + 4 * CAST(CAST(bin_observed_fraction AS FLOAT) AS DOUBLE))) AS weighted_sum
               FROM steps GROUP BY 1""",
            STEP_CTES,
        ),
        "weighted_sum",
    ),
)
def ts12(study):
    packed = pack_sequences(study.steps(), CLEAN, SEQUENCE)
    per_channel = F.transform(
        "sequence",
        lambda vector, step: (step + 1)
        * F.aggregate(
            F.transform(vector, lambda v, i: (i + 1) * F.coalesce(v.cast("double"), F.lit(-1.0))),
            F.lit(0.0),
            lambda total, v: total + v,
        ),
    )
    return packed.select(
        "window_id",
        F.size("sequence").alias("steps"),
        F.size(F.col("sequence")[0]).alias("channels"),
        F.aggregate(per_channel, F.lit(0.0), lambda total, v: total + v).alias("weighted_sum"),
    )


@query(
    "ts13_source_presence",
    sql(
        """SELECT problem, count(*) AS windows FROM (
             SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM kept s WHERE s.segment_id = p.segment_id)
                 THEN 'the segment has no readings'
               WHEN NOT EXISTS (SELECT 1 FROM kept s WHERE s.segment_id = p.segment_id AND s.ts >= p.window_start
                 AND s.ts < p.window_end) THEN 'the window has no readings' END AS problem
             FROM predictive p) WHERE problem IS NOT NULL GROUP BY 1""",
        "kept AS (SELECT * FROM segmented WHERE k >= 85)",
    ),
)
def ts13(study):
    """The source lost its readings below 85: which windows can no longer be resampled."""
    kept = study.segmented().where(F.col("k") >= 85)
    return windows_without_source(kept, study.predictive(), CLEAN, study.policy.window_seconds).groupBy("problem").agg(
        F.count(F.lit(1)).alias("windows")
    )


@query(
    "jn5_sequence_lookup",
    rounded(
        sql("SELECT s.window_id, s.step, s.value FROM steps s JOIN split p ON p.window_id = s.window_id WHERE p.split = 'test'", STEP_CTES),
        "value",
    ),
)
def jn5(study):
    study = study.with_stored_windows()
    test = study.split().where(F.col("split") == "test").select("window_id")
    return study.steps().join(test, "window_id", "left_semi").select("window_id", "step", "value")


@query(
    "sp5_sequence_split",
    sql("SELECT p.split, count(*) AS steps, count(DISTINCT s.window_id) AS windows FROM steps s JOIN split p"
        " ON p.window_id = s.window_id WHERE p.split <> 'purged' GROUP BY 1", STEP_CTES),
)
def sp5(study):
    study = study.with_stored_windows()
    sides = study.split().where(F.col("split") != "purged").select("window_id", "split")
    per_window = study.steps().groupBy("window_id").agg(F.count(F.lit(1)).alias("_steps"))
    return per_window.join(sides, "window_id").groupBy("split").agg(
        F.sum("_steps").alias("steps"), F.count(F.lit(1)).alias("windows")
    )


def _stored(study):
    """Windows and their sequences as stages: a fit reads both more than once."""
    study = study.with_stored_windows()
    return study, stage_table(study.steps(), "sequences")


def _parameters(study, steps):
    training = study.split().where(F.col("split") == "train").select("window_id")
    return fit_normalizer(steps, training, CHANNELS, STANDARDIZED)


@query(
    "nm1_fit_normalizer",
    rounded(
        sql("SELECT *, (SELECT count(*) FROM split WHERE split = 'train') AS training_windows FROM parameters",
            f"{STEP_CTES},\n{FITTED}"),
        "fallback", "mean", "scale",
    ),
)
def nm1(study):
    return _parameters(*_stored(study))


@query(
    "nm1_training_id_checks",
    sql(
        """SELECT (SELECT count(*) FROM ids WHERE window_id NOT IN (SELECT window_id FROM predictive)) AS unknown_ids,
             (SELECT count(*) FROM (SELECT window_id FROM ids GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids""",
        """ids AS (SELECT segment_id || ':' || strftime(window_start, '%Y-%m-%dT%H:%M:%S') || CASE WHEN
             epoch_us(window_start) % 1000000 = 0 THEN '' ELSE strftime(window_start, '.%f') END || ':' ||
             strftime(window_end, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(window_end) % 1000000 = 0 THEN ''
             ELSE strftime(window_end, '.%f') END AS window_id FROM labelled
           UNION ALL SELECT window_id FROM split WHERE split = 'test')""",
    ),
)
def nm1_checks(study):
    """All windows offered as training ids: active-failure windows are unknown, test windows repeat."""
    from forewarn.operators.windows import window_id

    study = study.with_stored_windows()
    offered = study.labelled().select(window_id(CLEAN).alias("window_id")).unionByName(
        study.split().where(F.col("split") == "test").select("window_id")
    )
    unknown = unknown_windows(study.predictive().select("window_id"), offered)
    counted = unknown.agg(F.count(F.lit(1)).alias("unknown_ids"))
    repeated = repeated_windows(offered).agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.withColumn("repeated_ids", repeated)


@query(
    "nm1_training_fingerprint",
    sql(
        f"SELECT count(*) AS ids, CAST(coalesce(sum({digest('window_id')}), 0) AS VARCHAR) AS fingerprint"
        " FROM split WHERE split = 'train'"
    ),
)
def nm1_fingerprint(study):
    return id_fingerprint(study.split().where(F.col("split") == "train"))


@query(
    "nm1_fit_embedding_dimensions",
    rounded(
        """WITH long AS (SELECT CAST(unnest(generate_series(1, 64)) - 1 AS INTEGER) AS channel,
             CAST(unnest(embedding) AS DOUBLE) AS reading FROM embeddings),
           middle AS (SELECT channel, quantile_cont(reading, 0.5) AS fallback FROM long GROUP BY 1)
           SELECT l.channel, m.fallback, avg(reading) AS mean, stddev_pop(reading) AS scale, true AS standardized
           FROM long l JOIN middle m ON m.channel = l.channel GROUP BY 1, 2""",
        "fallback", "mean", "scale",
    ),
)
def nm1_embeddings(study):
    """The same fit over the 64 dimensions of stored vectors."""
    long = study.table("embeddings").select(F.posexplode("embedding").alias("channel", "reading")).select(
        "channel", F.col("reading").cast("double").alias("reading")
    )
    return fit_channels(long, None)


@query(
    "nm2_apply_normalizer",
    rounded(
        sql(
            """SELECT s.window_id, s.step,
                 (coalesce(s.value, v.fallback) - v.mean) / v.scale AS value, (coalesce(s.k, k.fallback) - k.mean) / k.scale AS k,
                 (coalesce(s.active, a.fallback) - a.mean) / a.scale AS active,
                 s.bin_observed_fraction
               FROM steps s, (SELECT * FROM parameters WHERE channel = 'value') v,
                 (SELECT * FROM parameters WHERE channel = 'k') k, (SELECT * FROM parameters WHERE channel = 'active') a""",
            f"{STEP_CTES},\n{FITTED}",
        ),
        "value", "k", "active", OBSERVED,
    ),
)
def nm2(study):
    study, steps = _stored(study)
    return apply_normalizer(steps, _parameters(study, steps), CHANNELS).select("window_id", "step", *CHANNELS)
