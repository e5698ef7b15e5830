"""Gap segmentation: cut a stream of readings where the gap exceeds a limit."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions.ordered import join_summary
from forewarn.functions.quantiles import exact_percentiles
from forewarn.functions.timeline import HOUR, SECOND, floor_div, from_micros, micros
from forewarn.spec import TelemetrySpec, require_columns

# Width of the time slice inside which readings are ordered by one task. After
# validation a slice holds at most one reading per timestamp, so an hour of a
# kilohertz machine is 3.6 million rows and 30 years are 263 thousand slices.
CHUNK_SECONDS = 3600


def _localised(
    df: DataFrame, spec: TelemetrySpec, max_gap_seconds: int, chunk_seconds: int, carry: tuple[str, ...]
) -> DataFrame:
    """Per-chunk view: previous reading, breaks so far and latest break, all local to the chunk."""
    inside = Window.partitionBy(*spec.asset_cols, "__chunk").orderBy("__t")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumn("__t", micros(spec.timestamp)).withColumn(
        "__chunk", floor_div(F.col("__t"), chunk_seconds * SECOND)
    )
    is_break = F.col("__t") - F.col("__previous_t") > max_gap_seconds * SECOND
    return (
        placed.withColumns(
            {"__previous_t": F.lag("__t").over(inside)}
            | {f"__previous_{name}": F.lag(name).over(inside) for name in carry}
        )
        .withColumn("__break_t", F.when(is_break, F.col("__t")))
        .withColumns(
            {
                "__breaks": F.count("__break_t").over(upto),
                "__latest_break": F.max("__break_t").over(upto),
            }
        )
    )


def assign_segments(
    df: DataFrame,
    spec: TelemetrySpec,
    max_gap_seconds: int,
    carry: tuple[str, ...] = (),
    chunk_seconds: int = CHUNK_SECONDS,
    keep: Callable[[DataFrame], DataFrame] = lambda ordered: ordered,
) -> DataFrame:
    """Number the gap-free segments of each asset 0, 1, 2, ... in time order.

    A segment starts where the gap to the previous reading is larger than
    ``max_gap_seconds``. Added columns: ``segment_id``, ``segment_start``,
    ``offset_us`` (microseconds since that start), and ``gap_us``,
    ``previous_timestamp`` and ``previous_<name>`` for each name in ``carry`` (all
    null on the first reading of a segment). All other columns are carried along;
    names that begin with two underscores are reserved for helpers.

    Readings are ordered inside (asset, time slice). One summary row per slice
    carries the segment number, its start and the last reading into the next
    slice, so no task ever holds a whole asset.

    The ordered readings feed both the summary and the result. ``keep`` may store
    them in between (see ``stage_table``): everything after it, here and in later
    operators, is then a plain read joined with the small summary.
    """
    require_columns(df.columns, [*spec.asset_cols, spec.timestamp, *carry], "valid telemetry")
    keys = list(spec.asset_cols)
    gap = max_gap_seconds * SECOND
    localised = keep(_localised(df, spec, max_gap_seconds, chunk_seconds, carry))
    summary = localised.groupBy(*keys, "__chunk").agg(
        F.min("__t").alias("__chunk_first"),
        F.max("__t").alias("__chunk_last"),
        F.count("__break_t").alias("__chunk_breaks"),
        F.max("__break_t").alias("__chunk_latest_break"),
        *[F.max_by(name, "__t").alias(f"__chunk_last_{name}") for name in carry],
    )
    order = Window.partitionBy(*keys).orderBy("__chunk")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    entry = (
        summary.withColumn("__entry_t", F.lag("__chunk_last").over(order))
        # The first reading of a slice starts a segment when it is the very first or follows a gap.
        .withColumn(
            "__entry_break",
            F.coalesce(F.col("__chunk_first") - F.col("__entry_t") > gap, F.lit(True)),
        )
        .withColumn("__opens", F.when(F.col("__entry_break"), F.col("__chunk_first")))
        .withColumn("__newest_start", F.coalesce("__chunk_latest_break", "__opens"))
        .select(
            *keys,
            "__chunk",
            "__entry_t",
            "__entry_break",
            *[F.lag(f"__chunk_last_{name}").over(order).alias(f"__entry_{name}") for name in carry],
            (
                F.sum(F.col("__entry_break").cast("long")).over(upto)
                + F.coalesce(F.sum("__chunk_breaks").over(before), F.lit(0))
                - 1
            ).alias("__base"),
            F.coalesce("__opens", F.max("__newest_start").over(before)).alias("__entry_start"),
        )
    )
    joined = join_summary(localised, keep(entry), [*keys, "__chunk"])
    first_here = F.col("__previous_t").isNull()
    starts = (first_here & F.col("__entry_break")) | F.col("__break_t").isNotNull()
    previous_t = F.coalesce("__previous_t", "__entry_t")
    start_t = F.coalesce("__latest_break", "__entry_start")
    added = {
        "segment_id": F.col("__base") + F.col("__breaks"),
        "segment_start": from_micros(start_t),
        "offset_us": F.col("__t") - start_t,
        "gap_us": F.when(~starts, F.col("__t") - previous_t),
        "previous_timestamp": F.when(~starts, from_micros(previous_t)),
    } | {
        f"previous_{name}": F.when(
            ~starts, F.when(first_here, F.col(f"__entry_{name}")).otherwise(F.col(f"__previous_{name}"))
        )
        for name in carry
    }
    result = joined.withColumns(added)
    return result.select(*df.columns, *[name for name in added if name not in df.columns])


def segment_profile(segmented: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """One row per segment: rows, first and last reading, hours and median positive gap."""
    keys = [*spec.asset_cols, "segment_id"]
    spans = segmented.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("segment_start").alias("segment_start"),
        F.max("offset_us").alias("__length"),
    )
    # Segments are many and their gaps short of the limit, so coarse buckets do.
    gaps = exact_percentiles(
        segmented.where(F.col("gap_us") > 0),
        keys,
        "gap_us",
        {"__median": 0.5},
        keys_are_parameters=False,
        per_octave=64,
    )
    return spans.join(gaps, keys, "left").select(
        *keys,
        "rows",
        "segment_start",
        F.timestamp_add("MICROSECOND", F.col("__length"), F.col("segment_start")).alias("segment_end"),
        (F.col("__length") / float(HOUR)).alias("duration_hours"),
        (F.col("__median") / float(SECOND)).alias("cadence_seconds"),
    )
