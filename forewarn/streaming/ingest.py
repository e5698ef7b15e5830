"""Row checks on a stream: the same rules as in batch, applied as readings arrive.

Only the stateless rules run here (presence, range, domain). Repeated timestamps
and segments depend on rows that may still arrive, so they stay with the batch
operators over the accepted table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forewarn.operators.validation import row_reasons
from forewarn.sources.telemetry import coerce
from forewarn.spec import TelemetrySpec


def check_rows(stream: DataFrame, spec: TelemetrySpec, pattern: str | None = None) -> DataFrame:
    """Typed readings with the rules each one breaks; works on streams and tables alike."""
    return coerce(stream, spec, pattern).withColumn("reasons", row_reasons(spec))


def write_checked(
    checked: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str, **trigger
) -> tuple[StreamingQuery, StreamingQuery]:
    """Append accepted and rejected readings to two parquet tables, each exactly once."""

    def start(rows: DataFrame, path: str, name: str) -> StreamingQuery:
        return (
            rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    broken = F.size("reasons") > 0
    return (
        start(checked.where(~broken).drop("reasons"), accepted_path, "accepted"),
        start(checked.where(broken), rejected_path, "rejected"),
    )
