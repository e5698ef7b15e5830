"""Early-warning analytics over sensor telemetry, written as plain Spark DataFrame operators."""
