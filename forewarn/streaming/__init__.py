"""Structured Streaming entry points for the row-level operators."""
