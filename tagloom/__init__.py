"""Spark-first analytics for tagged media libraries."""
