"""Timed-text and service-metric analytics expressed as Spark DataFrames."""
