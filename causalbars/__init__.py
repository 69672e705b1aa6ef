"""Leakage-safe time-series analytics as Spark DataFrame transformations."""
