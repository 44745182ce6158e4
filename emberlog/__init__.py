"""Telemetry search and analytics as Spark DataFrames."""
