"""Queries over the benchmark tables, one per operator, with their DuckDB counterparts."""

from emberlog.catalog import reading, searching, shaping  # noqa: F401
from emberlog.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
