"""Imports the modules that register queries."""

from emberlog.llm import (  # noqa: F401
    clustering, decontamination, exact_dedup, hard_negatives, html_text, jaccard_join, language_id, mixing,
    packing, quality_rules, sharding, toxicity, url_filter,
)
from emberlog.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
