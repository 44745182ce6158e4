"""Severity columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.model import LEVELS

# Words looked for in a message, first hit wins.
_INFER_ORDER = ("fatal", "error", "warn", "debug", "trace")


def normalize_level(level: Column) -> Column:
    """Lower-case level name; NULL when it is none of the known ones."""
    name = F.lower(level)
    return F.when(name.isin(*LEVELS), name)


def infer_level(message: Column) -> Column:
    """Level guessed from words in the message, ``info`` without any."""
    text = F.lower(F.coalesce(message, F.lit("")))
    guess = F.lit("info")
    for word in reversed(_INFER_ORDER):
        guess = F.when(F.contains(text, F.lit(word)), word).otherwise(guess)
    return guess


def is_error(level: Column) -> Column:
    return F.coalesce(level.isin("error", "fatal"), F.lit(False))
