"""Event predicates. Each is a Column, so Spark pushes what it can into the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.msgquery import message_query
from emberlog.functions.times import utc_day


def contains_text(needle: str) -> Column:
    """Substring, any case, in the message, type, session id or data text.

    An event without a type matches by its message only.
    """
    text = F.lower(F.lit(needle))

    def hit(column: str) -> Column:
        return F.coalesce(F.contains(F.lower(F.col(column)), text), F.lit(False))

    # An empty needle is inside every text, also the empty one a missing message stands for.
    message = F.contains(F.lower(F.coalesce(F.col("message"), F.lit(""))), text)
    rest = hit("type") | hit("session_id") | hit("data")
    return message | (F.col("type").isNotNull() & rest)


def time_range(
    since: Column | None, until: Column | None, day_column: str | None = None
) -> Column | None:
    """Inclusive bounds in epoch ms. Events without a readable time pass, as does a NULL bound.

    With ``day_column`` the store's day partitions are pruned too; the partition of events
    without a time is always kept.
    """
    ms = F.col("ts_ms")
    tests = []
    if since is not None:
        tests.append(ms.isNull() | since.isNull() | (ms >= since))
        if day_column:
            day = F.col(day_column)
            tests.append(day.isNull() | since.isNull() | (day >= utc_day(since)))
    if until is not None:
        tests.append(ms.isNull() | until.isNull() | (ms <= until))
        if day_column:
            day = F.col(day_column)
            tests.append(day.isNull() | until.isNull() | (day <= utc_day(until)))
    return all_of(tests)


def all_of(tests: Sequence[Column | None]) -> Column | None:
    result = None
    for test in tests:
        if test is not None:
            result = test if result is None else result & test
    return result


def event_filter(
    service: str | None = None,
    session_id: str | None = None,
    run_id: str | None = None,
    types: Sequence[str] | None = None,
    levels: Sequence[str] | None = None,
    contains: str | None = None,
    query: str | None = None,
    since: Column | None = None,
    until: Column | None = None,
    day_column: str | None = None,
) -> Column:
    """All given conditions at once; an empty text or list is no condition."""
    tests = [
        F.col(name) == value
        for name, value in (("service", service), ("session_id", session_id), ("run_id", run_id))
        if value
    ]
    tests += [
        F.col(name).isin(*values)
        for name, values in (("type", types), ("level", levels))
        if values
    ]
    tests.append(time_range(since, until, day_column))
    if contains:
        tests.append(contains_text(contains))
    if query:
        tests.append(message_query(query))
    found = all_of(tests)
    return F.lit(True) if found is None else found


def from_backends(names: Sequence[str] | None) -> Column:
    """Rows whose source type or id is listed; an empty list keeps all."""
    if not names:
        return F.lit(True)
    return F.coalesce(
        F.col("source.backend").isin(*names) | F.coalesce(F.col("source.backend_id").isin(*names), F.lit(False)),
        F.lit(False),
    )
