"""Newest-first results and top-k tables.

A sort with a limit keeps N rows per task and never sorts the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.times import utc_day

HOUR_MS = 3_600_000
_EARLIEST = -(1 << 63)


def newest_order() -> list[Column]:
    """Latest first, events without a readable time last, ids deciding ties."""
    return [F.coalesce("ts_ms", F.lit(0)).desc(), F.col("id").asc()]


def check_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError(f"limit must be a positive whole number, not {limit!r}")
    return limit


def newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(*newest_order()).limit(check_limit(limit))


def _hour_start() -> Column:
    ms = F.coalesce("ts_ms", F.lit(0).cast("bigint"))
    return F.coalesce(F.try_subtract(ms, F.pmod(ms, F.lit(HOUR_MS))), F.lit(_EARLIEST))


def newest_since(df: DataFrame, limit: int) -> int | None:
    """Start of the hour that the last of the newest rows lies in; None if there are fewer rows.

    Runs a count by hour, which reads no column but the time and what filters of ``df`` read. The
    newest N rows lie in the newest N hours that have any, so no more hours are added up.
    """
    hours = df.groupBy(_hour_start().alias("start")).agg(F.count(F.lit(1)).alias("n"))
    last = hours.orderBy(F.col("start").desc()).limit(check_limit(limit))
    total = F.sum("n").over(Window.orderBy(F.col("start").desc()))
    return last.withColumn("total", total).filter(F.col("total") >= limit).agg(F.max("start")).first()[0]


def newest_since_each(df: DataFrame, key: str, limits: dict[int, int]) -> dict[int, int]:
    """:func:`newest_since` for the rows of each number in ``key``, in one run; numbers with fewer rows
    than their limit are not told. Hours, not rows, are ranked, and a number has one row per hour."""
    asked = F.array(*[F.lit(limits.get(n, 1)) for n in range(max(limits) + 1)])
    hours = df.groupBy(key, _hour_start().alias("start")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(key).orderBy(F.col("start").desc()))
    reached = hours.withColumn("total", total).filter(F.col("total") >= F.get(asked, F.col(key)))
    return {r[0]: r[1] for r in reached.groupBy(key).agg(F.max("start")).collect()}


def at_or_after(since: int, day_column: str | None = None) -> Column:
    """Rows that rank at or after an instant, by a bound on time and day that reaches the scan."""
    bound = F.lit(since).cast("bigint")
    if since <= 0:
        # Rows without a readable time rank as time 0.
        return F.col("ts_ms").isNull() | (F.col("ts_ms") >= bound)
    kept = F.col("ts_ms") >= bound
    if day_column:
        # A time beyond all dates has no day.
        kept = kept & (F.col(day_column).isNull() | (F.col(day_column) >= utc_day(bound)))
    return kept


def newest_part(df: DataFrame, limit: int, day_column: str | None = None) -> DataFrame:
    """The rows of ``df`` among which the newest are, ties included. Runs :func:`newest_since` at once."""
    since = newest_since(df, limit)
    return df if since is None else df.filter(at_or_after(since, day_column))


def newest_ranked(df: DataFrame, limit: int) -> DataFrame:
    """The newest rows numbered from 1 in ``rank``."""
    return newest(df, limit).withColumn(
        "rank", F.row_number().over(Window.orderBy(*newest_order()))
    )


def top_buckets(buckets: DataFrame, limit: int) -> DataFrame:
    """Most frequent keys first, ties by key."""
    return buckets.orderBy(F.col("count").desc(), F.col("key").asc()).limit(check_limit(limit))


def top_sessions(table: DataFrame, limit: int) -> DataFrame:
    """Sessions with the latest activity first, ties by session id."""
    order = [F.col("last_ms").desc(), F.col("session_id").asc()]
    return table.orderBy(*order).limit(check_limit(limit))


def is_truncated(returned: Column, sources: Column, limit: int | Column) -> Column:
    """Whether a result was cut, from up to ``limit + 1`` rows and the sources they are from.

    A result that fills its limit from a single source counts as cut, too.
    """
    return (returned > limit) | ((returned == limit) & (sources <= 1))


def source_key() -> Column:
    """What tells the sources of a result apart."""
    return F.concat_ws("\u0000", F.coalesce(F.col("source.backend"), F.lit("")), F.col("source.backend_id"))
