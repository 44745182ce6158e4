"""Counts, session summaries and message sizes.

Every grouping aggregates map-side before its shuffle, so a key holding a large share of
all rows sends one partial row per input task, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.jsontext import string_of
from emberlog.functions.levels import is_error
from emberlog.functions.times import event_time_ms, iso_text, spelled, spelling
from emberlog.model import TYPED_DATA

GROUPINGS = ("type", "level", "stage")

# The spelling of a time that is its instant in ISO form.
_ISO = "="


def stage_of(data: Column) -> Column:
    """``data.stage`` when it is a string, else ``unknown``; ``data`` is compact text."""
    # Compact text spells the key one way, so rows without it are not parsed at all.
    stage = F.from_json(data, "stage variant")["stage"]
    text = F.when(F.contains(data, F.lit('"stage"')), string_of(stage))
    return F.coalesce(text, F.lit("unknown"))


def typed_stage(data: Column) -> Column:
    """The same of ``data`` as VARIANT."""
    return F.coalesce(string_of(F.try_variant_get(data, "$.stage", "variant")), F.lit("unknown"))


def stats(df: DataFrame, group_by: str) -> DataFrame:
    """``(key, count)`` per type, level or stage. A stage is read from ``data_v`` where ``df`` has it."""
    if group_by not in GROUPINGS:
        raise ValueError(f"group_by must be one of {', '.join(GROUPINGS)}")
    key = F.col(group_by) if group_by != "stage" else None
    if key is None:
        key = typed_stage(F.col(TYPED_DATA)) if TYPED_DATA in df.columns else stage_of(F.col("data"))
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"))


def session_parts(df: DataFrame) -> DataFrame:
    """Sessions by how their times are written: counts, and the greatest instant ``us`` of each spelling.

    Carrying text through an aggregate would make Spark sort all rows, so the wide step aggregates
    numbers only. Nearly every text is its instant in one of a few spellings, which are part of the
    key and give the text back from the instant; only a text that is no such thing is a key itself.
    """
    iso = F.col("ts") == iso_text(F.col("ts_ms"))
    how = spelling(F.col("ts"))
    rows = df.filter(F.col("session_id") != "").select(
        "session_id", "ts", "ts_ms", F.when(iso, F.lit(_ISO)).otherwise(how).alias("how"),
        F.when(~iso & how.isNotNull(), F.unix_micros(F.try_to_timestamp("ts"))).alias("us"),
        is_error(F.col("level")).cast("bigint").alias("failed"),
    )
    # A time that does not come back as it was, or is of another millisecond, is kept as a text.
    told = F.expr("(us - pmod(us, 1000)) div 1000") == F.col("ts_ms")
    told = F.coalesce((F.col("how") == _ISO) | (told & (spelled(F.col("us"), F.col("how")) == F.col("ts"))), F.lit(False))
    return (
        rows.select(
            "session_id", F.when(told, F.col("how")).alias("how"), F.when(~told, F.col("ts")).alias("odd_ts"),
            F.when(told, F.col("us")).alias("us"), F.coalesce("ts_ms", F.lit(0)).alias("ms"), "failed",
        )
        .groupBy("session_id", "how", "odd_ts")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("failed"), F.max("us").alias("us"), F.max("ms").alias("ms"))
    )


def sessions(df: DataFrame) -> DataFrame:
    """``(session_id, last_ts, event_count, error_count)`` plus ``last_ms`` for ordering.

    ``last_ts`` is the text of the latest event; one without a readable time counts as
    epoch 0, and of equal times, in milliseconds, the greatest text is taken.
    """
    text = (
        F.when(F.col("how") == _ISO, iso_text(F.col("ms")))
        .when(F.col("how").isNotNull(), spelled(F.col("us"), F.col("how")))
        .otherwise(F.col("odd_ts"))
    )
    return session_parts(df).groupBy("session_id").agg(
        F.max_by(text, F.struct("ms", text.alias("text"))).alias("last_ts"),
        F.sum("n").alias("event_count"),
        F.sum("failed").alias("error_count"),
        F.max("ms").alias("last_ms"),
    )


def merge_stats(parts: DataFrame) -> DataFrame:
    """Add up ``(key, count)`` tables of several sources."""
    return parts.groupBy("key").agg(F.sum("count").alias("count"))


def merge_sessions(parts: DataFrame) -> DataFrame:
    """Combine session tables of several sources: counts add up, the latest time wins.

    Times are those of ``last_ms``, since a text alone does not tell them (a store line may
    give its time as a number); tables without that column are compared by the text. Where the
    events are at hand, pool them and aggregate once.
    """
    told = "last_ms" in parts.columns
    ms = F.col("last_ms") if told else F.coalesce(event_time_ms(F.col("last_ts")), F.lit(0))
    return parts.groupBy("session_id").agg(
        F.max_by("last_ts", F.struct(ms, F.col("last_ts"))).alias("last_ts"),
        F.sum("event_count").alias("event_count"),
        F.sum("error_count").alias("error_count"),
        F.max(ms).alias("last_ms"),
    )


def message_stats(df: DataFrame, column: str = "message") -> DataFrame:
    """One row: rounded average and greatest message length; 0 and 0 without messages."""
    size = F.length(column)
    return df.agg(
        F.coalesce(F.floor(F.avg(size) + 0.5), F.lit(0)).cast("bigint").alias("avg_message_chars"),
        F.coalesce(F.max(size), F.lit(0)).cast("bigint").alias("max_message_chars"),
    )
