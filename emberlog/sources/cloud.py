"""Cloud log rows as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.jsontext import entries_text, object_text, quote
from emberlog.functions.levels import infer_level
from emberlog.functions.records import Record, parse_records
from emberlog.functions.times import event_time_ms, iso_text, trimmed
from emberlog.model import EVENT_FIELDS, EVENT_SCHEMA
from emberlog.operators.events import source_struct


def service_of_group(log_group: Column) -> Column:
    """Last path segment of a log group, or the whole name when that is empty."""
    name = trimmed(log_group)
    last = F.element_at(F.split(name, "/"), -1)
    return F.when(last != "", last).otherwise(name)


def scan_cloud_logs(
    df: DataFrame,
    log_group: str | Column,
    now_ms: int,
    service: str | None = None,
    backend_id: str | None = None,
) -> DataFrame:
    """Rows ``(eventId, timestamp, message, logStreamName)`` as events.

    A message that is a JSON object with at least one event field is mapped field by field.
    Everything else, also a record whose level is no text, becomes a plain log event.
    """
    group = F.lit(log_group) if isinstance(log_group, str) else log_group
    message = F.coalesce(F.col("message"), F.lit(""))
    row_id = F.coalesce(F.col("eventId"), F.uuid())
    rows = df.select(
        row_id.alias("_id"),
        F.coalesce("logStreamName", "eventId").alias("_run"),
        F.col("logStreamName").alias("_stream"),
        iso_text(
            F.coalesce(
                F.when(F.col("timestamp") != 0, F.col("timestamp")), F.lit(now_ms)
            ).cast("bigint")
        ).alias("_ts"),
        message.alias("_message"),
        (F.lit(service) if service is not None else service_of_group(group)).alias("_service"),
    )
    record = Record()
    parsed = parse_records(rows, trimmed(F.col("_message")))
    readable = record.has_any(EVENT_FIELDS) & ~record.unreadable_level("level")
    parsed = parsed.withColumn("_structured", readable)
    structured = F.col("_structured")
    raw = F.col("_message")
    raw_text = quote(raw)
    run = F.coalesce("_run", "_id")
    plain_data = object_text(
        ("logStreamName", F.when(F.col("_stream").isNotNull(), quote(F.col("_stream")))),
        ("raw_message", raw_text),
    )
    parsed = parsed.withColumn(
        "_flat", F.when(structured & ~record.has_data(), record.flat_extra())
    )
    nested = structured & ~record.has_data() & F.col("_flat").isNull()
    parsed = parsed.withColumn("_extra", F.when(nested, record.extra_entries()))
    record_data = F.coalesce(
        record.data_json(),
        F.when(F.col("_flat") != "{}", F.col("_flat")),
        F.when(F.size("_extra") > 0, entries_text(F.col("_extra"))),
        object_text(("raw_message", raw_text)),
    )
    source = record.source_fields()

    def pick(found: Column, plain: Column) -> Column:
        return F.when(structured, found).otherwise(plain)

    ts = pick(F.coalesce(record.string("ts"), F.col("_ts")), F.col("_ts"))
    columns = {
        "id": pick(F.coalesce(record.string("id"), F.col("_id")), F.col("_id")),
        "ts": ts,
        "level": pick(record.level(raw, "level"), infer_level(raw)),
        "type": pick(F.coalesce(record.string("type"), F.lit("log")), F.lit("log")),
        "service": pick(F.coalesce(record.string("service"), F.col("_service")), F.col("_service")),
        "run_id": pick(F.coalesce(record.string("run_id"), run), run),
        "session_id": F.when(structured, record.string("session_id")),
        "message": pick(F.coalesce(record.string("message"), raw), raw),
        "data": pick(record_data, plain_data),
        "tags": F.when(structured, record.tags()),
        "trace_id": F.when(structured, record.string("trace_id")),
        "span_id": F.when(structured, record.string("span_id")),
        "source": source_struct(
            kind=F.lit("mcp"),
            backend=F.lit("cloudwatch"),
            file=F.when(structured, source["file"]),
            line=F.when(structured, source["line"]),
            backend_id=F.lit(backend_id)
            if backend_id is not None
            else F.when(structured, source["backend_id"]),
        ),
    }
    events = parsed.select(*[columns[f].alias(f) for f in EVENT_FIELDS])
    return events.withColumn("ts_ms", event_time_ms(F.col("ts"))).select(*EVENT_SCHEMA.names)
