"""Pod log lines as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.jsontext import entries_text, object_text, quote
from emberlog.functions.levels import infer_level
from emberlog.functions.records import (
    Record,
    append_text,
    entry_list,
    overlay,
    parse_records,
)
from emberlog.functions.times import coerce_timestamp, event_time_ms, split_log_line, trimmed
from emberlog.model import EVENT_FIELDS, EVENT_SCHEMA, POD_RECORD_KEYS
from emberlog.operators.events import source_struct

_META = ("pod", "container", "raw_message")


def service_of_selector(selector: Column) -> Column:
    """Value of the first ``label=value`` of a selector; NULL without one."""
    parts = F.split(trimmed(F.element_at(F.split(selector, ","), 1)), "=")
    value = F.get(parts, 1)
    return F.when((F.size(parts) == 2) & (value != ""), trimmed(value))


def scan_pod_logs(
    df: DataFrame,
    selector: str | Column,
    now_ms: int,
    service: str | None = None,
    backend_id: str | None = None,
) -> DataFrame:
    """Rows ``(pod, container, line)`` as events; blank lines are skipped.

    The line may start with a timestamp. The rest is mapped field by field when it is a JSON
    object with an event field or a usual log spelling (``severity``, ``msg``, ``time``, …).
    Row ids are random unless the record carries one.
    """
    rule = F.lit(selector) if isinstance(selector, str) else selector
    derived = F.coalesce(service_of_selector(rule), F.lit("k8s"))
    ts, message = split_log_line(F.col("line"), now_ms)
    rows = df.filter(trimmed(F.col("line")) != "").select(
        F.col("pod").alias("_pod"),
        F.col("container").alias("_container"),
        ts.alias("_ts"),
        message.alias("_message"),
        (F.lit(service) if service is not None else derived).alias("_service"),
        F.uuid().alias("_id"),
    )
    return _map_records(rows, backend_id)


def map_pod_records(
    df: DataFrame, service: str, backend_id: str | None = None
) -> DataFrame:
    """Rows ``(pod, container, ts, message)``, the line already split, as events."""
    rows = df.select(
        F.col("pod").alias("_pod"),
        F.col("container").alias("_container"),
        F.col("ts").alias("_ts"),
        F.col("message").alias("_message"),
        F.lit(service).alias("_service"),
        F.uuid().alias("_id"),
    )
    return _map_records(rows, backend_id)


def _map_records(rows: DataFrame, backend_id: str | None) -> DataFrame:
    record = Record()
    parsed = parse_records(rows, trimmed(F.col("_message")))
    readable = ~record.unreadable_level("level") & (
        record.level_known("level") | ~record.unreadable_level("severity")
    )
    raw = F.col("_message")
    pod, container, text = (
        quote(F.col("_pod")),
        F.when(F.col("_container").isNotNull(), quote(F.col("_container"))),
        quote(raw),
    )
    meta = object_text(("pod", pod), ("container", container), ("raw_message", text))
    parsed = parsed.withColumns({
        "_structured": record.has_any((*EVENT_FIELDS, *POD_RECORD_KEYS)) & readable,
        "_meta": meta,
    })
    structured = F.col("_structured")
    # The usual record brings no key of ours and nothing nested beside ``data``: its text is
    # appended as a whole. Others are put together entry by entry.
    whole = F.when(
        record.has_data(),
        F.when(~record.data_is_array() & ~record.data_has(_META), record.data_json()),
    ).otherwise(F.when(~record.has_any(_META), record.flat_extra()))
    parsed = parsed.withColumn("_whole", F.when(structured, whole))
    single = structured & F.col("_whole").isNull()
    own = F.when(record.has_data(), record.data_entries()).otherwise(record.extra_entries())
    parsed = parsed.withColumn("_own", F.when(single, own))
    entries = entry_list(("pod", pod), ("container", container), ("raw_message", text))
    data = (
        F.when(~structured, F.col("_meta"))
        .when(F.col("_whole").isNotNull(), append_text(F.col("_meta"), F.col("_whole")))
        .otherwise(entries_text(overlay(entries, F.col("_own"), _META, record.data_is_array())))
    )

    record_ts = record.string("ts")
    found_ts = F.coalesce(
        F.when(trimmed(record_ts) != "", record_ts),
        *[coerce_timestamp(record.field(n)) for n in ("ts", "timestamp", "time", "@timestamp")],
        F.col("_ts"),
    )
    source = record.source_fields()

    def pick(found: Column, plain: Column) -> Column:
        return F.when(structured, found).otherwise(plain)

    columns = {
        "id": pick(F.coalesce(record.string("id"), F.col("_id")), F.col("_id")),
        "ts": pick(found_ts, F.col("_ts")),
        "level": pick(record.level(raw, "level", "severity"), infer_level(raw)),
        "type": pick(F.coalesce(record.string("type"), F.lit("log")), F.lit("log")),
        "service": pick(F.coalesce(record.string("service"), F.col("_service")), F.col("_service")),
        "run_id": pick(F.coalesce(record.string("run_id"), F.col("_pod")), F.col("_pod")),
        "session_id": F.when(structured, record.string("session_id")),
        "message": pick(F.coalesce(record.message(), raw), raw),
        "data": data,
        "tags": F.when(structured, record.tags()),
        "trace_id": F.when(structured, record.string("trace_id")),
        "span_id": F.when(structured, record.string("span_id")),
        "source": source_struct(
            kind=F.lit("mcp"),
            backend=F.lit("k8s"),
            file=F.when(structured, source["file"]),
            line=F.when(structured, source["line"]),
            backend_id=F.lit(backend_id)
            if backend_id is not None
            else F.when(structured, source["backend_id"]),
        ),
    }
    events = parsed.select(*[columns[f].alias(f) for f in EVENT_FIELDS])
    return events.withColumn("ts_ms", event_time_ms(F.col("ts"))).select(*EVENT_SCHEMA.names)
