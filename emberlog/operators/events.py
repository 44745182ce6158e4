"""Completing events, stamping where they came from, and redacting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.levels import normalize_level
from emberlog.functions.redaction import RedactionPolicy, redact_data, redact_tags, redact_text
from emberlog.functions.times import event_time_ms, iso_text
from emberlog.model import EVENT_SCHEMA, SOURCE_TYPE


def source_struct(**fields: Column) -> Column:
    """A ``source`` value; fields not given are NULL."""
    return F.struct(
        *[
            fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SOURCE_TYPE.fields
        ]
    )


def complete_events(
    df: DataFrame,
    service: str,
    now_ms: int,
    run_id: str,
    session_id: str | None = None,
    source_kind: str = "sdk",
) -> DataFrame:
    """Fill in what an event lacks. Only NULLs are filled; an unknown level becomes info.

    Generated ids are random, so do not compare them between runs.
    """
    source = F.when(
        F.col("source").isNull(), source_struct(kind=F.lit(source_kind))
    ).otherwise(
        F.col("source").withField(
            "kind", F.coalesce(F.col("source.kind"), F.lit(source_kind))
        )
    )
    ts = F.coalesce("ts", iso_text(F.lit(now_ms).cast("bigint")))
    ms = F.when(F.col("ts").isNull(), F.lit(now_ms)).otherwise(
        F.coalesce("ts_ms", event_time_ms(F.col("ts"))) if "ts_ms" in df.columns
        else event_time_ms(F.col("ts"))
    )
    filled = {
        "id": F.coalesce("id", F.uuid()),
        "ts": ts,
        "level": F.coalesce(normalize_level(F.col("level")), F.lit("info")),
        "type": F.coalesce("type", F.lit("log")),
        "service": F.coalesce("service", F.lit(service)),
        "run_id": F.coalesce("run_id", F.lit(run_id)),
        "session_id": F.coalesce("session_id", F.lit(session_id).cast("string")),
        "source": source,
        "ts_ms": ms.cast("bigint"),
    }
    return df.withColumns(filled)


def tag_source(
    df: DataFrame, backend: str, backend_id: str | None = None, remote: bool = False
) -> DataFrame:
    """Stamp the source a row was read from. Remote sources also set the kind."""
    old = F.col("source")
    kind = F.lit("mcp") if remote else F.coalesce(old["kind"], F.when(old.isNull(), "mcp"))
    stamped = source_struct(
        kind=kind,
        file=old["file"],
        line=old["line"],
        backend=F.lit(backend),
        backend_id=F.lit(backend_id) if backend_id is not None else old["backend_id"],
    )
    return df.withColumn("source", stamped)


def redact_events(df: DataFrame, policy: RedactionPolicy | None = None) -> DataFrame:
    """Redact message, data and tags; nothing else holds free content."""
    policy = policy or RedactionPolicy()
    if not policy.enabled:
        return df
    return df.withColumns({
        "message": redact_text(F.col("message"), policy),
        "data": redact_data(F.col("data"), policy),
        "tags": redact_tags(F.col("tags"), policy),
    })


def as_events(df: DataFrame) -> DataFrame:
    """Add missing event columns as NULL and put the columns in order."""
    have = set(df.columns)
    columns = []
    for field in EVENT_SCHEMA.fields:
        if field.name in have:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.name == "ts_ms":
            columns.append(event_time_ms(F.col("ts")).alias("ts_ms"))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*columns)

