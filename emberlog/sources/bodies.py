"""Request and stdin bodies as events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.jsontext import NESTED, bind, is_json, read_items
from emberlog.functions.times import trimmed
from emberlog.sources.store import event_columns, read_event_object

# Fixed value: the largest body accepted, in bytes.
MAX_BODY_BYTES = 512_000

_ITEMS = "array<struct<kind:string,text:string>>"


def _items_of(text: Column) -> Column:
    """Items of a valid JSON body: the elements of an array, or the one value."""
    kind = (
        F.when(text.startswith("{"), "OBJECT").otherwise("SCALAR")
    )
    single = F.array(F.struct(kind.alias("kind"), text.alias("text"))).cast(_ITEMS)
    return F.when(text.startswith("["), read_items(text)).otherwise(single)


def _explode_events(df: DataFrame, keys: Sequence[str], items: Column) -> DataFrame:
    rows = df.select(*keys, F.posexplode(items).alias("item_no", "_item"))
    # An array inside an array is an event without any field.
    text = F.when(F.col("_item.kind") == "ARRAY", F.lit("{}")).otherwise(F.col("_item.text"))
    keep = (*keys, "item_no")
    parsed = bind(rows.select(*keep, text.alias("_text")), _event=read_event_object(F.col("_text")))
    return event_columns(parsed, F.col("_event"), F.col("_text"), keep)


def _is_record(item: Column) -> Column:
    return item["kind"].isin(*NESTED)


def ingest_documents(
    df: DataFrame,
    keys: Sequence[str],
    body: str = "body",
    service: str | None = None,
    session_id: str | None = None,
) -> DataFrame:
    """Bodies that are a JSON array, one object, or one JSON value per line.

    Items that are no object are passed over. A body with a bad line gives nothing at all.
    ``service`` and ``session_id`` fill in where an item has none or an empty one.
    """
    text = trimmed(F.col(body))
    whole = bind(df.select(*keys, text.alias("_body")), _whole=is_json(F.col("_body")))
    trimmed_body = F.col("_body")
    # A line of blanks only is no JSON, so it refuses the body like any other bad line.
    lines = F.filter(F.split(trimmed_body, r"\r?\n"), lambda x: x != "")
    from_lines = F.when(
        F.forall(lines, is_json), F.transform(lines, lambda x: _line_item(trimmed(x)))
    )
    items = F.when(F.col("_whole"), _items_of(trimmed_body)).when(trimmed_body != "", from_lines)
    bound = bind(whole, _items=F.filter(items, _is_record))
    events = _explode_events(bound, keys, F.col("_items"))
    for name, value in (("service", service), ("session_id", session_id)):
        if value:
            empty = F.coalesce(F.col(name), F.lit("")) == ""
            events = events.withColumn(name, F.when(empty, value).otherwise(F.col(name)))
    return events


def _line_item(text: Column) -> Column:
    kind = F.when(text.startswith("{"), "OBJECT").when(text.startswith("["), "ARRAY").otherwise("SCALAR")
    return F.struct(kind.alias("kind"), text.alias("text"))


def _classified(df: DataFrame, keys: Sequence[str], body: str, max_bytes: int) -> DataFrame:
    small = F.octet_length(F.col(body)) <= max_bytes
    text = F.when(small, trimmed(F.col(body)))
    checked = bind(df.select(*keys, small.alias("_small"), text.alias("_body")), _valid=is_json(F.col("_body")))
    items = F.when(F.col("_valid"), _items_of(F.col("_body")))
    bound = bind(checked, _items=items)
    outcome = (
        F.when(~F.col("_small"), "too_large")
        .when(~F.col("_valid"), "invalid_json")
        .when(F.forall("_items", _is_record), "ok")
        .otherwise("invalid_payload")
    )
    return bound.withColumn("outcome", outcome)


def ingest_outcomes(
    df: DataFrame, keys: Sequence[str], body: str = "body", max_bytes: int = MAX_BODY_BYTES
) -> DataFrame:
    """Per body: ok with its item count, too_large, invalid_json or invalid_payload."""
    ok = F.col("outcome") == "ok"
    return _classified(df, keys, body, max_bytes).select(
        *keys, "outcome", F.when(ok, F.size("_items").cast("bigint")).alias("count")
    )


def ingest_bodies(
    df: DataFrame, keys: Sequence[str], body: str = "body", max_bytes: int = MAX_BODY_BYTES
) -> DataFrame:
    """Events of the bodies whose outcome is ok; one bad item refuses its whole body."""
    good = _classified(df, keys, body, max_bytes).filter(F.col("outcome") == "ok")
    return _explode_events(good, keys, F.col("_items"))
