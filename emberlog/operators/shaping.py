"""Field selection and the size guard of a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.jsontext import quote
from emberlog.functions.paths import event_json, event_line, path_text, path_tree, split_path

# Ways out offered with a blocked result.
SUGGESTIONS = (
    '[{"action":"limit","example":{"limit":50}},'
    '{"action":"fields","example":{"fields":["ts","level","message"]}},'
    '{"action":"text","example":{"format":"text","template":"{ts}|{service}|{message}"}},'
    '{"action":"max_message_chars","example":{"max_message_chars":200}},'
    '{"action":"force","example":{"force":true}}]'
)


def project_fields(df: DataFrame, fields: Sequence[str], flatten: bool = False) -> DataFrame:
    """Listed fields in their order, unknown ones ignored, NULL where absent.

    A dotted path gives a struct column holding the leaf, or with ``flatten`` a column named
    like the path. Leaves inside ``data`` are text: strings bare, other values as JSON.
    """
    if flatten:
        known = [f for f in dict.fromkeys(fields) if split_path(f)]
        return df.select(*[_leaf(split_path(f)).alias(f) for f in known])

    def column(prefix: list[str], node: dict | None) -> Column:
        if node is None:
            return _leaf(prefix)
        return F.struct(*[column([*prefix, k], v).alias(k) for k, v in node.items()])

    return df.select(*[column([k], v).alias(k) for k, v in path_tree(list(fields)).items()])


def _leaf(parts: list[str]) -> Column:
    return F.col(parts[0]) if len(parts) == 1 else path_text(parts)


def row_payload(
    fmt: str = "json",
    fields: Sequence[str] | None = None,
    flatten: bool = False,
    template: str | None = None,
) -> Column:
    """The answer text of one event: a text line, or a JSON object."""
    if fmt == "text":
        return event_line(template)
    return event_json(list(fields) if fields else None, flatten)


def output_cap(value: float | None) -> int | None:
    """A usable cap in characters; None when there is none."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return None
    whole = int(value // 1)
    return whole if whole > 0 else None


def payload_size(payload: Column, fmt: str) -> Column:
    """Characters a row takes up in an answer: its compact JSON, text lines as JSON strings."""
    return F.length(quote(payload) if fmt == "text" else payload).cast("bigint")


def guard_report(
    sized: DataFrame,
    max_chars: float | None,
    force: bool = False,
    fmt: str = "json",
    truncated: Column | None = None,
) -> DataFrame:
    """One row saying whether a result may be returned whole.

    ``sized`` has ``size`` (see :func:`payload_size`) and the untrimmed ``message``.
    """
    cap = output_cap(max_chars)
    size = F.length("message")
    report = sized.agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("estimated_output_chars"),
        F.count(F.lit(1)).alias("item_count"),
        F.coalesce(F.floor(F.avg(size) + 0.5), F.lit(0)).cast("bigint").alias("avg_message_chars"),
        F.coalesce(F.max(size), F.lit(0)).cast("bigint").alias("max_message_chars"),
        (F.lit(False) if truncated is None else truncated).alias("truncated"),
    )
    blocked = F.lit(False) if force or cap is None else F.col("estimated_output_chars") > cap
    text = (
        f"The answer is larger than allowed ({cap}). "
        "Ask for less, or set force to get it whole."
    )
    return report.select(
        F.when(blocked, "output_too_large").alias("code"),
        blocked.alias("blocked"),
        F.when(blocked, text).alias("message"),
        F.lit(cap).cast("bigint").alias("max_output_chars"),
        "estimated_output_chars",
        F.lit(fmt).alias("format"),
        "item_count",
        "truncated",
        "avg_message_chars",
        "max_message_chars",
        F.when(blocked, SUGGESTIONS).alias("suggestions"),
    )
