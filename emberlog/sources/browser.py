"""Browser console calls, window errors and unhandled rejections as event fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.jsontext import (
    STRICT, bind, compact, kind_of, object_text, quote, read_items, string_of,
)
from emberlog.operators.events import source_struct

# Console methods whose name is a level; all others log as info.
_METHOD_LEVELS = ("trace", "debug", "warn", "error")


def console_to_events(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(method, args)``, args a JSON array, as console events.

    The message joins the arguments by a space: strings bare, everything else as JSON.
    """
    method = F.col("method")
    parsed = bind(df, _args=read_items(F.col("args")))
    message = F.array_join(F.transform("_args", lambda a: a["text"]), " ")
    return parsed.select(
        *keys,
        F.lit("console").alias("type"),
        F.when(method.isin(*_METHOD_LEVELS), method).otherwise("info").alias("level"),
        F.coalesce(message, F.lit("")).alias("message"),
        object_text(("args", F.coalesce(compact(F.col("args")), F.lit("[]")))).alias("data"),
        source_struct(kind=F.lit("sdk")).alias("source"),
    )


def _error_fields(value: Column, text: Column) -> Column:
    """The reported error as JSON: name, message and stack of an object, else its text."""
    kind = kind_of(value)
    fields = F.from_json(text, "name variant, message variant, stack variant", STRICT)

    def member(name: str) -> tuple[str, Column]:
        found = string_of(fields[name])
        return name, F.when(found.isNotNull(), quote(found))

    return (
        F.when(kind == "OBJECT", object_text(member("name"), member("message"), member("stack")))
        .when(kind == "ARRAY", F.lit("{}"))
        .when(kind != "VOID", object_text(("message", quote(value.cast("string")))))
    )


def browser_errors_to_events(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(kind, message, filename, lineno, colno, error, reason, reason_is_error)``.

    ``kind`` is ``error`` or ``rejection``; ``error`` and ``reason`` are JSON texts.
    """
    parsed = bind(
        df,
        _error=F.from_json(F.concat(F.lit('{"v":'), F.col("error"), F.lit("}")), "v variant", STRICT)["v"],
        _reason=F.from_json(F.concat(F.lit('{"v":'), F.col("reason"), F.lit("}")), "v variant", STRICT)["v"],
    )
    is_error = F.col("kind") == "error"
    error, reason = F.col("_error"), F.col("_reason")
    own = F.coalesce(
        string_of(error),
        string_of(F.from_json(F.col("error"), "message variant", STRICT)["message"]),
        F.lit(""),
    )
    error_message = F.when(F.col("message") != "", F.col("message")).otherwise(own)
    reason_message = F.when(
        F.coalesce(F.col("reason_is_error"), F.lit(False)),
        string_of(F.from_json(F.col("reason"), "message variant", STRICT)["message"]),
    ).otherwise(
        F.coalesce(string_of(reason), _json_text(F.col("reason")), F.lit(""))
    )
    file = F.when(F.col("filename") != "", F.col("filename"))
    data = F.when(
        is_error,
        object_text(
            ("filename", F.when(file.isNotNull(), quote(file))),
            ("lineno", F.col("lineno").cast("string")),
            ("colno", F.col("colno").cast("string")),
            ("error", _error_fields(error, F.col("error"))),
        ),
    ).otherwise(object_text(("reason", _json_text(F.col("reason")))))
    return parsed.select(
        *keys,
        F.when(is_error, "window.error").otherwise("unhandledrejection").alias("type"),
        F.lit("error").alias("level"),
        F.when(is_error, error_message).otherwise(reason_message).alias("message"),
        data.alias("data"),
        source_struct(
            kind=F.lit("sdk"),
            file=F.when(is_error, file),
            line=F.when(is_error, F.col("lineno")),
        ).alias("source"),
    )


def _json_text(text: Column) -> Column:
    """Compact spelling of any JSON value."""
    return F.when(text.startswith("{") | text.startswith("["), compact(text)).otherwise(text)
