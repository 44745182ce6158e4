"""The event table: one row per telemetry event."""

from __future__ import annotations

from pyspark.sql import types as T

# The event fields, in the order they are written to a line.
EVENT_FIELDS = (
    "id", "ts", "level", "type", "service", "run_id", "session_id",
    "message", "data", "tags", "trace_id", "span_id", "source",
)

# The severity names, least severe first.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")

# Further spellings a structured pod log line may carry.
POD_RECORD_KEYS = (
    "ts", "timestamp", "time", "@timestamp", "level", "severity", "message", "msg", "log",
)

# What counts as white space when text is trimmed or split into words.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

SOURCE_TYPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("backend", T.StringType()),
    T.StructField("backend_id", T.StringType()),
])

TAGS_TYPE = T.MapType(T.StringType(), T.StringType())

_TYPES = {"tags": TAGS_TYPE, "source": SOURCE_TYPE}

# ``data`` is an open JSON object kept as compact text: VARIANT re-sorts keys, and both
# substring search over it and templates show the order the producer wrote.
# ``ts`` is kept word for word; ``ts_ms`` is its instant, NULL when it cannot be read.
EVENT_SCHEMA = T.StructType(
    [T.StructField(name, _TYPES.get(name, T.StringType())) for name in EVENT_FIELDS]
    + [T.StructField("ts_ms", T.LongType())]
)

# ``data`` as VARIANT, in frames read from a store that keeps it beside the text.
TYPED_DATA = "data_v"
