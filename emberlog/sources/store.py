"""The event store: JSONL trees for exchange, partitioned Parquet for large data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.jsontext import bind, compact, quote, read_object, string_of
from emberlog.functions.paths import event_json
from emberlog.functions.times import event_time_ms, trimmed, utc_day
from emberlog.model import EVENT_FIELDS, EVENT_SCHEMA, SOURCE_TYPE, TYPED_DATA
from emberlog.operators.events import as_events

# Every field is read as text first, so a value of an unexpected type does not reject a line.
# The time may be a text or a number of milliseconds and therefore keeps its JSON type.
# A ``data`` that is a JSON string is told from one that is an object by a second, rare reading.
_LINE_FIELDS = ", ".join(f"`{f}` {'variant' if f == 'ts' else 'string'}" for f in EVENT_FIELDS)

STORE_SCHEMA = T.StructType(
    [f for f in EVENT_SCHEMA.fields if f.name != "service"]
    + [T.StructField("service", T.StringType()), T.StructField("date", T.DateType())]
)


# What an append with ``typed_data`` adds to ``data_v``: whether that holds all of ``data``.
_IS_TYPED = "data_typed"


def parse_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One event per line of JSON; blank and malformed lines are dropped.

    Works on static and streaming frames. ``keep`` names columns carried along.
    """
    text = trimmed(F.col(column))
    parsed = bind(lines.select(*keep, text.alias("_line")), _event=read_object(F.col("_line"), _LINE_FIELDS))
    return event_columns(parsed.filter(F.col("_event").isNotNull()), F.col("_event"), F.col("_line"), keep)


def read_event_object(text: Column) -> Column:
    """A JSON object text as the struct :func:`event_columns` takes."""
    return read_object(text, _LINE_FIELDS)


def event_columns(df: DataFrame, event: Column, text: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Event columns from a struct of raw JSON fields and the text they were read from."""
    ts = event["ts"]
    number = F.when(F.schema_of_variant(ts) != "STRING", F.try_variant_get(ts, "$", "double"))
    columns = {f: event[f] for f in EVENT_FIELDS}
    columns["ts"] = ts.cast("string")
    is_text = text.rlike(r'"data"\s*:\s*"') & string_of(F.from_json(text, "data variant")["data"]).isNotNull()
    columns["data"] = F.when(is_text, quote(event["data"])).otherwise(compact(event["data"]))
    columns["tags"] = F.from_json(event["tags"], "map<string,string>")
    columns["source"] = F.from_json(event["source"], SOURCE_TYPE)
    columns["ts_ms"] = F.coalesce(number.cast("bigint"), event_time_ms(string_of(ts)))
    return df.select(*keep, *[columns[n].alias(n) for n in EVENT_SCHEMA.names])


def scan_events(spark: SparkSession, root: str, service: str | None = None) -> DataFrame:
    """All events of a JSONL tree, ``<service>/<day>/<run>.jsonl`` at any depth.

    With ``service`` only its folders are listed: one of that name, and the one the writer
    makes, which escapes some characters. Events there of another service are left out. A
    missing folder gives no events.
    """
    paths = [root]
    if service:
        top = root.rstrip("/")
        paths = [f"{top}/service={_literal(_folder_name(service))}"]
        if not {".", ".."} & set(service.split("/")):
            paths.append(f"{top}/{_literal(service)}")
    frames = [f for f in (_lines(spark, p) for p in paths) if f is not None]
    if not frames:
        return spark.createDataFrame([], EVENT_SCHEMA)
    lines = frames[0]
    for more in frames[1:]:
        lines = lines.unionAll(more)
    events = parse_lines(lines)
    return events.filter(F.col("service") == service) if service else events


# What Spark escapes in the names of partition folders, besides control characters.
_ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f")


def _folder_name(value: str) -> str:
    """A value as Spark spells it in the name of a partition folder."""
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 else c for c in value)


def _literal(name: str) -> str:
    """A name in a path whose wildcards stand for themselves."""
    return "".join(f"\\{c}" if c in "*?[]{}\\," else c for c in name)


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.jsonl")
            .text(path)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def with_day(df: DataFrame) -> DataFrame:
    """Add the UTC day the store is partitioned by; NULL without a readable time."""
    return df.withColumn("date", utc_day(F.col("ts_ms")))


# Columns that are looked up by a rare value. Their Bloom filters let a reader skip row groups.
LOOKED_UP = ("session_id", "run_id", "trace_id")
BLOOM = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP}


def append_events(
    df: DataFrame, root: str, fmt: str = "parquet", append_id: str | None = None, typed_data: bool = False
) -> None:
    """Append events below ``service=…/date=…``.

    With ``append_id`` the files lie one folder deeper, in ``append=<id>``, and Spark stages and then
    publishes whole folders. An append that is run again under its id, because it was cut off or
    is not known to have ended, replaces its own folders, so each event is there once. A store is
    written either with ids or without.

    With ``typed_data`` Parquet files also hold ``data`` as VARIANT, whose frequent leaves Spark writes as
    columns of their own; :func:`read_typed_store` reads these. Appends with and without may share a store.

    The rebalance groups rows by partition, so each gets few files, and lets adaptive
    execution cut a service or day that holds much of the data into several tasks. Files are
    in time order, which lets readers skip row groups by ``ts_ms``.
    """
    if typed_data and fmt != "parquet":
        raise ValueError("typed_data needs the Parquet format")
    events = with_day(as_events(df)).hint("rebalance", "service", "date")
    ordered = events.sortWithinPartitions("service", "date", "ts_ms")
    by = ["service", "date"]
    if append_id is not None:
        if not append_id:
            raise ValueError("append_id must not be empty")
        ordered = ordered.withColumn("append", F.lit(append_id))
        by.append("append")
    if fmt == "jsonl":
        lines = ordered.select(*by, event_json().alias("value"))
        write_lines(lines, root, *by, replace=append_id is not None)
    elif fmt == "parquet":
        if typed_data:
            ordered = ordered.withColumn(TYPED_DATA, F.try_parse_json("data"))
            whole = F.col("data").isNull() | F.col(TYPED_DATA).isNotNull()
            ordered = ordered.withColumn(_IS_TYPED, whole)
        _by_folder(ordered, by, append_id is not None).options(**BLOOM).parquet(root)
    else:
        raise ValueError(f"unknown store format {fmt!r}")


def _by_folder(df: DataFrame, by: list[str], replace: bool) -> DataFrameWriter:
    """A writer that appends, or that replaces the folders it has rows for and no others."""
    writer = df.write.partitionBy(*by)
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else writer.mode("append")


def write_lines(lines: DataFrame, root: str, *by: str, replace: bool = False) -> None:
    """Append the JSON objects in ``value`` as lines of ``.jsonl`` files, below folders ``by``; with
    ``replace`` in place of what these folders hold.

    The text writer names all files ``.txt``; that of delimited text takes a name. A JSON
    object never begins with a comment sign or holds the separator, so nothing is quoted.
    """
    plain = {"extension": "jsonl", "quote": "", "sep": "\u0001", "ignoreLeadingWhiteSpace": False,
             "ignoreTrailingWhiteSpace": False}
    _by_folder(lines.select(*by, "value"), list(by), replace).options(**plain).csv(root)


def read_store(spark: SparkSession, root: str, service: str | None = None) -> DataFrame:
    """Events of a Parquet store; ``service`` and ``date`` prune folders.

    The column ``date`` stays, for :func:`emberlog.operators.filters.time_range`.
    """
    return _stored(spark, root, STORE_SCHEMA, service).select(*EVENT_SCHEMA.names, "date")


def read_typed_store(spark: SparkSession, root: str, service: str | None = None) -> DataFrame:
    """Like :func:`read_store`, with ``data`` as VARIANT in ``data_v`` besides.

    A query that asks for paths of ``data_v`` reads their leaves only. Rows written without
    ``typed_data`` are parsed from their text; the statistics of the mark that tells them let each of the two
    scans skip the files of the other.
    """
    marks = T.StructType([T.StructField(TYPED_DATA, T.VariantType()), T.StructField(_IS_TYPED, T.BooleanType())])
    df = _stored(spark, root, T.StructType(STORE_SCHEMA.fields + marks.fields), service)
    columns = [*EVENT_SCHEMA.names, "date"]
    typed = df.filter(F.col(_IS_TYPED)).select(*columns, TYPED_DATA)
    others = df.filter(F.col(_IS_TYPED).isNull() | ~F.col(_IS_TYPED))
    return typed.unionAll(others.select(*columns, F.try_parse_json("data").alias(TYPED_DATA)))


def _stored(spark: SparkSession, root: str, schema: T.StructType, service: str | None) -> DataFrame:
    try:
        df = spark.read.schema(schema).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df.filter(F.col("service") == service) if service else df
