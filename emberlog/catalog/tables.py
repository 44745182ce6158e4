"""Event views over the benchmark tables, for Spark and, as SQL text, for DuckDB.

Both engines read the same column expressions; only the spellings of a few functions differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.times import Window
from emberlog.operators.events import as_events
from emberlog.session import configure

# 2024-01-31T00:00:00.000Z, the fixed "now" of all registered queries.
NOW_MS = 1_706_659_200_000
NOW = "2024-01-31T00:00:00.000Z"
WINDOW = Window(now_ms=NOW_MS)
ALL_TIME = "60d"

_SPARK = {
    "STR": "string",
    "LONG": "bigint",
    "NTZ_ISO": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
    "NTZ_MS": "unix_millis(cast(ts as timestamp))",
    "ISO": "date_format(timestamp_millis({0}), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
}
_DUCK = {
    "STR": "varchar",
    "LONG": "bigint",
    "NTZ_ISO": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')",
    "NTZ_MS": "epoch_us(ts)//1000",
    "ISO": "strftime(epoch_ms({0}), '%Y-%m-%dT%H:%M:%S.%gZ')",
}

_SIGNALS = {
    "n": "event_id",
    "id": "cast(event_id as {STR})",
    "ts": "{NTZ_ISO}",
    "ts_ms": "{NTZ_MS}",
    "level": """case when event_type = 'error' and event_id % 10 = 0 then 'fatal'
        when event_type = 'error' then 'error' when event_type = 'signup' then 'warn'
        when event_type = 'click' then 'debug' else 'info' end""",
    "type": "event_type",
    "service": "concat('svc', cast(user_id % 4 as {STR}))",
    "run_id": "concat('run-', cast(user_id % 16 as {STR}))",
    "session_id": "case when user_id % 10 = 0 then null else concat('s', cast(user_id as {STR})) end",
    "message": """case when event_id % 17 = 0 then null else
        concat(event_type, ' by user ', cast(user_id as {STR}),
        case when event_id % 3 = 0 then ' Timeout on DB retry'
             when event_id % 5 = 0 then ' token Bearer abc.DEF-123' else ' ok' end) end""",
    "data": """case when event_id % 7 = 0 then null
        when event_id % 11 = 0 then concat('{{"stage":', cast(event_id % 3 as {STR}), '}}')
        else concat('{{"stage":"st', cast(event_id % 5 as {STR}), '","rawPeak":',
                    cast(event_id % 100 as {STR}), '}}') end""",
}

# Some events whose time cannot be read.
_RAGGED = {
    "ts": "case when event_id % 13 = 0 then 'not a time' else {NTZ_ISO} end",
    "ts_ms": "case when event_id % 13 = 0 then null else {NTZ_MS} end",
}

_TURN_MS = "(1704067200000 + conv_id * 60000 + turn * 1000)"
_TURNS = {
    "id": "concat('c', cast(conv_id as {STR}), '-', cast(turn as {STR}))",
    "ts": "{ISO}".replace("{ISO}", "@ISO"),
    "ts_ms": _TURN_MS,
    "level": "case when turn % 5 = 4 then 'error' else 'info' end",
    "type": "concat('turn.', role)",
    "service": "'chat'",
    "run_id": "concat('run-', cast(conv_id % 16 as {STR}))",
    "session_id": "concat('s', cast(conv_id % 50 as {STR}))",
    "message": "text",
    "data": "concat('{{\"stage\":\"', role, '\"}}')",
}

_DOC_MS = "(1704067200000 + doc_id * 1000)"
_DOCS = {
    "id": "concat('d', cast(doc_id as {STR}))",
    "ts": "@ISO",
    "ts_ms": _DOC_MS,
    "level": "'info'",
    "type": "'document'",
    "service": "lang",
    "run_id": "source",
    "session_id": "cast(null as {STR})",
    "message": "text",
    "data": "cast(null as {STR})",
}


def _fill(columns: dict[str, str], names: dict[str, str], ms: str = "") -> dict[str, str]:
    plain = {k: v for k, v in names.items() if k != "ISO"}
    iso = names["ISO"].format(ms)
    return {k: v.format(**plain).replace("@ISO", iso) for k, v in columns.items()}


def _view(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    configure(spark)
    raw = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return raw.select(*[F.expr(e).alias(k) for k, e in columns.items()])


def _cte(name: str, table: str, columns: dict[str, str]) -> str:
    return f"{name} as (select " + ", ".join(f"{e} as {k}" for k, e in columns.items()) + f" from {table})"


def signal_columns(df: DataFrame) -> DataFrame:
    """Telemetry columns of a frame with the columns of the ``events`` table, also streaming."""
    return df.select(*[F.expr(e).alias(k) for k, e in _fill(_SIGNALS, _SPARK).items()])


def signals(spark: SparkSession, sf_dir: str, extra: dict[str, str] | None = None) -> DataFrame:
    """The ``events`` table as raw columns of telemetry, ``n`` being its row number."""
    columns = {**_SIGNALS, **(extra or {})}
    return _view(spark, sf_dir, "events", _fill(columns, _SPARK))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(signals(spark, sf_dir))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(signals(spark, sf_dir, _RAGGED))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as events: long multi-line messages."""
    return as_events(_view(spark, sf_dir, "conversations", _fill(_TURNS, _SPARK, _TURN_MS)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as events: whole texts as messages."""
    return as_events(_view(spark, sf_dir, "documents", _fill(_DOCS, _SPARK, _DOC_MS)))


# The same views for DuckDB, as members of a WITH clause.
T = _cte("t", "events", _fill(_SIGNALS, _DUCK))
R = _cte("r", "events", _fill({**_SIGNALS, **_RAGGED}, _DUCK))
C = _cte("c", "conversations", _fill(_TURNS, _DUCK, _TURN_MS))
D = _cte("d", "documents", _fill(_DOCS, _DUCK, _DOC_MS))
