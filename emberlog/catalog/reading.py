"""Sources, normalisation, sinks and the streaming ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalog.registry import query
from emberlog.catalog.tables import (
    NOW, NOW_MS, R, T, documents, events, ragged, signal_columns, signals,
)
from emberlog.functions.jsontext import entries_text
from emberlog.functions.levels import infer_level, normalize_level
from emberlog.functions.records import Record, parse_records
from emberlog.functions.times import coerce_timestamp, event_time_ms, split_log_line
from emberlog.operators.events import complete_events, source_struct, tag_source
from emberlog.operators.filters import event_filter
from emberlog.session import configure, shared_dir
from emberlog.sources.bodies import ingest_bodies, ingest_documents, ingest_outcomes
from emberlog.sources.browser import browser_errors_to_events, console_to_events
from emberlog.sources.chunks import chunk_events
from emberlog.sources.cloud import scan_cloud_logs, service_of_group
from emberlog.sources.pods import scan_pod_logs, service_of_selector
from emberlog.sources.store import append_events, read_store, scan_events, write_lines
from emberlog.streaming.ingest import IngestDefaults, stream_ingest
from emberlog.streaming.lines import stream_lines, unfinished_lines

SHOWN = "id, ts, ts_ms, level, type, service, run_id, session_id, message, data"
_COLUMNS = SHOWN.split(", ")

# A message that is never missing; it holds no character JSON would escape.
_M = "coalesce(message, 'none')"


def _case(column: str, *arms: str) -> str:
    """Expression choosing an arm by row number."""
    whens = " ".join(f"when n % {len(arms)} = {i} then {arm}" for i, arm in enumerate(arms))
    return f"case {whens} end as {column}"


def _with(df: DataFrame, *expressions: str) -> DataFrame:
    return df.select("*", *[F.expr(e) for e in expressions])


# The event store.

_LINE = """concat('{"id":"', id, '", "ts": "', ts, '","level":"', level, '","type":"', type, '","service":"', service, '","run_id":"', run_id,
    '"', case when session_id is null then '' else concat(', "session_id":"', session_id, '"') end,
    case when message is null then '' else concat(',"message":"', message, '"') end,
    case when data is null then '' else concat(',"data":', replace(data, ',', ' , ')) end, ',"tags":{"env":"test"}}')"""

# One line in ten is blank or damaged: cut short, or two writers ran into each other.
_STORE_LINE = f"""case when n % 30 = 0 then concat({_LINE}, {_LINE}) when n % 30 = 10 then left({_LINE}, 60)
    when n % 30 = 20 then '   ' else {_LINE} end as value"""


def _written_lines(spark: SparkSession, d: str, *, by_service: bool) -> str:
    root = shared_dir(spark, "lines")
    lines = _with(signals(spark, d), _STORE_LINE)
    if by_service:
        # Some of the lines lie in folders whose names are escaped or read like wildcards.
        write_lines(lines, root, "service")
    else:
        write_lines(lines, root)
    return root


@query("scan_events", f"""with {T} select {SHOWN}, '{{"env":"test"}}' as tags from t where n % 10 <> 0""")
def _(spark, d):
    root = _written_lines(spark, d, by_service=False)
    return scan_events(spark, root).select(*_COLUMNS, F.to_json("tags").alias("tags"))


@query("scan_service", f"with {T} select {SHOWN} from t where n % 10 <> 0 and service = 'svc2'")
def _(spark, d):
    root = _written_lines(spark, d, by_service=True)
    return scan_events(spark, root, service="svc2").select(*_COLUMNS)


@query(
    "append_roundtrip",
    f"""with {R} select {SHOWN}, cast(epoch_ms(ts_ms) as date) as date from r
        where service = 'svc1' and (ts_ms is null or ts_ms >= 1705276800000)""",
)
def _(spark, d):
    root = shared_dir(spark, "store")
    half = ragged(spark, d)
    append_events(half.filter(F.col("level") == "info"), root)
    append_events(half.filter(F.col("level") != "info"), root)
    since = event_time_ms(F.lit("2024-01-15"))
    found = event_filter(service="svc1", since=since, day_column="date")
    return read_store(spark, root).filter(found).select(*_COLUMNS, "date")


@query("append_again", f"with {R} select {SHOWN}, cast(epoch_ms(ts_ms) as date) as date from r")
def _(spark, d):
    """Appends under an id that run twice, as after a failure."""
    root = shared_dir(spark, "store")
    events_ = ragged(spark, d)
    for level, name in ((F.col("level") == "info", "one"), (F.col("level") != "info", "two")):
        for _ in range(2):
            append_events(events_.filter(level), root, append_id=name)
    return read_store(spark, root).select(*_COLUMNS, "date")


@query(
    "append_lines",
    f"""with {R} select {SHOWN}, cast(null as varchar) as tags from r""",
)
def _(spark, d):
    root = shared_dir(spark, "store")
    append_events(ragged(spark, d), root, fmt="jsonl")
    return scan_events(spark, root).select(*_COLUMNS, F.to_json("tags").alias("tags"))


# Lines as they may arrive at an ingest: fields missing, levels unknown, secrets inside.
_RAW_LINE = f"""case when n % 20 = 0 then 'not json' else concat('{{"id":"', id, '"', case when n % 4 = 0 then '' else concat(',"ts":"', ts, '"') end,
    case when n % 5 = 0 then ',"level":"LOUD"' else concat(',"level":"', upper(level), '"') end,
    ',"message":"', {_M}, '","data":{{"token":[', id, '],"rawPeak":1}}}}') end as value"""


@query(
    "stream_ingest",
    f"""with {T} select id, case when n % 4 = 0 then '{NOW}' else ts end as ts,
        case when n % 5 = 0 then 'info' else level end as level, 'log' as type, 'front' as service, 'run-0' as run_id,
        'session-0' as session_id, regexp_replace({_M}, 'Bearer [A-Za-z0-9._-]+', '[REDACTED]', 'g') as message,
        '{{"token":"[REDACTED]","rawPeak":1}}' as data, 'sdk' as kind,
        case when n % 4 = 0 then date '2024-01-31' else cast(epoch_ms(ts_ms) as date) end as date
        from t where n % 20 <> 0""",
)
def _(spark, d):
    configure(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    lines = _with(signal_columns(raw), _RAW_LINE).select("value")
    root, checkpoint = shared_dir(spark, "store"), shared_dir(spark, "progress")
    defaults = IngestDefaults("front", "run-0", NOW_MS, "session-0")
    stream_ingest(lines, root, checkpoint, defaults).awaitTermination()
    kept = [c for c in _COLUMNS if c != "ts_ms"]
    return read_store(spark, root).select(*kept, F.col("source.kind").alias("kind"), "date")


# Foreign logs.

_CLOUD = (
    f"""concat('{{"id":"', id, '","ts":"', ts, '","level":"', upper(level), '","type":"', type, '","service":"', service, '","run_id":"', run_id,
        '","message":"', {_M}, '","data":', coalesce(data, '{{"none":[]}}'), ',"tags":{{"env":"prod","n":', id, '}},"session_id":"x","source":{{"line":7}}}}')""",
    f"""concat('  {{"level":"', level, '", "message":"', {_M}, '", "stage_no":3, "nested":{{"z": 1,"a":["q"]}}}}')""",
    f"""concat('{{"level":30,"message":"', {_M}, '"}}')""",
    _M,
    """concat('{"id":"', id, '","message":')""",
    f"""concat('{{"note":"', {_M}, '"}}')""",
)
_INFERRED = """case when contains(lower({0}), 'fatal') then 'fatal' when contains(lower({0}), 'error') then 'error'
    when contains(lower({0}), 'warn') then 'warn' when contains(lower({0}), 'debug') then 'debug'
    when contains(lower({0}), 'trace') then 'trace' else 'info' end"""
_QUOTED = """concat('"', replace({0}, '"', '\\"'), '"')"""


@query(
    "norm_cloud",
    f"""with {T}, raw as (select *, {_case('raw', *_CLOUD)}, n % 6 as k, concat('ev', id) as ev,
            case when n % 29 = 0 then '{NOW}' else ts end as stamp, case when n % 8 = 0 then null else run_id end as stream from t)
        select case when k = 0 then id else ev end as id, case when k = 0 then ts else stamp end as ts,
            case when k <= 1 then level else {_INFERRED.format('raw')} end as level,
            case when k = 0 then type else 'log' end as type, case when k = 0 then service else 'fn' end as service,
            case when k = 0 then run_id else coalesce(stream, ev) end as run_id, case when k = 0 then 'x' end as session_id,
            case when k <= 1 then {_M} else raw end as message,
            case when k = 0 then coalesce(data, '{{"none":[]}}') when k = 1 then '{{"stage_no":3,"nested":{{"z":1,"a":["q"]}}}}'
                else concat('{{', case when stream is null then '' else concat('"logStreamName":"', stream, '",') end,
                    '"raw_message":', {_QUOTED.format('raw')}, '}}') end as data,
            case when k = 0 then '{{"env":"prod"}}' end as tags, 'mcp' as kind, 'cloudwatch' as backend, 'prod' as backend_id,
            case when k = 0 then 7 end as line from raw""",
)
def _(spark, d):
    rows = _with(signals(spark, d), _case("raw", *_CLOUD)).select(
        F.expr("concat('ev', id)").alias("eventId"),
        F.expr("case when n % 29 = 0 then 0 else ts_ms end").alias("timestamp"),
        F.col("raw").alias("message"),
        F.expr("case when n % 8 = 0 then null else run_id end").alias("logStreamName"),
    )
    found = scan_cloud_logs(rows, "/aws/lambda/fn", NOW_MS, backend_id="prod")
    return found.select(
        *[c for c in _COLUMNS if c != "ts_ms"], F.to_json("tags").alias("tags"), "source.kind", "source.backend",
        "source.backend_id", "source.line",
    )


_POD = (
    f"""concat('{{"timestamp":', cast(ts_ms as {{STR}}), ',"level":"', upper(level), '","msg":"', {_M}, '","pid":', id, '}}')""",
    f"""concat('{{"time":"', ts, '","severity":"ERROR","log":"', {_M}, '","meta":["detail"]}}')""",
    f"""concat('{{"data":{{"stage":"s", "pod":"from-json"}},"level":"loud","message":"', {_M}, '","ts":"as is"}}')""",
    _M,
    f"""concat('{{"data":["a",1],"msg":"', {_M}, '","ts":" "}}')""",
    f"""concat('{{"level":[1],"msg":"', {_M}, '"}}')""",
)
# Nanosecond stamps, as container runtimes write them; some lines have none, some are blank.
_POD_LINE = """case when n % 31 = 0 then '   ' when n % 9 = 0 then raw
    else concat(left(ts, 23), '456789Z ', raw) end as line"""


@query(
    "norm_pods",
    f"""with {T}, raw as (select *, {_case('raw', *[a.replace('{STR}', 'varchar') for a in _POD])}, n % 6 as k, concat('pod-', run_id) as pod,
            case when n % 9 = 0 then '{NOW}' else ts end as stamp, case when n % 4 = 0 then null else 'main' end as container
            from t where n % 31 <> 0),
        meta as (select *, case when container is null then '' else '"container":"main",' end as box,
            concat('"raw_message":', {_QUOTED.format('raw')}) as rm from raw)
        select case when k in (0, 1) then ts when k = 2 then 'as is' else stamp end as ts,
            case when k = 0 then level when k = 1 then 'error' else {_INFERRED.format('raw')} end as level, 'log' as type, 'api' as service,
            pod as run_id, case when k = 5 then raw else {_M} end as message,
            concat('{{', case when k = 4 then '"0":"a","1":1,' else '' end, '"pod":"', case when k = 2 then 'from-json' else pod end, '",', box, rm,
                case when k = 0 then concat(',"timestamp":', ts_ms, ',"msg":"', {_M}, '","pid":', id)
                     when k = 1 then concat(',"time":"', ts, '","severity":"ERROR","log":"', {_M}, '","meta":["detail"]')
                     when k = 2 then ',"stage":"s"' else '' end, '}}') as data,
            'k8s' as backend from meta""",
)
def _(spark, d):
    rows = _with(signals(spark, d), _case("raw", *[a.replace("{STR}", "string") for a in _POD]))
    rows = _with(rows, _POD_LINE, "concat('pod-', run_id) as pod", "case when n % 4 = 0 then null else 'main' end as container")
    found = scan_pod_logs(rows, "app=api,tier=web", NOW_MS)
    return found.select("ts", "level", "type", "service", "run_id", "message", "data", "source.backend")


@query(
    "pod_line_split",
    f"""with {T} select id, case when n % 9 = 0 or n % 31 = 0 then '{NOW}' else ts end as ts,
        case when n % 31 = 0 then '' else {_M} end as message from t""",
)
def _(spark, d):
    rows = _with(_with(signals(spark, d), f"{_M} as raw"), _POD_LINE)
    ts, message = split_log_line(F.col("line"), NOW_MS)
    return rows.select("id", ts.alias("ts"), message.alias("message"))


_BODIES = (
    f"""concat('[{{"id":"a', id, '","message":"', {_M}, '","level":"warn"}}, {{"id":"b', id, '","service":"", "data":{{"k": [1, 2]}}}}]')""",
    f"""concat(' {{"id":"c', id, '","message":"', {_M}, '","session_id":"own"}} ')""",
    f"""concat('{{"id":"d', id, '"}}', chr(13), chr(10), '5', chr(10), chr(10), '{{"id":"e', id, '","message":"', {_M}, '"}}')""",
    """concat('{"id":"f', id, '"}', chr(10), '{"id":')""",
    """concat('[{"id":"g', id, '"}, 7]')""",
    "'\"text\"'",
    "'  '",
    "'[]'",
)


def _bodies(spark, d):
    return _with(signals(spark, d), _case("body", *_BODIES)).select(F.col("id").alias("body_id"), "body")


_ITEM = f"""select id as body_id, 0 as item_no, concat('a', id) as id, {_M} as message, 'warn' as level, 'cli' as service, 'sess' as session_id, cast(null as varchar) as data from t where n % 8 = 0
    union all select id, 1, concat('b', id), null, null, 'cli', 'sess', '{{"k":[1,2]}}' from t where n % 8 = 0
    union all select id, 0, concat('c', id), {_M}, null, 'cli', 'own', null from t where n % 8 = 1"""


@query(
    "ingest_documents",
    f"""with {T} {_ITEM} union all select id, 0, concat('d', id), null, null, 'cli', 'sess', null from t where n % 8 = 2
        union all select id, 1, concat('e', id), {_M}, null, 'cli', 'sess', null from t where n % 8 = 2
        union all select id, 0, concat('g', id), null, null, 'cli', 'sess', null from t where n % 8 = 4""",
)
def _(spark, d):
    found = ingest_documents(_bodies(spark, d), ["body_id"], service="cli", session_id="sess")
    return found.select("body_id", "item_no", "id", "message", "level", "service", "session_id", "data")


_MAX = 110


@query(
    "ingest_bodies",
    f"""with {T}, sized as (select id as body_id, strlen({_case('b', *_BODIES).removesuffix(' as b')}) as size from t),
        items as ({_ITEM}) select body_id, item_no, id, message, level, session_id, data
        from (select * replace (nullif(session_id, 'sess') as session_id) from items) join sized using (body_id) where size <= {_MAX}""",
)
def _(spark, d):
    found = ingest_bodies(_bodies(spark, d), ["body_id"], max_bytes=_MAX)
    return found.select("body_id", "item_no", "id", "message", "level", "session_id", "data")


@query(
    "ingest_outcomes",
    f"""with {T}, sized as (select n, id, strlen({_case('b', *_BODIES).removesuffix(' as b')}) as size from t),
        judged as (select id, case when size > {_MAX} then 'too_large' when n % 8 in (2, 3, 6) then 'invalid_json'
            when n % 8 in (4, 5) then 'invalid_payload' else 'ok' end as outcome, n % 8 as k from sized)
        select id as body_id, outcome, case when outcome = 'ok' then case k when 0 then 2 when 1 then 1 else 0 end end::bigint as count from judged""",
)
def _(spark, d):
    return ingest_outcomes(_bodies(spark, d), ["body_id"], max_bytes=_MAX)


_WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_CHUNK = "case when doc_id % 3 = 0 then replace(text, chr(10), concat(chr(13), chr(10))) else text end"


_LINES = f"""with chunks as (select lang as stream_id, case when doc_id % 4 = 0 then 'stderr' else 'stdout' end as kind, doc_id as seq, {_CHUNK} as chunk from documents),
        streams as (select stream_id, kind, string_agg(chunk, '' order by seq) as all_text from chunks group by 1, 2),
        lines as (select stream_id, kind, unnest(regexp_split_to_array(all_text, '\\r?\\n')) as message from streams)"""


def _chunks(documents_: DataFrame) -> DataFrame:
    return documents_.select(
        F.col("lang").alias("stream_id"),
        F.expr("case when doc_id % 4 = 0 then 'stderr' else 'stdout' end as kind"),
        F.col("doc_id").alias("seq"),
        F.expr(f"{_CHUNK} as chunk"),
    )


@query(
    "lines_from_chunks",
    f"""{_LINES}
        select stream_id, kind, kind as type, case when kind = 'stderr' then 'error' else 'info' end as level, message
        from lines where trim(message, {_WS}) <> ''""",
)
def _(spark, d):
    configure(spark)
    chunks = _chunks(spark.read.parquet(f"{d}/documents.parquet"))
    return chunk_events(chunks).select("stream_id", "kind", "type", "level", "message")


@query("lines_from_stream", f"{_LINES} select stream_id, kind, message from lines where trim(message, {_WS}) <> ''")
def _(spark, d):
    configure(spark)
    table = f"{d}/documents.parquet"
    raw = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table}*")
    root, checkpoint = shared_dir(spark, "lines"), shared_dir(spark, "progress")
    stream_lines(_chunks(raw)).writeStream.format("parquet").option("path", root).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    lines = spark.read.parquet(root).unionByName(unfinished_lines(spark, checkpoint))
    return lines.select("stream_id", "kind", F.col("line").alias("message"))


_ARGS = (
    f"""concat('["', {_M}, '", ', id, ', {{"z": 1,"a":[null, true]}}]')""",
    f"""concat('["', {_M}, '"]')""",
    "'[]'",
    "'[null, false, [1, \"x\"]]'",
)
_METHOD = """case when n % 7 = 0 then 'log' when level = 'fatal' then 'dir' else level end as method"""


@query(
    "console_events",
    f"""with {T}, calls as (select *, n % 4 as k, {_METHOD} from t) select id, 'console' as type,
        case when method in ('log', 'dir') then 'info' else method end as level,
        case k when 0 then concat({_M}, ' ', id, ' {{"z":1,"a":[null,true]}}') when 1 then {_M} when 2 then '' else 'null false [1,"x"]' end as message,
        case k when 0 then concat('{{"args":["', {_M}, '",', id, ',{{"z":1,"a":[null,true]}}]}}') when 1 then concat('{{"args":["', {_M}, '"]}}')
            when 2 then '{{"args":[]}}' else '{{"args":[null,false,[1,"x"]]}}' end as data, 'sdk' as kind from calls""",
)
def _(spark, d):
    calls = _with(signals(spark, d), _case("args", *_ARGS), _METHOD)
    found = console_to_events(calls, keys=("id",))
    return found.select("id", "type", "level", "message", "data", F.col("source.kind").alias("kind"))


@query(
    "browser_errors",
    f"""with {T} select id, case when n % 6 < 4 then 'window.error' else 'unhandledrejection' end as type, 'error' as level,
        case n % 6 when 0 then {_M} when 1 then {_M} when 2 then 'thrown text' when 3 then '' when 4 then {_M} else concat('{{"code":', id, ',"message":"m"}}') end as message,
        case n % 6 when 0 then concat('{{"filename":"app.js","lineno":', n, ',"colno":3,"error":{{"name":"TypeError","message":"inner"}}}}')
            when 1 then concat('{{"lineno":', n, ',"error":{{"message":"', {_M}, '","stack":"at f"}}}}') when 2 then concat('{{"lineno":', n, ',"error":{{"message":"thrown text"}}}}')
            when 3 then concat('{{"lineno":', n, '}}') when 4 then concat('{{"reason":"', {_M}, '"}}') else concat('{{"reason":{{"code":', id, ',"message":"m"}}}}') end as data,
        case when n % 6 = 0 then 'app.js' end as file, case when n % 6 < 4 then n::integer end as line from t""",
)
def _(spark, d):
    rows = _with(
        signals(spark, d),
        "case when n % 6 < 4 then 'error' else 'rejection' end as kind",
        f"case when n % 6 = 0 then {_M} when n % 6 < 4 then '' end as shown",
        "case when n % 6 = 0 then 'app.js' when n % 6 < 4 then '' end as filename",
        "case when n % 6 < 4 then cast(n as int) end as lineno",
        "case when n % 6 = 0 then 3 end as colno",
        _case(
            "error",
            "'{\"name\":\"TypeError\", \"message\":\"inner\", \"code\":5}'",
            f"concat('{{\"message\":\"', {_M}, '\",\"stack\":\"at f\"}}')",
            "'\"thrown text\"'",
            "'null'",
            "null",
            "null",
        ),
        _case(
            "reason", "null", "null", "null", "null", f"concat('\"', {_M}, '\"')",
            "concat('{\"code\":', id, ', \"message\":\"m\"}')",
        ),
        "false as reason_is_error",
    )
    rows = rows.drop("message").withColumnRenamed("shown", "message")
    found = browser_errors_to_events(rows, keys=("id",))
    return found.select("id", "type", "level", "message", "data", "source.file", "source.line")


# Single steps of normalisation.


@query(
    "complete_events",
    f"""with {T} select case when n % 50 = 0 then 'new' else id end as id, case when n % 6 = 0 then '{NOW}' else ts end as ts,
        case when n % 5 = 0 then 'info' else level end as level, case when n % 7 = 0 then 'log' else type end as type,
        case when n % 8 = 0 then 'unit' when n % 8 = 1 then '' else service end as service, case when n % 9 = 0 then 'run-x' else run_id end as run_id,
        coalesce(session_id, 'sess-x') as session_id, message, case when n % 2 = 0 then 'sdk' else 'stdout' end as kind,
        case when n % 6 = 0 then {NOW_MS} else ts_ms end as ts_ms from t""",
)
def _(spark, d):
    raw = events(spark, d).withColumn("n", F.col("id").cast("bigint"))
    raw = raw.withColumns({
        "id": F.expr("case when n % 50 <> 0 then id end"),
        "ts": F.expr("case when n % 6 <> 0 then ts end"),
        "ts_ms": F.lit(None).cast("bigint"),
        "level": F.expr("case when n % 10 = 0 then 'LOUD' when n % 10 <> 5 then upper(level) end"),
        "type": F.expr("case when n % 7 <> 0 then type end"),
        "service": F.expr("case when n % 8 = 1 then '' when n % 8 <> 0 then service end"),
        "run_id": F.expr("case when n % 9 <> 0 then run_id end"),
        "source": F.when(F.expr("n % 4 = 1"), source_struct(kind=F.lit("stdout")))
        .when(F.expr("n % 4 = 3"), source_struct(kind=F.lit("stdout"), file=F.lit("f")))
        .when(F.expr("n % 4 = 2"), source_struct(file=F.lit("f"))),
    })
    done = complete_events(raw, "unit", NOW_MS, "run-x", "sess-x")
    fresh = F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return done.select(
        F.when(fresh, "new").otherwise(F.col("id")).alias("id"), "ts", "level", "type", "service", "run_id",
        "session_id", "message", F.col("source.kind").alias("kind"), "ts_ms",
    )


@query("normalize_level", f"with {T} select id, case when n % 3 = 2 then null else level end as level from t")
def _(spark, d):
    text = F.expr("case when n % 3 = 0 then upper(level) when n % 3 = 1 then initcap(level) else concat(level, ' ') end")
    return signals(spark, d).select("id", normalize_level(text).alias("level"))


@query(
    "infer_level",
    f"""with {T}, m as (select id, message from t union all select concat('d', doc_id), text from documents)
        select id, {_INFERRED.format("coalesce(message, '')")} as level from m""",
)
def _(spark, d):
    both = events(spark, d).unionAll(documents(spark, d))
    return both.select("id", infer_level(F.col("message")).alias("level"))


@query(
    "coerce_timestamp",
    f"""with {T} select id, case n % 7 when 0 then ts when 1 then ts when 2 then ts when 6 then '2024-01-05T08:00:00.000Z' end as ts from t""",
)
def _(spark, d):
    text = _case(
        "value", "concat('\" ', ts, '\"')", "cast(ts_ms as string)", "concat('\"', cast(ts_ms as string), '\"')", "'true'", "'\"  \"'",
        "'\"12:30\"'", "'\"2024-01-05T10:00+02:00\"'",
    )
    rows = _with(signals(spark, d), text)
    return rows.select("id", coerce_timestamp(F.parse_json("value")).alias("ts"))


@query(
    "event_time_ms",
    f"""with {T} select id, case n % 6 when 0 then ts_ms when 1 then ts_ms // 86400000 * 86400000 when 2 then ts_ms // 60000 * 60000
        when 3 then ts_ms - 7200000 when 4 then ts_ms // 1000 * 1000 end as ms from t""",
)
def _(spark, d):
    text = _case(
        "value", "ts", "left(ts, 10)", "concat(left(ts, 16), 'Z')", "concat(left(ts, 23), '+02:00')",
        "replace(left(ts, 19), 'T', ' ')", "'half past nine'",
    )
    return _with(signals(spark, d), text).select("id", event_time_ms(F.col("value")).alias("ms"))


_RECORDS = (
    f"""concat('{{"message":"', {_M}, '","msg":"other","tags":{{"a":"', service, '","b":1}},"data":{{"z":1, "a":2}}}}')""",
    f"""concat('{{"message":5,"msg":"', {_M}, '","tags":["p",1],"extra":{{"z":1, "a":2.50}}}}')""",
    f"""concat('{{"log":"', {_M}, '","msg":null,"tags":{{"n":1}},"data":"text","list":[1, 2]}}')""",
    "'{\"id\":\"x\"}'",
)


def _records(spark, d):
    rows = _with(signals(spark, d), _case("record", *_RECORDS)).select("id", "record")
    return parse_records(rows, F.col("record"))


@query("coerce_message", f"with {T} select id, case when n % 4 < 3 then {_M} end as message from t")
def _(spark, d):
    return _records(spark, d).select("id", Record().message().alias("message"))


@query(
    "extract_tags",
    f"""with {T} select id, case n % 4 when 0 then concat('{{"a":"', service, '"}}') when 1 then '{{"0":"p"}}' end as tags from t""",
)
def _(spark, d):
    return _records(spark, d).select("id", F.to_json(Record().tags()).alias("tags"))


@query(
    "extract_data",
    f"""with {T} select id, case n % 4 when 0 then '{{"z":1,"a":2}}' when 1 then concat('{{"msg":"', {_M}, '","extra":{{"z":1,"a":2.5}}}}')
        when 2 then concat('{{"log":"', {_M}, '","msg":null,"list":[1,2]}}') else '{{}}' end as data from t""",
)
def _(spark, d):
    record = Record()
    data = F.coalesce(record.data_json(), entries_text(record.extra_entries()))
    return _records(spark, d).select("id", data.alias("data"))


@query(
    "tag_source",
    f"""with {T} select id, case when n % 2 = 0 then 'stdout' else 'mcp' end as kind, 'local' as backend,
        case when n % 2 = 0 then 'old' end as backend_id from t
        union all select id, 'mcp', 'k8s', 'prod' from t""",
)
def _(spark, d):
    given = F.when(
        F.col("id").cast("bigint") % 2 == 0, source_struct(kind=F.lit("stdout"), backend_id=F.lit("old"))
    )
    raw = events(spark, d).withColumn("source", given)
    both = tag_source(raw, "local").unionAll(tag_source(raw, "k8s", "prod", remote=True))
    return both.select("id", "source.kind", "source.backend", "source.backend_id")


@query(
    "derive_service",
    f"""with {T} select id, case when n % 3 = 0 then concat('/aws/', service, '/') else service end as from_group,
        case n % 6 when 0 then service when 1 then service when 4 then service end as from_selector from t""",
)
def _(spark, d):
    group = "case when n % 3 = 0 then concat('/aws/', service, '/') else concat(' /aws/lambda/', service, ' ') end as log_group"
    selector = _case(
        "selector", "concat('app=', service, ',tier=web')", "concat('app!=', service)", "'app'", "''",
        "concat(' app = ', service, ' , x=y')", "'a=b=c'",
    )
    return _with(signals(spark, d), group, selector).select(
        "id", service_of_group(F.col("log_group")).alias("from_group"), service_of_selector(F.col("selector")).alias("from_selector")
    )
