"""Filters, message search, time windows, top-N and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.catalog.registry import query, register
from emberlog.catalog.tables import (
    ALL_TIME, C, D, NOW_MS, R, T, WINDOW, documents, events, ragged, turns,
)
from emberlog.functions.msgquery import message_query
from emberlog.functions.times import Window, bound_ms, resolve_since
from emberlog.operators.aggregates import (
    merge_stats, message_stats, sessions, stats,
)
from emberlog.operators.filters import event_filter, from_backends
from emberlog.operators.topn import newest, top_buckets, top_sessions
from emberlog.plans.request import SearchRequest, Settings
from emberlog.plans.search import search, search_sources, tail
from emberlog.session import configure, shared_dir
from emberlog.sources.multi import EventSource, open_sources
from emberlog.sources.sketches import read_store_for, write_sketches
from emberlog.sources.store import append_events, read_store, read_typed_store

SHOWN = "id, ts, service, run_id, session_id, type, level, message, data"
_COLUMNS = SHOWN.split(", ")


def show(df: DataFrame) -> DataFrame:
    return df.select(*_COLUMNS)


def _filter(name: str, where: str, view=events, cte: str = T, frm: str = "t", **conditions) -> None:
    register(
        name,
        lambda spark, d: show(view(spark, d).filter(event_filter(**conditions))),
        f"with {cte} select {SHOWN} from {frm} where {where}",
    )


_filter("filter_service", "service = 'svc1'", service="svc1")
_filter("filter_session", "session_id = 's7'", session_id="s7")
_filter("filter_run", "run_id = 'run-3'", run_id="run-3")
_filter("filter_types", "type in ('error', 'purchase')", types=("error", "purchase"))
_filter("filter_levels", "level in ('warn', 'fatal')", levels=("warn", "fatal"))
_filter(
    "filter_contains",
    """contains(lower(coalesce(message, '')), 'st3') or contains(lower(type), 'st3')
       or coalesce(contains(lower(session_id), 'st3'), false)
       or coalesce(contains(lower(data), 'st3'), false)""",
    contains="ST3",
)
_filter(
    "filter_query",
    "contains(lower(coalesce(message, '')), 'timeout') and not contains(lower(coalesce(message, '')), 'error')",
    query="timeout -error",
)


@query(
    "filter_time_range",
    f"""with {R} select {SHOWN} from r
        where ts_ms is null or (ts_ms >= 1704844800000 and ts_ms <= 1705708800000)""",
)
def _(spark, d):
    since, until = bound_ms("2024-01-10", NOW_MS), bound_ms("2024-01-20T00:00:00Z", NOW_MS)
    return show(ragged(spark, d).filter(event_filter(since=since, until=until)))


@query(
    "filter_combined",
    f"""with {R} select {SHOWN} from r
        where service = 'svc2' and type in ('error', 'click', 'view') and level in ('error', 'debug', 'info')
          and (ts_ms is null or ts_ms >= {NOW_MS - 20 * 86_400_000})
          and (contains(lower(coalesce(message, '')), 'retry') or contains(lower(type), 'retry')
               or coalesce(contains(lower(session_id), 'retry'), false)
               or coalesce(contains(lower(data), 'retry'), false))
          and (contains(lower(coalesce(message, '')), 'timeout') or contains(lower(coalesce(message, '')), 'token'))
          and not contains(lower(coalesce(message, '')), 'user 1')""",
)
def _(spark, d):
    found = event_filter(
        service="svc2",
        types=("error", "click", "view"),
        levels=("error", "debug", "info"),
        contains="Retry",
        query='(timeout OR token) AND NOT "user 1"',
        since=bound_ms("20d", NOW_MS),
    )
    return show(ragged(spark, d).filter(found))


def _three_sources(spark, d):
    return [
        EventSource("local", lambda: events(spark, d), id="main"),
        EventSource("cloudwatch", lambda: turns(spark, d), id="chat"),
        EventSource("k8s", lambda: documents(spark, d)),
        EventSource("local", lambda: spark.read.parquet(f"{d}/no-such-table.parquet"), id="gone"),
        EventSource("ftp", lambda: events(spark, d), id="old"),
    ]


_POOLED = f"""{T}, {C}, {D}, pooled as (
    select 'local' as backend, 'main' as backend_id, {SHOWN}, ts_ms from t
    union all select 'cloudwatch', 'chat', {SHOWN}, ts_ms from c
    union all select 'k8s', null, {SHOWN}, ts_ms from d)"""


def _pooled(spark, d, backends=None):
    frame = open_sources(_three_sources(spark, d), backends).events(spark)
    return frame.select("source.backend", "source.backend_id", "*").drop("source")


@query(
    "filter_backends",
    f"""with {_POOLED} select backend, backend_id, {SHOWN} from pooled
        where backend = 'k8s' or backend_id = 'chat'""",
)
def _(spark, d):
    frame = open_sources(_three_sources(spark, d)).events(spark).filter(from_backends(("k8s", "chat")))
    return frame.select("source.backend", "source.backend_id", *_COLUMNS)


# Message search, over short messages and over whole long texts.

_LONG = f"""{T}, {C}, {D}, m as (
    select id, message, lower(coalesce(message, '')) as x from t
    union all select id, message, lower(coalesce(message, '')) from c
    union all select id, message, lower(coalesce(message, '')) from d)"""


def _messages(spark, d):
    frames = [f(spark, d).select("id", "message") for f in (events, turns, documents)]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


def _search_words(name: str, text: str, where: str) -> None:
    register(
        name,
        lambda spark, d: _messages(spark, d).filter(message_query(text)),
        f"with {_LONG} select id, message from m where {where}",
    )


_search_words("query_term", "TimeOut", "contains(x, 'timeout')")
_search_words("query_phrase", '"by user 7 "', "contains(x, 'by user 7 ')")
_search_words("query_and", "token AND bearer user", "contains(x, 'token') and contains(x, 'bearer') and contains(x, 'user')")
_search_words("query_or", "signup ok OR purchase timeout", "(contains(x, 'signup') and contains(x, 'ok')) or (contains(x, 'purchase') and contains(x, 'timeout'))")
_search_words("query_not", "NOT user -error !le", "not contains(x, 'user') and not contains(x, 'error') and not contains(x, 'le')")
_search_words(
    "query_group",
    'error AND (timeout OR NOT (user or "ok")) AND NOT NOT "e"',
    "contains(x, 'error') and (contains(x, 'timeout') or not (contains(x, 'user') or contains(x, 'ok'))) and contains(x, 'e')",
)


# Time windows.


@query("since_relative", f"with {R} select {SHOWN} from r where ts_ms is null or ts_ms >= {NOW_MS - 5 * 86_400_000}")
def _(spark, d):
    return show(ragged(spark, d).filter(event_filter(since=bound_ms("5D", NOW_MS))))


@query("window_default_lookback", f"with {R} select {SHOWN} from r where ts_ms is null or ts_ms >= {NOW_MS} - 172800000")
def _(spark, d):
    window = Window(NOW_MS, lookback_ms=172_800_000)
    return show(ragged(spark, d).filter(event_filter(since=resolve_since("checkpoint", window))))


@query("window_checkpoint", f"with {R} select {SHOWN} from r where ts_ms is null or ts_ms >= 1706000000000")
def _(spark, d):
    window = Window(NOW_MS, checkpoint_ms=1_706_000_000_000)
    return show(ragged(spark, d).filter(event_filter(since=resolve_since(None, window))))


# Aggregates.

_STAGE = """case when json_type(data, '$.stage') = 'VARCHAR' then json_extract_string(data, '$.stage') else 'unknown' end"""


@query(
    "stats_by_type",
    f"""with {R} select type as key, count(*) as count from r
        where service = 'svc1' and (ts_ms is null or ts_ms >= {NOW_MS - 20 * 86_400_000}) group by 1""",
)
def _(spark, d):
    found = event_filter(service="svc1", since=bound_ms("20d", NOW_MS))
    return stats(ragged(spark, d).filter(found), "type")


@query("stats_by_level", f"with {T} select level as key, count(*) as count from t group by 1")
def _(spark, d):
    return stats(events(spark, d), "level")


@query("stats_by_stage", f"with {T} select {_STAGE} as key, count(*) as count from t group by 1")
def _(spark, d):
    return stats(events(spark, d), "stage")


@query("stats_by_stage_store", f"with {T} select {_STAGE} as key, count(*) as count from t group by 1")
def _(spark, d):
    """Stages read from their own Parquet columns; one of two appends keeps text only."""
    root = shared_dir(spark, "store")
    table = events(spark, d)
    append_events(table.filter(F.col("level") == "info"), root)
    append_events(table.filter(F.col("level") != "info"), root, typed_data=True)
    append_events(table.filter(F.col("level").isNull()), root, typed_data=True)
    return stats(read_typed_store(spark, root), "stage")


_SESSIONS = """select session_id, arg_max(ts, (coalesce(ts_ms, 0), ts)) as last_ts, count(*) as event_count,
    count_if(level in ('error', 'fatal'))::bigint as error_count, max(coalesce(ts_ms, 0)) as last_ms
    from {0} where session_id <> '' group by session_id"""


@query("sessions", f"with {R} " + _SESSIONS.format("r"))
def _(spark, d):
    return sessions(ragged(spark, d))


@query(
    "stats_multi_source",
    f"""with {_POOLED} select level as key, count(*)::bigint as count from pooled group by 1""",
)
def _(spark, d):
    parts = [stats(frame, "level") for _, frame in open_sources(_three_sources(spark, d)).frames]
    return merge_stats(reduce(DataFrame.unionByName, parts))


@query("sessions_multi_source", f"with {_POOLED} " + _SESSIONS.format("pooled"))
def _(spark, d):
    return sessions(_pooled(spark, d))


@query(
    "message_stats",
    f"""with {_POOLED} select coalesce(floor(avg(length(message)) + 0.5), 0)::bigint as avg_message_chars,
        coalesce(max(length(message)), 0)::bigint as max_message_chars from pooled""",
)
def _(spark, d):
    return message_stats(_pooled(spark, d))


# Newest-first results.

_NEWEST = "order by coalesce(ts_ms, 0) desc, id limit"


@query("search_topn", f"with {R} select {SHOWN} from r where level in ('error', 'fatal') {_NEWEST} 200")
def _(spark, d):
    return show(newest(ragged(spark, d).filter(event_filter(levels=("error", "fatal"))), 200))


@query(
    "search_truncated",
    f"""with {R} select 150::bigint as returned, count(*) >= 150 as truncated
        from r where type = 'error'""",
)
def _(spark, d):
    request = SearchRequest(types=("error",), since=ALL_TIME, limit=150)
    return search(ragged(spark, d), request, WINDOW).truncated()


@query(
    "tail",
    f"""with {R}, found as (select * from r where service = 'svc3' and contains(lower(coalesce(message, '')), 'ok')
            and (ts_ms is null or ts_ms >= {NOW_MS} - 1000000000) {_NEWEST} 50)
        select {SHOWN.replace('message', "regexp_replace(message, 'Bearer [A-Za-z0-9._-]+', '[REDACTED]', 'g') as message")}, row_number() over ({_NEWEST.replace(' limit', '')})::integer as rank from found""",
)
def _(spark, d):
    window = Window(NOW_MS, lookback_ms=1_000_000_000)
    request = SearchRequest(service="svc3", query="ok")
    answer = tail(ragged(spark, d), request, window)
    return answer.events().select(*_COLUMNS, "rank")


@query(
    "search_count_first",
    f"""with {R}, found as (select * from r where service <> 'svc2' {_NEWEST} 400)
        select {SHOWN} from found""",
)
def _(spark, d):
    """A search over all times of a store that reads whole events of its newest days only."""
    configure(spark)
    root = shared_dir(spark, "store")
    append_events(ragged(spark, d), root)
    stored = read_store(spark, root).filter(F.col("service") != "svc2")
    request = SearchRequest(since=ALL_TIME, limit=400)
    answer = search(stored, request, WINDOW, Settings(redaction=_no_redaction()), count_first=True)
    return answer.events().select(*_COLUMNS)


@query(
    "search_sketched",
    f"""with {R} select {SHOWN} from r
        where contains(lower(coalesce(message, '')), 'user 12') or contains(lower(coalesce(session_id, '')), 'user 12')
          or contains(lower(coalesce(data, '')), 'user 12')""",
)
def _(spark, d):
    """A substring search over a store whose files are sketched, but for those appended last."""
    configure(spark)
    root, sketches = shared_dir(spark, "store"), shared_dir(spark, "sketches")
    pool = ragged(spark, d)
    append_events(pool.filter(F.col("service") != "svc3"), root)
    write_sketches(spark, root, sketches)
    append_events(pool.filter(F.col("service") == "svc3"), root)
    request = SearchRequest(contains="USER 12", since=ALL_TIME)
    events_ = read_store_for(spark, root, sketches, request)
    return events_.filter(request.predicate(WINDOW, "date")).select(*_COLUMNS)


@query(
    "stats_topk",
    f"""with {D} select run_id as key, count(*) as count from d group by 1 order by count desc, key limit 5""",
)
def _(spark, d):
    by_source = documents(spark, d).withColumn("type", F.col("run_id"))
    return top_buckets(stats(by_source, "type"), 5)


@query("sessions_topk", f"with {R} {_SESSIONS.format('r')} order by last_ms desc, session_id limit 20")
def _(spark, d):
    return top_sessions(sessions(ragged(spark, d)), 20)


@query(
    "search_multi_source",
    f"""with {_POOLED} select backend, backend_id, {SHOWN} from pooled
        where contains(lower(coalesce(message, '')), 'le') {_NEWEST} 300""",
)
def _(spark, d):
    opened = open_sources(_three_sources(spark, d))
    request = SearchRequest(query="le", since=ALL_TIME, limit=300)
    plain = Settings(redaction=_no_redaction())
    answer = search(opened.events(spark), request, WINDOW, plain, opened.errors)
    return answer.events().select("source.backend", "source.backend_id", *_COLUMNS)


@query(
    "search_failing_source",
    f"""with {R}, found as (select id, ts_ms from r where service <> 'svc1')
        select 'event' as kind, id, cast(null as varchar) as backend_id from (select * from found {_NEWEST} 300)
        union all select 'error', null, 'svc1'""",
)
def _(spark, d):
    """A store for each service, one of which has a file that is no Parquet file."""
    configure(spark)
    pool, stores = ragged(spark, d), {}
    for name in ("svc0", "svc1", "svc2", "svc3"):
        stores[name] = shared_dir(spark, "store")
        append_events(pool.filter(F.col("service") == name), stores[name])
    bad = spark.range(1).select(F.lit("no Parquet").alias("value"))
    bad.write.mode("append").text(f"{stores['svc1']}/service=svc1/date=2024-01-15")
    sources = [EventSource("local", lambda r=root: read_store(spark, r), name) for name, root in stores.items()]
    request = SearchRequest(since=ALL_TIME, limit=300)
    answer = search_sources(spark, open_sources(sources), request, WINDOW, Settings(redaction=_no_redaction()))
    events_ = answer.events().select(F.lit("event").alias("kind"), "id", F.lit(None).cast("string").alias("backend_id"))
    return events_.unionByName(answer.error_rows(spark).select(F.lit("error").alias("kind"), F.lit(None).cast("string").alias("id"), "backend_id"))


def _no_redaction():
    from emberlog.functions.redaction import RedactionPolicy

    return RedactionPolicy(enabled=False)


@query(
    "source_errors",
    f"""with {_POOLED}, outcome as (
            select backend, backend_id, count(*) as events, cast(null as varchar) as problem from pooled group by 1, 2
            union all select 'local', 'gone', null, 'PATH_NOT_FOUND'
            union all select 'ftp', 'old', null, 'Unknown backend type: ftp')
        select * from outcome""",
)
def _(spark, d):
    opened = open_sources(_three_sources(spark, d))
    counts = (
        opened.events(spark)
        .groupBy("source.backend", "source.backend_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("problem", F.lit(None).cast("string"))
    )
    code = F.regexp_extract("message", r"^\[([A-Z_]+)\]", 1)
    problem = F.when(code != "", code).otherwise(F.col("message"))
    errors = opened.error_rows(spark).select(
        "backend", "backend_id", F.lit(None).cast("bigint").alias("events"), problem.alias("problem")
    )
    return counts.unionByName(errors)
