"""Redaction, output shaping, end-to-end search and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.catalog.registry import query
from emberlog.catalog.tables import (
    ALL_TIME, C, D, NOW_MS, R, T, WINDOW, documents, events, ragged, signals, turns,
)
from emberlog.functions.paths import event_json, event_line
from emberlog.functions.redaction import RedactionPolicy, redact_data, redact_tags, redact_text
from emberlog.functions.text import trim_message, truncate_message
from emberlog.operators.events import redact_events
from emberlog.operators.shaping import project_fields
from emberlog.plans.batch import search_batch
from emberlog.plans.request import SearchRequest, Settings
from emberlog.plans.search import search

# The default patterns and one for mail addresses, in RE2 spelling, one that looks behind without a
# bound, one with braces that repeat nothing, and two that cannot be compiled.
_MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"
_POLICY = RedactionPolicy(patterns=(
    *RedactionPolicy().patterns, _MAIL, r"(?<=user\s*)\d+", "{by:[^}]+}", "(unclosed", "(?P<name>x)",
))


def _duck_redacted(text: str, mail: bool = True) -> str:
    out = f"regexp_replace({text}, '(?i)sk-[A-Za-z0-9]{{20,}}', '[REDACTED]', 'g')"
    out = f"regexp_replace({out}, '(?i)Bearer\\s+[A-Za-z0-9._-]+', '[REDACTED]', 'g')"
    if not mail:
        return out
    out = f"regexp_replace({out}, '(?i){_MAIL}', '[REDACTED]', 'g')"
    out = f"regexp_replace({out}, '(?i)(user\\s*)\\d+', '\\1[REDACTED]', 'g')"
    return f"regexp_replace({out}, '(?i)\\{{by:[^}}]+\\}}', '[REDACTED]', 'g')"


_MESSAGES = f"""{T}, {C}, {D}, m as (select id, message, level, type from t union all
    select id, message, level, type from c union all select id, message, level, type from d)"""


def _messages(spark, d) -> DataFrame:
    frames = [f(spark, d) for f in (events, turns, documents)]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


_BRACED = "'{by:' || id || '} ' || message"


@query("redact_message", f"with {_MESSAGES} select id, {_duck_redacted(_BRACED)} as message from m")
def _(spark, d):
    return _messages(spark, d).select("id", redact_text(F.expr(_BRACED), _POLICY).alias("message"))


@query(
    "redact_tags",
    f"""with {T} select id, '[REDACTED]' as password, case when level = 'warn' then '[REDACTED]' else service end as service,
        {_duck_redacted("concat('on ', coalesce(message, 'none'))", mail=False)} as note from t""",
)
def _(spark, d):
    # Keys are compared without regard to case.
    tags = F.create_map(
        F.lit("PassWord"), F.col("run_id"),
        F.when(F.col("level") == "warn", "Token").otherwise("service"), F.col("service"),
        F.lit("note"), F.concat(F.lit("on "), F.coalesce("message", F.lit("none"))),
    )
    clean = events(spark, d).select("id", redact_tags(tags, RedactionPolicy()).alias("tags"))
    tag = lambda key: F.try_element_at("tags", F.lit(key))
    return clean.select(
        "id",
        tag("PassWord").alias("password"),
        F.coalesce(tag("service"), tag("Token")).alias("service"),
        tag("note").alias("note"),
    )


# Secrets at several depths; a listed key loses its value whatever its type.
_SECRETS = """concat('{"api_key":', case when n % 2 = 0 then concat('"k', id, '"') else concat('{"v":[', id, ']}') end,
    ',"note":"', coalesce(message, ''), '","deep":{"Token":', id, ',"list":[1.50,"', coalesce(message, ''),
    '",{"password":null,"ok":true}]}}')"""
_SECRETS_CLEAN = f"""concat('{{"api_key":"[REDACTED]","note":"', {_duck_redacted("coalesce(message, '')", mail=False)},
    '","deep":{{"Token":"[REDACTED]","list":[1.50,"', {_duck_redacted("coalesce(message, '')", mail=False)},
    '",{{"password":"[REDACTED]","ok":true}}]}}}}')"""


# Deeper than any JSON function walks.
_DEEP = "concat(repeat('{{\"a\":', 20000), {0}, repeat('}}', 20000))"


@query(
    "redact_data",
    f"""with {T} select id, case when n % 997 = 0 then {_DEEP.format("'{\"token\":\"[REDACTED]\"}'")}
        when n % 3 = 0 then {_SECRETS_CLEAN} else data end as data from t""",
)
def _(spark, d):
    deep = _DEEP.format("'{\"token\":1}'")
    data = F.expr(f"case when n % 997 = 0 then {deep} when n % 3 = 0 then {_SECRETS} else data end")
    return signals(spark, d).select("id", redact_data(data, RedactionPolicy()).alias("data"))


@query(
    "redact_texts",
    f"""with {_MESSAGES} select id, concat('{{"note":', cast(to_json({_duck_redacted("coalesce(message, '')")}) as varchar),
        ',"Token":"[REDACTED]"}}') as data from m""",
)
def _(spark, d):
    """Whole texts of conversations and documents as nested data, with their escapes."""
    note = F.to_json(F.struct(F.coalesce("message", F.lit("")).alias("note"), F.col("id").alias("Token")))
    return _messages(spark, d).select("id", redact_data(note, _POLICY).alias("data"))


@query(
    "redact_events",
    f"""with {T} select id, {_duck_redacted("message", mail=False)} as message,
        case when n % 3 = 0 then {_SECRETS_CLEAN} else data end as data,
        concat('{{"secret":"[REDACTED]","env":"', service, '"}}') as tags, level, ts from t""",
)
def _(spark, d):
    raw = signals(spark, d).withColumns({
        "data": F.expr(f"case when n % 3 = 0 then {_SECRETS} else data end"),
        "tags": F.create_map(F.lit("secret"), F.col("id"), F.lit("env"), F.col("service")),
    })
    clean = redact_events(raw)
    return clean.select("id", "message", "data", F.to_json("tags").alias("tags"), "level", "ts")


# Projection and text lines.


@query("project_fields", f"with {T} select message, ts, service, data from t")
def _(spark, d):
    return project_fields(events(spark, d), ["message", "ts", "unknown", "service", "", "data", "ts"])


_STAGE = "json_extract_string(data, '$.stage')"
_PEAK = "json_extract_string(data, '$.rawPeak')"


@query(
    "project_nested",
    f"""with {T} select id, ts, {_STAGE} as stage, {_PEAK} as peak, cast(null as varchar) as absent from t""",
)
def _(spark, d):
    fields = ["id", "ts", "data.stage", "data.rawPeak", "data.no.such", "nothing.x"]
    shown = project_fields(events(spark, d), fields)
    return shown.select(
        "id", "ts", "data.stage", F.col("data.rawPeak").alias("peak"), F.col("data.no.such").alias("absent")
    )


@query("project_flatten", f'with {T} select {_STAGE} as "data.stage", {_PEAK} as "data.rawPeak", id from t')
def _(spark, d):
    return project_fields(events(spark, d), ["data.stage", "data.rawPeak", "id"], flatten=True)


_STAGE_JSON = "concat('\"stage\":', cast(data::json->'$.stage' as varchar))"
_PEAK_JSON = f"case when {_PEAK} is null then '' else concat(',\"rawPeak\":', {_PEAK}) end"


@query(
    "project_json",
    f"""with {T} select id, concat('{{"ts":"', ts, '"', case when data is null then ''
            else concat(',"data":{{', {_STAGE_JSON}, {_PEAK_JSON}, '}}') end, '}}') as nested,
        concat('{{"ts":"', ts, '"', case when data is null then ''
            else concat(',"data.', substr({_STAGE_JSON}, 2), replace({_PEAK_JSON}, '"rawPeak', '"data.rawPeak')) end, '}}') as flat
        from t""",
)
def _(spark, d):
    fields = ["ts", "data.stage", "data.rawPeak", "data.no.such", "message.x", "bad..path"]
    return events(spark, d).select(
        "id", event_json(fields).alias("nested"), event_json(fields, flatten=True).alias("flat")
    )


# White space the end of a line loses, as a DuckDB string.
_ENDS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


@query(
    "format_text",
    f"""with {_MESSAGES.replace('id, message, level, type', 'id, ts, level, service, type, session_id, message')}
        select id, rtrim(concat(ts, ' ', level, ' ', service, ' ', type,
            case when session_id is null then '' else concat(' session=', session_id) end, ' ', message), {_ENDS}) as line from m""",
)
def _(spark, d):
    return _messages(spark, d).select("id", event_line().alias("line"))


@query(
    "format_template",
    f"""with {T} select id, rtrim(concat(ts, '|', service, '|', '|{{x y}}', coalesce({_STAGE}, ''), '/', coalesce({_PEAK}, ''), ' ',
        coalesce(data, ''), ' ', coalesce(message, '')), {_ENDS}) as line from t""",
)
def _(spark, d):
    template = "{ts}|{service}|{nothing}|{x y}{data.stage}/{data.rawPeak} {data} {message}"
    return events(spark, d).select("id", event_line(template).alias("line"))


# Shortened messages, over whole texts of up to 20,000 words.

_ALL_TEXTS = f"{T}, {C}, {D}, m as (select id, message from t union all select id, message from c union all select id, message from d)"


def _texts(spark, d) -> DataFrame:
    return _messages(spark, d).select("id", "message")


def _duck_ends(text: str, cap: int) -> str:
    head, tail = cap - 3 - (cap - 3) // 2, (cap - 3) // 2
    return f"""case when {text} is null or length({text}) <= {cap} then {text} else concat(left({text}, {head}), '...', right({text}, {tail})) end"""


def _duck_around(source: str, cap: int, match: str, columns: str = "id") -> str:
    """WITH members ending in ``shown(<columns>, short)``: messages of ``source`` trimmed to ``cap``."""
    base, half = max(1, cap - 6), len(match) // 2
    return f"""p0 as (select *, length(message) as total, strpos(lower(message), '{match}') - 1 as hit from {source}),
    p1 as (select *, hit + {half} as centre from p0),
    p2 as (select *, least(greatest(centre - {base} // 2, 0), greatest(0, total - {base})) as s1 from p1),
    p3 as (select *, least(total, {base} + case when s1 <= 0 then 3 else 0 end
        + case when least(total, s1 + {base}) >= total then 3 else 0 end) as width from p2),
    p4 as (select *, least(greatest(centre - width // 2, 0), greatest(0, total - width)) as s2 from p3),
    p5 as (select *, least(total, s2 + width) as e2 from p4),
    shown as (select {columns}, case when message is null or total <= {cap} then message
        when hit < 0 then {_duck_ends('message', cap)}
        else left(concat(case when s2 > 0 then '...' else '' end, substr(message, s2 + 1, e2 - s2),
            case when e2 < total then '...' else '' end), {cap}) end as short from p5)"""


@query("trim_head_tail", f"with {_ALL_TEXTS} select id, {_duck_ends('message', 20)} as a, {_duck_ends('message', 101)} as b, left(message, 3) as c from m")
def _(spark, d):
    m = F.col("message")
    return _texts(spark, d).select(
        "id", trim_message(m, 20).alias("a"), trim_message(m, 101).alias("b"), trim_message(m, 3).alias("c")
    )


@query("trim_around_match", f"with {_ALL_TEXTS}, {_duck_around('m', 24, 'user')} select id, short from shown")
def _(spark, d):
    return _texts(spark, d).select("id", trim_message(F.col("message"), 24, "USER").alias("short"))


@query(
    "truncate_message",
    f"""with {_ALL_TEXTS} select id, case when message is null or length(message) <= 18 then message else concat(left(message, 15), '...') end as a,
        left(message, 2) as b, message as c from m""",
)
def _(spark, d):
    m = F.col("message")
    return _texts(spark, d).select(
        "id", truncate_message(m, 18).alias("a"), truncate_message(m, 2).alias("b"), truncate_message(m, 0).alias("c")
    )


# Answers as a whole.

_REDACTED = _duck_redacted("message", mail=False)
# An event of the view as one JSON object; none of its texts needs escaping.
_EVENT_JSON = """concat('{"id":"', id, '","ts":"', ts, '","level":"', level, '","type":"', type, '","service":"', service,
    '","run_id":"', run_id, '"', case when session_id is null then '' else concat(',"session_id":"', session_id, '"') end,
    case when message is null then '' else concat(',"message":"', message, '"') end,
    case when data is null then '' else concat(',"data":', data) end, '}')"""
_NEWEST = "order by coalesce(ts_ms, 0) desc, id"


@query(
    "output_guard",
    f"""with {R}, top as (select * replace ({_REDACTED} as message) from r where type in ('error', 'view') {_NEWEST} limit 200),
        sized as (select sum(length({_EVENT_JSON}))::bigint as size, count(*) as n, avg(length(message)) as a, max(length(message)) as mx from top)
        select case when size > 15000 then 'output_too_large' end as code, size > 15000 as blocked, 15000::bigint as max_output_chars,
            size as estimated_output_chars, 'json' as format, n as item_count,
            (select count(*) >= 200 from r where type in ('error', 'view')) as truncated,
            floor(a + 0.5)::bigint as avg_message_chars, mx::bigint as max_message_chars from sized""",
)
def _(spark, d):
    request = SearchRequest(types=("error", "view"), since=ALL_TIME, max_output_chars=15_000.5)
    return search(ragged(spark, d), request, WINDOW).report().drop("message", "suggestions")


@query(
    "search_e2e",
    f"""with {R}, top as (select *, row_number() over ({_NEWEST})::integer as rank from r
            where service = 'svc1' and (ts_ms is null or ts_ms >= {NOW_MS - 25 * 86_400_000}) and level in ('error', 'info')
                and (contains(lower(coalesce(message, '')), 'user') or contains(lower(type), 'user')
                    or coalesce(contains(lower(session_id), 'user'), false) or coalesce(contains(lower(data), 'user'), false))
                and not contains(lower(coalesce(message, '')), 'retry')
            {_NEWEST} limit 120),
        clean as (select * replace ({_REDACTED} as message) from top),
        {_duck_around('clean', 22, 'user', 'rank, ts, service, data')}
        select rank, rtrim(concat(ts, '|', service, '|', coalesce({_STAGE}, ''), '|', coalesce(short, '')), {_ENDS}) as payload from shown""",
)
def _(spark, d):
    request = SearchRequest(
        service="svc1", levels=("error", "info"), contains="User", query="NOT retry", since="25d", limit=120,
        max_message_chars=22, format="text", template="{ts}|{service}|{data.stage}|{message}",
    )
    return search(ragged(spark, d), request, WINDOW).payload()


_BATCH = [
    ("errors", SearchRequest(levels=("error", "fatal"), limit=30, format="text")),
    ("retries", SearchRequest(query="timeout OR retry", limit=100, fields=("id", "message"))),
    ("svc2", SearchRequest(service="svc2", contains="st1", limit=25, format="text", template="{id}:{message}", max_message_chars=16)),
    ("nothing", SearchRequest(session_id="no such session", limit=5)),
    ("broken", SearchRequest(query="foo AND", limit=5)),
    ("wide", SearchRequest(limit=150, since="4d")),
]
_COMMON = SearchRequest(since="30d", max_output_chars=12_000)
_HITS = f"""{R}, found as (
    select 'errors' as search_id, * from r where level in ('error', 'fatal') and (ts_ms is null or ts_ms >= {NOW_MS - 30 * 86_400_000})
    union all select 'retries', * from r where (contains(lower(coalesce(message, '')), 'timeout') or contains(lower(coalesce(message, '')), 'retry'))
        and (ts_ms is null or ts_ms >= {NOW_MS - 30 * 86_400_000})
    union all select 'svc2', * from r where service = 'svc2' and (ts_ms is null or ts_ms >= {NOW_MS - 30 * 86_400_000})
        and (contains(lower(coalesce(message, '')), 'st1') or contains(lower(type), 'st1')
            or coalesce(contains(lower(session_id), 'st1'), false) or coalesce(contains(lower(data), 'st1'), false))
    union all select 'wide', * from r where ts_ms is null or ts_ms >= {NOW_MS - 4 * 86_400_000}),
    ranked as (select * replace ({_REDACTED} as message), row_number() over (partition by search_id {_NEWEST})::integer as rank from found),
    limits as (select * from (values ('errors', 30), ('retries', 100), ('svc2', 25), ('nothing', 5), ('wide', 150)) v(search_id, lim)),
    top as (select ranked.*, lim from ranked join limits using (search_id) where rank <= lim),
    shaped as (select *, case search_id
        when 'errors' then rtrim(concat(ts, ' ', level, ' ', service, ' ', type,
            case when session_id is null then '' else concat(' session=', session_id) end, ' ', message), {_ENDS})
        when 'retries' then concat('{{"id":"', id, '"', case when message is null then '' else concat(',"message":"', message, '"') end, '}}')
        when 'svc2' then rtrim(concat(id, ':', {_duck_ends("coalesce(message, '')", 16)}), {_ENDS})
        else {_EVENT_JSON} end as payload from top),
    sizes as (select search_id, sum(length(payload) + case when search_id in ('errors', 'svc2') then 2 else 0 end)::bigint as size,
        count(*) as n, floor(avg(length(message)) + 0.5)::bigint as a, max(length(message))::bigint as mx from shaped group by search_id)"""


@query(
    "search_batch",
    f"""with {_HITS} select search_id, rank, id, payload from shaped join sizes using (search_id) where size <= 12000""",
)
def _(spark, d):
    batch = search_batch(ragged(spark, d), _BATCH, WINDOW, _COMMON, Settings())
    return batch.rows().select("search_id", "rank", "id", "payload")


@query(
    "search_batch_count_first",
    f"""with {_HITS} select search_id, rank, id, payload from shaped join sizes using (search_id) where size <= 12000""",
)
def _(spark, d):
    batch = search_batch(ragged(spark, d), _BATCH, WINDOW, _COMMON, Settings(), count_first=True)
    return batch.rows().select("search_id", "rank", "id", "payload")


@query(
    "search_batch_summary",
    f"""with {_HITS}, totals as (select search_id, count(*) as hits from found group by search_id)
        select l.search_id, coalesce(n, 0) as returned, coalesce(hits, 0) >= lim as truncated, coalesce(size, 0) as output_chars,
            coalesce(size, 0) > 12000 as blocked, coalesce(a, 0) as avg_message_chars, coalesce(mx, 0) as max_message_chars,
            cast(null as varchar) as error, cast(null as varchar) as query
        from limits l left join sizes on l.search_id = sizes.search_id left join totals on l.search_id = totals.search_id
        union all select 'broken', null, null, null, null, null, null, 'Invalid query: Unexpected end of query', 'foo AND'""",
)
def _(spark, d):
    return search_batch(ragged(spark, d), _BATCH, WINDOW, _COMMON, Settings()).summary()
