"""Search, tail, batches and several sources, also with one key holding most rows."""

import random

import pytest
from helpers import NOW_MS, plan
from pyspark.sql import functions as F

from emberlog.functions.redaction import RedactionPolicy
from emberlog.functions.times import Window
from emberlog.operators.aggregates import merge_sessions, message_stats, sessions, stats
from emberlog.operators.topn import newest, top_buckets, top_sessions
from emberlog.plans.batch import search_batch
from emberlog.plans.request import SearchRequest, Settings
from emberlog.plans.search import search, tail
from emberlog.sources.multi import EventSource, open_sources

WINDOW = Window(NOW_MS, lookback_ms=86_400_000)
LEVELS = ("info", "error", "fatal", "debug")


def rows_of(n, seed):
    """Rows of which a third share one session, service, type and instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        second = 30 if hot else rng.randrange(60)
        rows.append({
            "id": f"{i:05d}", "ts": rng.choice(["odd", None]) if i % 50 == 1 else f"2024-01-30T23:{rng.randrange(10, 60) if not hot else 50}:{second:02d}.000Z",
            "level": rng.choice(LEVELS), "type": "hot" if hot else f"t{rng.randrange(5)}", "service": "hot" if hot else f"s{rng.randrange(3)}",
            "run_id": "r", "session_id": "hot" if hot else rng.choice(["", None, "a", "b", "c"]),
            "message": rng.choice([None, "one", "two words", "three"]),
            "data": rng.choice([None, '{"stage":"x"}', '{"stage":5}', '{"other":{"stage":"y"}}', '{"stage":null}']),
        })
    return rows


@pytest.fixture(scope="module")
def rows():
    return rows_of(1500, 3)


@pytest.fixture(scope="module")
def events(make_events, rows):
    return make_events(*rows).repartition(6).cache()


def newest_first(rows):
    return sorted(rows, key=lambda r: r["id"]) and sorted(
        sorted(rows, key=lambda r: r["id"]),
        key=lambda r: r["ts"] if r["ts"] and r["ts"].startswith("2024") else "",
        reverse=True,
    )


def test_sessions(events, rows):
    want = {}
    for r in rows:
        if r["session_id"]:
            s = want.setdefault(r["session_id"], [0, 0, ""])
            s[0] += 1
            s[1] += r["level"] in ("error", "fatal")
            if r["ts"] and r["ts"].startswith("2024"):
                s[2] = max(s[2], r["ts"])
    table = sessions(events)
    assert {r.session_id: [r.event_count, r.error_count, r.last_ts] for r in table.collect()} == want
    # The wide step is a hash aggregate: no sort of all rows.
    text = plan(table)
    below = text[text.rindex("SortAggregate"):]
    assert "HashAggregate(keys=[session_id" in below and "partial_count" in below and "Sort [" in below[: below.index("HashAggregate")]
    half = [sessions(events.filter(f"cast(id as int) % 2 = {i}")).drop("last_ms") for i in (0, 1)]
    merged = merge_sessions(half[0].unionByName(half[1]))
    assert {r.session_id: [r.event_count, r.error_count, r.last_ts] for r in merged.collect()} == want
    top = [r.session_id for r in top_sessions(table, 2).collect()]
    assert top == [k for k, _ in sorted(sorted(want.items()), key=lambda kv: kv[1][2], reverse=True)][:2]


def test_sessions_without_time(make_events):
    df = make_events({"session_id": "s", "ts": "b"}, {"session_id": "s", "ts": "a"}, {"session_id": "s"}, {"session_id": "n"})
    assert {r.session_id: r.last_ts for r in sessions(df).collect()} == {"s": "b", "n": None}


def test_stats(events, rows):
    for by in ("type", "level"):
        want = {}
        for r in rows:
            want[r[by]] = want.get(r[by], 0) + 1
        assert {r.key: r["count"] for r in stats(events, by).collect()} == want
    staged = sum(r["data"] == '{"stage":"x"}' for r in rows)
    assert {r.key: r["count"] for r in stats(events, "stage").collect()} == {"x": staged, "unknown": len(rows) - staged}
    assert [r.key for r in top_buckets(stats(events, "type"), 1).collect()] == ["hot"]
    with pytest.raises(ValueError):
        stats(events, "message")


def test_message_stats(events, rows, make_events):
    sizes = [len(r["message"]) for r in rows if r["message"] is not None]
    assert tuple(message_stats(events).first()) == (int(sum(sizes) / len(sizes) + 0.5), 9)
    assert tuple(message_stats(make_events({"id": "1"})).first()) == (0, 0)


def test_newest(events, rows):
    want = [r["id"] for r in newest_first(rows)]
    assert [r.id for r in newest(events, 700).collect()] == want[:700]
    assert "TakeOrderedAndProject" in plan(newest(events, 10))
    for bad in (0, -1, 2.5, True):
        with pytest.raises(ValueError):
            newest(events, bad)


def test_search_and_truncation(events, rows):
    hits = [r for r in newest_first(rows) if r["type"] == "t1" and r["message"] == "one"]
    for limit, cut in ((len(hits) - 1, True), (len(hits), True), (len(hits) + 1, False)):
        answer = search(events, SearchRequest(types=("t1",), query="one", limit=limit), WINDOW)
        assert tuple(answer.truncated().first()) == (min(limit, len(hits)), cut)
        assert [r.id for r in answer.events().orderBy("rank").collect()] == [r["id"] for r in hits[:limit]]
    nothing = search(events, SearchRequest(service="no such"), WINDOW)
    assert tuple(nothing.truncated().first()) == (0, False)
    assert nothing.report().first().estimated_output_chars == 0


def test_tail(events):
    settings = Settings(max_results=60)
    assert tail(events, SearchRequest(), WINDOW, settings).events().count() == 50
    assert tail(events, SearchRequest(limit=500, types=("none",), contains="none"), WINDOW, settings).events().count() == 60
    assert tail(events, SearchRequest(), WINDOW, Settings(max_results=20)).events().count() == 20


@pytest.mark.parametrize("count_first", [False, True])
def test_batch_equals_single_searches(events, count_first):
    searches = [
        ("all", SearchRequest(limit=400)),
        ("hot", SearchRequest(service="hot", limit=37, format="text", template="{id} {message}")),
        ("few", SearchRequest(query="two AND words", levels=("fatal",), limit=1000, fields=("id", "data.stage"))),
        ("none", SearchRequest(run_id="x")),
        ("bad", SearchRequest(query="(")),
        ("hot", SearchRequest(contains="THREE", limit=5, max_message_chars=4)),
    ]
    settings = Settings(max_output_chars=None)
    batch = search_batch(events, searches, WINDOW, settings=settings, count_first=count_first)
    single = {}
    for no, (name, request) in enumerate(searches):
        if name != "bad":
            for r in search(events, request, WINDOW, settings).payload().collect():
                single.setdefault(name, []).append((r["rank"], r.payload))
    found = {}
    for r in batch.rows().collect():
        found.setdefault(r.search_id, []).append((r["rank"], r.payload))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in single.items()}
    summary = {(r.search_id, r.returned, r.truncated, r.error, r.query) for r in batch.summary().collect()}
    few = len(single["few"])
    assert summary == {
        ("all", 400, True, None, None), ("hot", 37, True, None, None), ("few", few, False, None, None),
        ("none", 0, False, None, None), ("bad", None, None, "Invalid query: Unexpected end of query", "("), ("hot", 5, True, None, None),
    }
    text = plan(batch.rows())
    # One read of the events, and rows beyond the limits dropped before each shuffle.
    assert text.count("InMemoryTableScan") == 1
    assert text.count("WindowGroupLimit") == 4


def test_batch_guard(events):
    searches = [("big", SearchRequest(limit=300)), ("small", SearchRequest(limit=2))]
    common = SearchRequest(max_output_chars=2000)
    batch = search_batch(events, searches, WINDOW, common)
    assert {r.search_id: r.blocked for r in batch.summary().collect()} == {"big": True, "small": False}
    assert {r.search_id for r in batch.rows().collect()} == {"small"}
    forced = search_batch(events, searches, WINDOW, common, force=True)
    assert forced.rows().count() == 302 and not any(r.blocked for r in forced.summary().collect())


def test_batch_without_a_valid_search(events):
    batch = search_batch(events, [("bad", SearchRequest(query="a OR"))], WINDOW)
    assert batch.rows().count() == 0
    assert [(r.search_id, r.error) for r in batch.summary().collect()] == [("bad", "Invalid query: Unexpected end of query")]
    assert search_batch(events, [], WINDOW).rows().count() == 0


def test_short_names():
    request = SearchRequest.short(s="svc", q="x", lim=3)
    assert (request.service, request.query, request.limit) == ("svc", "x", 3)
    assert (request.format, request.template) == ("text", "{ts}|{service}|{message}")
    assert SearchRequest.short(fmt="json").template is None
    assert SearchRequest(limit=5).over(SearchRequest(limit=9, service="a")) == SearchRequest(limit=5, service="a")


def test_sources(spark, events):
    def broken():
        raise RuntimeError("connection refused\ndetails")

    sources = [
        EventSource("local", lambda: events.filter("type = 't1'"), id="one"),
        EventSource("k8s", lambda: events.filter("type = 't2'").drop("source", "tags")),
        EventSource("cloudwatch", broken, id="logs"),
        EventSource("tape", lambda: events),
    ]
    opened = open_sources(sources)
    assert [(e.backend, e.backend_id, e.message) for e in opened.errors] == [
        ("tape", None, "Unknown backend type: tape"), ("cloudwatch", "logs", "connection refused"),
    ]
    kinds = {(r.type, r.source.backend, r.source.backend_id, r.source.kind) for r in opened.events(spark).collect()}
    assert kinds == {("t1", "local", "one", "mcp"), ("t2", "k8s", None, "mcp")}
    assert [s.type for s, _ in open_sources(sources[:2], ["k8s"]).frames] == ["k8s"]
    assert [s.id for s, _ in open_sources(sources[:2], ["one"]).frames] == ["one"]
    none = open_sources(sources[:2], ["a", "b"])
    assert none.events(spark).count() == 0
    assert none.error_rows(spark).first().message == "No backends matched filter: a, b"
    # A full answer from two sources together is not cut, one from a single source is.
    pooled = opened.events(spark)
    n = pooled.count()
    plain = Settings(redaction=RedactionPolicy(enabled=False))
    assert search(pooled, SearchRequest(limit=n), WINDOW, plain).truncated().first().truncated is False
    assert search(pooled, SearchRequest(limit=n - 1), WINDOW, plain).truncated().first().truncated is True


def test_redaction_comes_after_filtering(make_events):
    df = make_events({"id": "1", "ts": "2024-01-30T23:59:00Z", "type": "log", "message": "Bearer abcdef", "data": '{"token":"t"}'})
    row = search(df, SearchRequest(contains="abcdef"), WINDOW).events().first()
    assert (row.message, row.data) == ("[REDACTED]", '{"token":"[REDACTED]"}')


def test_sessions_of_numeric_times_are_merged_by_time(spark):
    import json

    from emberlog.sources.store import parse_lines

    lines = [json.dumps({"session_id": "s", "ts": t, "level": "info"}) for t in ("2023-01-01T00:00:00Z", 1_706_000_000_000)]
    parts = [sessions(parse_lines(spark.createDataFrame([(x,)], "value string"))) for x in lines]
    row = merge_sessions(parts[0].unionByName(parts[1])).first()
    assert (row.last_ts, row.last_ms, row.event_count) == ("1706000000000", 1_706_000_000_000, 2)


@pytest.mark.parametrize("found, cut", [(49, False), (50, False), (51, True)])
def test_a_tail_is_cut_if_there_was_more(make_events, found, cut):
    events = make_events(*({"id": f"{i:03}", "ts": f"2024-01-30T23:59:{i % 60:02}.000Z"} for i in range(found)))
    answer = tail(events, SearchRequest(), WINDOW).truncated().first()
    assert (answer["returned"], answer["truncated"]) == (min(found, 50), cut)
    full = tail(events, SearchRequest(limit=found), WINDOW, Settings(max_results=found))
    assert full.truncated().first()["truncated"] is True
