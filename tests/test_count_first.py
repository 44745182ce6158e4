"""Newest events by a count first: the same answer, from a part of the store."""

import datetime

import pytest
from helpers import NOW_MS, optimized, plan

from emberlog.functions.times import Window
from emberlog.model import EVENT_SCHEMA
from emberlog.operators.topn import HOUR_MS, newest, newest_part, newest_since
from emberlog.plans.request import SearchRequest
from emberlog.plans.search import search, tail
from emberlog.sources.store import append_events, read_store

DAY = 24 * HOUR_MS
ALL = "1900-01-01"


def _event(i, ms, message="m"):
    ts = None
    if ms is not None:
        ts = (datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)).isoformat() + "Z"
    return {"id": f"e{i:03}", "ts": ts, "ts_ms": ms, "level": "info", "type": "log", "service": f"s{i % 2}",
            "run_id": "r", "message": message}


def _frame(spark, times, message="m"):
    rows = [tuple(_event(i, ms, message).get(n) for n in EVENT_SCHEMA.names) for i, ms in enumerate(times)]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


# Ties over an hour's border, times before 1970, times that cannot be read.
TIMES = (
    [NOW_MS - d * DAY for d in range(20)] + [NOW_MS] * 7 + [NOW_MS // HOUR_MS * HOUR_MS] * 5
    + [NOW_MS // HOUR_MS * HOUR_MS - 1] * 3 + [None] * 6 + [0, 1, -1, -HOUR_MS, -HOUR_MS - 1, -DAY]
)


def test_same_newest_rows_for_every_limit(spark):
    events = _frame(spark, TIMES).cache()
    for limit in (1, 7, 8, 13, 16, 34, 35, 40, 41, 43, 44, 45, len(TIMES), len(TIMES) + 1, 1000):
        got = [r["id"] for r in newest(newest_part(events, limit), limit).collect()]
        assert got == [r["id"] for r in newest(events, limit).collect()], limit


def test_bound_is_the_hour_of_the_last_row(spark):
    events = _frame(spark, TIMES)
    assert newest_since(events, 1) == NOW_MS // HOUR_MS * HOUR_MS
    assert newest_since(events, len(TIMES)) == -DAY
    assert newest_since(events, len(TIMES) + 1) is None
    assert newest_since(events.limit(0), 5) is None


def test_a_time_before_all_hours(spark):
    events = _frame(spark, [1, 2]).selectExpr(
        *(n if n != "ts_ms" else "if(id = 'e000', -9223372036854775808, 5L) as ts_ms" for n in EVENT_SCHEMA.names))
    assert [r["id"] for r in newest(newest_part(events, 2), 2).collect()] == ["e001", "e000"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("count-first") / "store")
    append_events(_frame(spark, TIMES, "all is well"), root)
    return root


def test_search_reads_the_newest_days(spark, store):
    events = read_store(spark, store)
    for request in (SearchRequest(since=ALL, limit=10), SearchRequest(since=ALL, limit=10, query="well", service="s1"),
                    SearchRequest(since=ALL, limit=500), SearchRequest(since=ALL, limit=5, query="absent")):
        one, two = (search(events, request, Window(NOW_MS), count_first=c) for c in (False, True))
        assert [tuple(r) for r in one.events().collect()] == [tuple(r) for r in two.events().collect()]
        assert one.truncated().collect() == two.truncated().collect()
    pruned = search(events, SearchRequest(since=ALL, limit=10), Window(NOW_MS), count_first=True).top
    newest_day = datetime.datetime.fromtimestamp(NOW_MS / 1000, datetime.UTC).date()
    assert f">= {newest_day})" in optimized(pruned)
    assert "PartitionFilters: [(isnull(date" in plan(pruned) and "PushedFilters" in plan(pruned)


def test_tail_counts_first(spark, store):
    window = Window(NOW_MS, lookback_ms=10 * DAY)
    for limit in (3, 50):
        one, two = (tail(read_store(spark, store), SearchRequest(limit=limit), window, count_first=c) for c in (False, True))
        assert [tuple(r) for r in one.events().collect()] == [tuple(r) for r in two.events().collect()]
