"""Sources that fail while they are read, and what the answers say of them."""

import pytest

from emberlog.functions.msgquery import InvalidQuery
from emberlog.functions.times import Window
from emberlog.operators.aggregates import merge_sessions, merge_stats, sessions, stats
from emberlog.plans.request import SearchRequest
from emberlog.plans.search import search_sources, tail_sources
from emberlog.sources.multi import EventSource, open_sources
from emberlog.sources.store import append_events, read_store
from helpers import NOW_MS

WINDOW = Window(now_ms=NOW_MS)
TIMES = [f"2024-01-30T23:{m:02d}:00.000Z" for m in range(20, 60)]


@pytest.fixture(scope="module")
def three(spark, make_events, tmp_path_factory):
    """Two readable stores and one whose second file is no Parquet file."""
    roots = {}
    for no, name in enumerate(("good", "broken", "other")):
        root = roots[name] = str(tmp_path_factory.mktemp("store") / name)
        append_events(make_events(*(
            {"id": f"{name}{i}", "ts": t, "level": "info", "type": "log", "service": "api", "run_id": "r",
             "session_id": f"s{i % 3}", "message": f"line {i}"} for i, t in enumerate(TIMES[no::3])
        )), root)
    day = "service=api/date=2024-01-30"
    spark.createDataFrame([("no Parquet",)], "value string").write.mode("append").text(f"{roots['broken']}/{day}")
    sources = [EventSource("local", lambda r=root: read_store(spark, r), name) for name, root in roots.items()]
    return sources + [EventSource("k8s", lambda: read_store(spark, 1 / 0), "never")]


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_the_others_still_answer(spark, three):
    request = SearchRequest(query="line", since="2h", limit=7)
    answer = search_sources(spark, open_sources(three), request, WINDOW)
    good = [s for s in three if s.id in ("good", "other")]
    alone = search_sources(spark, open_sources(good), request, WINDOW)
    assert ids(answer.events()) == ids(alone.events()) and len(ids(alone.events())) == 7
    assert alone.errors == ()
    assert [(e.backend, e.backend_id) for e in answer.errors] == [("k8s", "never"), ("local", "broken")]
    rows = answer.error_rows(spark).collect()
    assert all(r["message"] and "\n" not in r["message"] for r in rows)
    assert answer.truncated().first()["truncated"]
    last = tail_sources(spark, open_sources(three), SearchRequest(limit=3, since="2h"), WINDOW)
    assert len(last.errors) == 2


def test_counts_and_sessions(spark, three):
    opened = open_sources(three)
    table, errors = opened.gather(spark, lambda e: sessions(e))
    assert [e.backend_id for e in errors] == ["never", "broken"]
    found = {r["session_id"]: r["event_count"] for r in merge_sessions(table).collect()}
    assert sum(found.values()) == len(TIMES[0::3]) + len(TIMES[2::3])
    table, _ = opened.gather(spark, lambda e: stats(e, "level"))
    assert merge_stats(table).collect()[0]["count"] == sum(found.values())


def test_a_wrong_request_is_no_fault_of_a_source(spark, three):
    with pytest.raises(InvalidQuery):
        search_sources(spark, open_sources(three), SearchRequest(query='"open'), WINDOW)


def test_without_a_readable_source(spark, three):
    broken = [s for s in three if s.id in ("broken", "never")]
    answer = search_sources(spark, open_sources(broken), SearchRequest(since="2h"), WINDOW)
    assert answer.events().count() == 0 and len(answer.errors) == 2
    assert search_sources(spark, open_sources([]), SearchRequest(since="2h"), WINDOW).events().count() == 0
