"""Substring searches over sketched files: the same events from fewer files."""

import pytest
from helpers import NOW_MS

from emberlog.functions.msgquery import required_terms
from emberlog.functions.times import Window
from emberlog.plans.request import SearchRequest
from emberlog.sources.sketches import files_without, needs_of, read_store_for, sketched_files, write_sketches
from emberlog.sources.store import append_events, read_store

MESSAGES = {
    "a": ["Disk full on node 7", None, "", "ab"],
    "b": ["ÜBERLAUF im Speicher 漢字漢", "timeout after 30 s"],
    "c": ["quiet", "x" * 5000 + " far away"],
    "d": ["late arrival: disk full"],
}


def _store(make_events, root, services):
    for s in services:
        rows = [{"id": f"{s}{i}", "ts": f"2024-01-0{i + 1}T00:00:00Z", "level": "info", "type": "log", "service": s,
                 "run_id": "r", "session_id": f"sess-{s}", "message": m, "data": '{"key":"deep value ' + s + '"}'}
                for i, m in enumerate(MESSAGES[s])]
        append_events(make_events(*rows).coalesce(1), root)


@pytest.fixture(scope="module")
def sketched(spark, make_events, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sketches"))
    root, path = f"{top}/store", f"{top}/sketch"
    _store(make_events, root, "abc")
    write_sketches(spark, root, path)
    _store(make_events, root, "d")  # not sketched
    return root, path


def _files_read(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().get("numFiles").get().value()


REQUESTS = [
    (SearchRequest(contains=text), files) for text, files in (
        ("DISK FULL", 2), ("überlauf", 2), ("漢字漢", 2), ("漢字字", 1), ("far away", 2), ("nowhere at all", 1), ("sess-b", 3),
        ("deep value a", 5), ("ab", 9), ("", 9), ("log", 9))
] + [
    (SearchRequest(query=text), files) for text, files in (
        ("disk full", 2), ('"disk full"', 2), ("timeout NOT disk", 2), ("disk OR timeout", 9), ("-disk", 9), ("sess-b", 1),
        ("(disk full)", 9), ("quiet disk", 1))
]


def test_same_events_from_fewer_files(spark, sketched):
    root, path = sketched
    whole = read_store(spark, root)
    assert len(whole.inputFiles()) == 9
    for request, files in REQUESTS:
        request = SearchRequest(contains=request.contains, query=request.query, since="1900-01-01")
        found = request.predicate(Window(NOW_MS), "date")
        part = read_store_for(spark, root, path, request)
        want = sorted(r["id"] for r in whole.filter(found).select("id").collect())
        assert sorted(r["id"] for r in part.filter(found).select("id").collect()) == want, request
        assert _files_read(part) == files, request


def test_later_files_are_sketched_later(spark, sketched, make_events, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "sketch")
    write_sketches(spark, root, path)  # no store yet
    assert sketched_files(spark, path).count() == 0
    _store(make_events, root, "a")
    write_sketches(spark, root, path)
    _store(make_events, root, "b")
    needs = needs_of(SearchRequest(contains="nowhere at all"))
    assert len(files_without(spark, path, needs)) == 4
    write_sketches(spark, root, path)
    write_sketches(spark, root, path)
    assert sketched_files(spark, path).count() == 6
    assert len(files_without(spark, path, needs)) == 6


def test_a_cut_off_sketch_leaves_out_nothing(spark, sketched, make_events, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "sketch")
    _store(make_events, root, "a")
    empty = spark.createDataFrame([], "file string, field string, word int, bits long")
    empty.write.parquet(f"{path}/words")  # no table of files: sketching did not come to its end
    assert files_without(spark, path, needs_of(SearchRequest(contains="nowhere"))) == []


def test_required_terms():
    assert required_terms('one "two three" NOT four five') == ["one", "two three", "five"]
    assert required_terms("one OR two") == required_terms("(one two)") == required_terms("-one") == []
