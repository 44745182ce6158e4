"""JSONL trees, the Parquet store and the streaming ingest."""

import json
import os

import pytest
from helpers import NOW_MS, optimized, plan
from pyspark.sql import functions as F

from emberlog.functions.times import bound_ms
from emberlog.operators.aggregates import stats
from emberlog.operators.filters import event_filter
from emberlog.session import shared_dir
from emberlog.sources.store import append_events, read_store, scan_events
from emberlog.streaming.ingest import IngestDefaults, read_line_stream, stream_ingest

def row(n, **own):
    base = {"id": str(n), "ts": f"2024-01-31T11:5{n}:00Z", "level": "warn", "type": "probe", "service": "svc",
            "run_id": "r-9", "session_id": f"s-{n}"}
    return {**base, **own}


ROWS = [
    row(1, message="Disk nearly full", data={"mount": "/var", "left": 3}),
    row(2, message="disk check", data={"tags": ["nearly", "done"]}),
    row(3, message="all quiet", data={"mount": "/nearly"}),
]


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("\n".join(lines))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_query_reads_messages_and_contains_reads_all(spark, tmp_path):
    write(f"{tmp_path}/svc/2023-11-07/lines.jsonl", *map(json.dumps, ROWS))
    events = scan_events(spark, str(tmp_path))
    assert ids(events.filter(event_filter(query="nearly"))) == ["1"]
    assert ids(events.filter(event_filter(contains="nearly"))) == ["1", "2", "3"]
    assert ids(events.filter(event_filter(query="disk", contains="NEARLY"))) == ["1", "2"]


def test_scan_drops_what_is_no_event(spark, tmp_path):
    good = json.dumps(ROWS[0])
    write(
        f"{tmp_path}/a/b/c/run.jsonl",
        good + "\r", "", "   ", good[:40], good + good, "{'id':'q'}", '{"id":NaN}', "[1]", "5", "null", good + " x",
        '  {"id":"n","ts":1706659200000,"level":3,"tags":"odd","source":5}  ', '{"id":"old","id":"new","data":{"b":1, "a":[ 1.5 ]}}',
    )
    write(f"{tmp_path}/a/other.log", good)
    rows = {r.id: r for r in scan_events(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["1", "n", "new"]
    assert (rows["n"].ts_ms, rows["n"].level, rows["n"].tags) == (NOW_MS, "3", None)
    assert rows["new"].data == '{"b":1,"a":[1.5]}'
    assert scan_events(spark, f"{tmp_path}/missing").count() == 0
    # The folder holds events of other services, too.
    assert ids(scan_events(spark, str(tmp_path), service="a")) == []
    assert scan_events(spark, str(tmp_path), service="b").count() == 0


def test_data_may_be_any_value(spark, tmp_path):
    values = ["plain text", 'say "hi"', "{}", {"data": "x"}, [1, "a"], 5, True, ""]
    write(f"{tmp_path}/svc/run.jsonl", *(json.dumps(row(i, data=v, tags={"data": "t"})) for i, v in enumerate(values)))
    found = {int(r.id): json.loads(r.data) for r in scan_events(spark, str(tmp_path)).collect()}
    assert found == dict(enumerate(values))


def test_only_jsonl_is_read_and_written(spark, tmp_path, make_events):
    write(f"{tmp_path}/svc/run.jsonl", json.dumps(ROWS[0]))
    write(f"{tmp_path}/svc/notes.txt", json.dumps(ROWS[1]))
    assert ids(scan_events(spark, str(tmp_path))) == ["1"]
    root = f"{tmp_path}/out"
    append_events(make_events({"id": "w", "message": 'a, "b" \\ # \x01 é\n'}, {"id": "v"}), root, fmt="jsonl")
    assert {f for _, _, files in os.walk(root) for f in files if f.startswith("part")} == {
        f for _, _, files in os.walk(root) for f in files if f.endswith(".jsonl")}
    assert {r.id: r.message for r in scan_events(spark, root).collect()} == {"w": 'a, "b" \\ # \x01 é\n', "v": None}


def test_names_of_services_are_taken_literally(spark, tmp_path, make_events):
    names = ["a/b", "*", "?x", "x{1,2}", "[q]", "50%", "a=b:c", "plain", "it's", "..", "back\\slash"]
    events = make_events(*({"id": str(i), "service": s} for i, s in enumerate(names)))
    root = f"{tmp_path}/store"
    append_events(events, root, fmt="jsonl")
    for i, s in enumerate(names):
        assert ids(scan_events(spark, root, service=s)) == [str(i)], s
    write(f"{tmp_path}/tree/x{{1,2}}/d/run.jsonl", json.dumps(row(4, service="x{1,2}")))
    write(f"{tmp_path}/tree/x1/d/run.jsonl", json.dumps(row(5, service="x1")))
    assert ids(scan_events(spark, f"{tmp_path}/tree", service="x{1,2}")) == ["4"]


def test_contains_needs_a_type(make_events):
    df = make_events({"id": "1", "session_id": "needle"}, {"id": "2", "session_id": "needle", "type": "t"}, {"id": "3", "message": "NEEDLE"})
    assert ids(df.filter(event_filter(contains="needle"))) == ["2", "3"]


def test_store_prunes_services_and_days(spark, make_events):
    root = shared_dir(spark, "store")
    events = make_events(
        {"id": "a", "ts": "2024-01-01T10:00:00Z", "service": "x", "level": "info"},
        {"id": "b", "ts": "2024-01-02T10:00:00Z", "service": "x", "level": "info"},
        {"id": "c", "ts": "2024-01-03T10:00:00Z", "service": "007", "level": "info"},
        {"id": "d", "ts": "never", "service": "x", "level": "warn"},
    )
    append_events(events, root)
    append_events(events.filter("id = 'a'"), root)
    assert ids(read_store(spark, root)) == ["a", "a", "b", "c", "d"]
    assert ids(read_store(spark, root, "007")) == ["c"]
    found = event_filter(service="x", since=bound_ms("2024-01-02", NOW_MS), until=bound_ms("2d", NOW_MS), day_column="date")
    recent = read_store(spark, root).filter(found)
    # Events without a readable time pass time filters; their folder is not pruned.
    assert ids(recent) == ["b", "d"]
    counts = stats(recent, "level")
    scan = next(x for x in counts._jdf.queryExecution().simpleString().split("\n") if "FileScan" in x)
    assert "2024-01-02" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0] or "19724" in scan
    detail = counts._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    partition = next(x for x in detail.split("\n") if x.startswith("PartitionFilters"))
    pushed = next(x for x in detail.split("\n") if x.startswith("PushedFilters"))
    schema = next(x for x in detail.split("\n") if x.startswith("ReadSchema"))
    assert "service" in partition and "date" in partition
    assert "GreaterThanOrEqual(ts_ms" in pushed
    assert "struct<level:string,ts_ms:bigint>" in schema


def test_append_rebalances(spark, make_events):
    from emberlog.operators.events import as_events
    from emberlog.sources.store import with_day

    df = with_day(as_events(make_events({"id": "1"}))).hint("rebalance", "service", "date")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(df)


def test_lines_are_parsed_once(spark, tmp_path):
    write(f"{tmp_path}/run.jsonl", json.dumps(ROWS[0]))
    df = scan_events(spark, str(tmp_path)).filter(event_filter(service="svc", levels=("warn",), query="disk"))
    assert optimized(df).count("emberlog-end-of-value: boolean") + optimized(df).count("StructField(emberlog-end-of-value") <= 1
    assert ids(df) == ["1"]


def test_stream(spark, tmp_path):
    inbox, root, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    defaults = IngestDefaults("front", "run-1", NOW_MS)

    def ingest():
        stream_ingest(read_line_stream(spark, inbox), root, checkpoint, defaults).awaitTermination()

    write(f"{inbox}/svc/d/one.jsonl", json.dumps(ROWS[0]), "oops", '{"id":"x","ts":"never","level":"LOUD","data":{"token":1}}')
    ingest()
    write(f"{inbox}/svc/d/two.jsonl", '{"message":"Bearer abc"}')
    ingest()
    ingest()
    rows = {r.id: r for r in read_store(spark, root).collect()}
    assert len(rows) == 3
    assert (rows["1"].service, rows["1"].message, rows["1"].data) == ("svc", "Disk nearly full", '{"mount":"/var","left":3}')
    x = rows["x"]
    assert (x.level, x.service, x.run_id, x.ts, x.ts_ms, x.date) == ("info", "front", "run-1", "never", None, None)
    assert x.data == '{"token":"[REDACTED]"}' and x.source.kind == "sdk"
    (new,) = (r for k, r in rows.items() if k not in ("1", "x"))
    assert (new.message, new.type, new.ts_ms) == ("[REDACTED]", "log", NOW_MS)
    assert len(new.id) == 36


@pytest.mark.parametrize("fmt", ["parquet", "jsonl"])
def test_an_append_that_runs_again(spark, make_events, tmp_path, fmt):
    root = str(tmp_path / "store")
    first = make_events(*({"id": f"a{i}", "ts": f"2024-03-0{1 + i % 3}T01:00:00.000Z", "service": f"s{i % 2}"} for i in range(20)))
    other = make_events({"id": "b", "ts": "2024-03-01T01:00:00.000Z", "service": "s0"}, {"id": "c", "service": "s9"})
    append_events(first, root, fmt, append_id="one")
    append_events(other, root, fmt, append_id="two")
    # Cut off between staging and publishing: some folders of the append are missing.
    gone = next(p for p in sorted((tmp_path / "store").rglob("append=one")))
    for file in gone.iterdir():
        file.unlink()
    append_events(first, root, fmt, append_id="one")
    append_events(other, root, fmt, append_id="two")
    found = read_store(spark, root) if fmt == "parquet" else scan_events(spark, root)
    assert sorted(r.id for r in found.collect()) == sorted([*(f"a{i}" for i in range(20)), "b", "c"])
    with pytest.raises(ValueError):
        append_events(first, root, fmt, append_id="")


def test_a_rare_session_is_looked_up_by_bloom_filters(spark, make_events, tmp_path):
    root = str(tmp_path / "store")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        append_events(make_events(*(
            {"id": f"e{i:04}", "ts": "2024-03-01T01:00:00.000Z", "service": "s", "session_id": f"{(i * 7919) % 2000:05}"}
            for i in range(2000)
        )), root)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    for id_ in ("00777", "no such"):
        found = read_store(spark, root).filter(F.col("session_id") == id_)
        rows = found.collect()
        want = [r for r in read_store(spark, root).collect() if r.session_id == id_]
        assert [r.id for r in rows] == [r.id for r in want]
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        # Least and greatest ids of every file enclose the one asked for.
        assert scan.metrics().apply("numOutputRows").value() <= 300
