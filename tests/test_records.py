"""Foreign log records and ingest bodies."""

import json

from pyspark.sql import functions as F

from helpers import NOW_MS
from emberlog.functions.times import bound_ms, event_time_ms, resolve_since, Window
from emberlog.sources.bodies import ingest_bodies, ingest_documents, ingest_outcomes
from emberlog.sources.browser import browser_errors_to_events, console_to_events
from emberlog.sources.cloud import scan_cloud_logs
from emberlog.sources.pods import map_pod_records, scan_pod_logs

TS = "2026-02-11T01:00:14.457Z"


def pod_event(spark, message, pod="pod-1", container="container-1"):
    df = spark.createDataFrame([(pod, container, TS, message)], "pod string, container string, ts string, message string")
    row = map_pod_records(df, "svc").first()
    return row, json.loads(row.data)


def test_pod_json(spark):
    message = json.dumps({"timestamp": "2026-02-11T01:00:14.456Z", "level": "warn", "message": "user session failed", "pid": 47420, "context": "worker"})
    row, data = pod_event(spark, message)
    assert (row.ts, row.level, row.message) == ("2026-02-11T01:00:14.456Z", "warn", "user session failed")
    assert (row.service, row.run_id) == ("svc", "pod-1")
    assert data == {
        "pod": "pod-1", "container": "container-1", "raw_message": message,
        "timestamp": "2026-02-11T01:00:14.456Z", "pid": 47420, "context": "worker",
    }


def test_pod_other_spellings(spark):
    message = json.dumps({"time": "2026-02-11T01:00:14.332Z", "severity": "error", "msg": "upstream API request failed", "meta": ["detail"]})
    row, data = pod_event(spark, message)
    assert (row.ts, row.level, row.message) == ("2026-02-11T01:00:14.332Z", "error", "upstream API request failed")
    assert data["meta"] == ["detail"] and data["time"] == "2026-02-11T01:00:14.332Z"


def test_pod_plain_text(spark):
    row, data = pod_event(spark, "warn: plain log")
    assert (row.ts, row.level, row.message) == (TS, "warn", "warn: plain log")
    assert data == {"pod": "pod-1", "container": "container-1", "raw_message": "warn: plain log"}


def test_pod_data_wins_over_metadata(spark):
    message = json.dumps({"level": "info", "message": "hello", "data": {"foo": "bar", "pod": "from-json"}})
    row, data = pod_event(spark, message, container=None)
    assert data == {"pod": "from-json", "raw_message": message, "foo": "bar"}


def test_pod_numeric_level_is_plain_text(spark):
    for message in ('{"level":30,"msg":"x"}', '{"severity":{},"msg":"x"}', '{"msg":"x"} trailing'):
        row, data = pod_event(spark, message)
        assert row.message == message and list(data) == ["pod", "container", "raw_message"]
    # A falsy level is passed over; a known one is enough, whatever the severity is.
    assert pod_event(spark, '{"level":0,"severity":"WARN","msg":"x"}')[0].level == "warn"
    assert pod_event(spark, '{"level":"warn","severity":5,"msg":"x"}')[0].message == "x"


def test_pod_lines(spark):
    lines = ["2026-02-11T01:00:14.457123456Z hello there", "no stamp", "   ", "2026-02-11T01:00:14+01:00 x", "12:30 y"]
    df = spark.createDataFrame([("p", None, x) for x in lines], "pod string, container string, line string")
    found = {r.message: r.ts for r in scan_pod_logs(df, "app!=api", NOW_MS).collect()}
    now = "2024-01-31T00:00:00.000Z"
    assert found == {"hello there": TS, "no stamp": now, "x": "2026-02-11T00:00:14.000Z", "12:30 y": now}
    assert scan_pod_logs(df, "app!=api", NOW_MS).first().service == "api"


def test_cloud_rows(spark):
    rows = [
        ("e1", 1700000000000, '{"id":"x","level":"FATAL","message":"boom","tags":{"a":"b","n":1},"data":{"z":1, "a":2}}', "s"),
        ("e2", 0, "some warning", None),
        ("e3", None, None, "s"),
        ("e4", 1700000000000, '{"unrelated":1}', "s"),
        ("e5", 1700000000000, '{"source":{"file":"f.py","line":3,"backend_id":"own"},"q":1e2}', "s"),
    ]
    df = spark.createDataFrame(rows, "eventId string, timestamp bigint, message string, logStreamName string")
    found = {r.run_id + "/" + r.id: r for r in scan_cloud_logs(df, "/aws/lambda/fn/", NOW_MS).collect()}
    first = found["s/x"]
    assert (first.level, first.message, first.data, first.tags) == ("fatal", "boom", '{"z":1,"a":2}', {"a": "b"})
    assert first.service == "/aws/lambda/fn/" and first.source.backend == "cloudwatch"
    second = found["e2/e2"]
    assert (second.level, second.ts, second.data) == ("warn", "2024-01-31T00:00:00.000Z", '{"raw_message":"some warning"}')
    assert found["s/e3"].message == ""
    assert found["s/e4"].data.startswith('{"logStreamName":"s"')
    assert (found["s/e5"].source.file, found["s/e5"].source.line, found["s/e5"].source.backend_id) == ("f.py", 3, "own")


BODIES = {
    "object": '{"type":"x","message":"hello"}',
    "bad": "{not-json}",
    "array": '[{"id":"1"},{"id":"2"}]',
    "mixed": '[{"id":"1"},5]',
    "nested": '[[1,2]]',
    "scalar": "5",
    "null": "null",
    "empty": "",
    "none": "[]",
    "junk": '{"id":"1"} x',
    "lines": '{"id":"1"}\r\n"text"\n\n{"id":"2"}',
    "bad lines": '{"id":"1"}\n{oops',
    "large": '{"id":"' + "x" * 100 + '"}',
}


def test_bodies(spark):
    df = spark.createDataFrame(list(BODIES.items()), "name string, body string")
    outcomes = {r.name: (r.outcome, r["count"]) for r in ingest_outcomes(df, ["name"], max_bytes=90).collect()}
    bad, odd = ("invalid_json", None), ("invalid_payload", None)
    assert outcomes == {
        "object": ("ok", 1), "bad": bad, "array": ("ok", 2), "mixed": odd, "nested": ("ok", 1), "scalar": odd,
        "null": odd, "empty": bad, "none": ("ok", 0), "junk": bad, "lines": bad, "bad lines": bad, "large": ("too_large", None),
    }
    events = ingest_bodies(df, ["name"], max_bytes=90).collect()
    assert sorted((r.name, r.item_no, r.id) for r in events if r.id) == [("array", 0, "1"), ("array", 1, "2")]
    assert {r.name for r in events} == {"object", "array", "nested"}
    docs = ingest_documents(df, ["name"], service="cli").collect()
    found = sorted((r.name, r.id) for r in docs if r.id and r.name != "large")
    assert found == [("array", "1"), ("array", "2"), ("lines", "1"), ("lines", "2"), ("mixed", "1")]
    assert {r.service for r in docs} == {"cli"}


def test_browser(spark):
    calls = spark.createDataFrame(
        [("error", '["boom"]'), ("log", '["a",{"x": 1},2.0,null]'), ("trace", "[]")], "method string, args string"
    )
    found = [(r.level, r.message, r.data) for r in console_to_events(calls).collect()]
    assert found[0] == ("error", "boom", '{"args":["boom"]}')
    assert found[1][0] == "info" and found[1][1].startswith('a {"x":1} 2') and found[1][1].endswith(" null")
    assert found[2] == ("trace", "", '{"args":[]}')
    errors = spark.createDataFrame(
        [
            ("error", "", None, None, None, '{"message":"inner"}', None, None),
            ("error", None, "f.js", 3, 4, "5", None, None),
            ("rejection", None, None, None, None, None, '{"message":"r","stack":"s"}', True),
            ("rejection", None, None, None, None, None, '{"a": 1}', False),
        ],
        "kind string, message string, filename string, lineno int, colno int, error string, reason string, reason_is_error boolean",
    )
    rows = browser_errors_to_events(errors).collect()
    assert [(r.type, r.message, r.data) for r in rows] == [
        ("window.error", "inner", '{"error":{"message":"inner"}}'),
        ("window.error", "", '{"filename":"f.js","lineno":3,"colno":4,"error":{"message":"5"}}'),
        ("unhandledrejection", "r", '{"reason":{"message":"r","stack":"s"}}'),
        ("unhandledrejection", '{"a":1}', '{"reason":{"a":1}}'),
    ]


def test_times(spark):
    texts = {
        "2024-01-31T00:00:00.000Z": NOW_MS, "2024-01-31": NOW_MS, "2024-01-31T00:00Z": NOW_MS,
        "2024-01-31T01:00:00+01:00": NOW_MS, "2024-01-31T00:00:00.000999Z": NOW_MS, "2024-01-31 00:00:00": NOW_MS,
        "12:30": None, "now": None, "": None, "1706659200000": None, "2024-13-01": None, "soon": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.ms for r in df.select("t", event_time_ms(F.col("t")).alias("ms")).collect()}
    assert found == texts

    def value(column):
        return None if column is None else spark.range(1).select(column.alias("v")).first().v

    assert [value(bound_ms(t, NOW_MS)) for t in ("15m", " 2H ", "500ms", "1d", "2024-01-31", "junk", " ", None)] == [
        NOW_MS - 900_000, NOW_MS - 7_200_000, NOW_MS - 500, NOW_MS - 86_400_000, NOW_MS, None, None, None,
    ]
    plain, marked = Window(NOW_MS), Window(NOW_MS, checkpoint_ms=5)
    assert [value(resolve_since(t, w)) for t, w in ((None, plain), ("checkpoint", plain), (None, marked), ("checkpoint", marked), ("1s", marked))] == [
        NOW_MS - 300_000, NOW_MS - 300_000, 5, 5, NOW_MS - 1000,
    ]
