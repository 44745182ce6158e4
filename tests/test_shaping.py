"""Field selection, text lines, shortened messages and the size guard."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.functions.paths import event_json, event_line
from emberlog.functions.text import trim_message, truncate_message
from emberlog.functions.times import Window
from emberlog.operators.shaping import output_cap, project_fields
from emberlog.plans.request import SearchRequest, Settings
from emberlog.plans.search import search

STAMP = "2023-11-07T16:20:31.250Z"
EVENT = {
    "id": "ev-42", "ts": STAMP, "level": "warn", "type": "job", "service": "billing", "run_id": "nightly-3",
    "session_id": "till 9", "message": "invoice 77 came late", "data": '{"invoice":{"no":77,"lines":["a","b"]},"paid":false}',
    "tags": {"region": "north", "tier": "2"},
}
WHOLE_DATA = EVENT["data"]


@pytest.fixture(scope="module")
def event(make_events):
    return make_events(EVENT)


def one(df, column):
    return df.select(column.alias("v")).first().v


def test_projection(event):
    # Columns come in the order asked for; what no event has is left out.
    assert project_fields(event, ["run_id", "colour", "level", "id"]).columns == ["run_id", "level", "id"]
    nested = project_fields(event, ["level", "data.invoice.no", "tags.region"]).first()
    assert (nested.level, nested.data.invoice.no, nested.tags.region) == ("warn", "77", "north")
    flat = project_fields(event, ["tags.tier", "data.paid"], flatten=True).first()
    assert flat.asDict() == {"tags.tier": "2", "data.paid": "false"}


@pytest.mark.parametrize(
    "fields, flatten, expected",
    [
        (["run_id", "colour", "id"], False, '{"run_id":"nightly-3","id":"ev-42"}'),
        (["data.invoice.no", "level", "tags.tier"], False, '{"data":{"invoice":{"no":77}},"level":"warn","tags":{"tier":"2"}}'),
        (["tags.tier", "source.file", "data.invoice.lines"], True, '{"tags.tier":"2","data.invoice.lines":["a","b"]}'),
        # A path and what encloses it: the whole wins, in either order.
        (["data.paid", "data", "data.due"], False, f'{{"data":{WHOLE_DATA}}}'),
        (["data", "data.invoice.no"], False, f'{{"data":{WHOLE_DATA}}}'),
        (["level.size", "data..paid", ""], False, "{}"),
    ],
)
def test_projection_as_json(event, fields, flatten, expected):
    assert one(event, event_json(fields, flatten)) == expected


def test_json_values_keep_their_types(make_events):
    data = '{"sum":{"net":9.50,"parts":[{"x":null},2]},"code":"007","left":7,"done":false,"note":null,"o\'clock":"noon"}'
    df = make_events({"id": "ev-43", "data": data})
    fields = ["data.sum.net", "data.sum.parts", "data.code", "data.left", "data.done", "data.note", "data.sum.parts.x", "data.o'clock"]
    assert one(df, event_json(fields, True)) == (
        '{"data.sum.net":9.5,"data.sum.parts":[{"x":null},2],"data.code":"007","data.left":7,"data.done":false,'
        '"data.note":null,"data.o\'clock":"noon"}'
    )


@pytest.mark.parametrize(
    "template, expected",
    [
        (None, f"{STAMP} warn billing job session=till 9 invoice 77 came late"),
        ("[{level}] {run_id}: {message}", "[warn] nightly-3: invoice 77 came late"),
        ("{tags.region}/{data.invoice.no}/{data.paid}", "north/77/false"),
        ("{id};{colour};{tags.tier};{data}", f"ev-42;;2;{WHOLE_DATA}"),
        ("<{ {id}}> {data.due} \t ", "<{ ev-42}>"),
    ],
)
def test_lines(event, template, expected):
    assert one(event, event_line(template)) == expected


def test_all_tags_in_a_line(make_events):
    assert one(make_events({"id": "ev-44", "tags": {"shift": "late"}}), event_line("{tags}!")) == '{"shift":"late"}!'


def test_line_without_session(event):
    bare = event.withColumn("session_id", F.lit(None).cast("string"))
    assert one(bare, event_line()) == f"{STAMP} warn billing job invoice 77 came late"


def shorten(message, cap, match):
    """The same rule on a Python string."""
    if len(message) <= cap:
        return message
    if cap <= 3:
        return message[:cap]
    at = message.lower().find(match.lower()) if match else -1
    if at < 0:
        room = cap - 3
        tail = room // 2
        return message[: room - tail] + "..." + (message[-tail:] if tail else "")
    centre = at + len(match) // 2

    def cut(width):
        start = max(0, min(centre - width // 2, max(0, len(message) - width)))
        return start, min(len(message), start + width)

    width = max(1, cap - 6)
    start, end = cut(width)
    width = min(len(message), width + 3 * (start == 0) + 3 * (end == len(message)))
    start, end = cut(width)
    text = ("..." if start else "") + message[start:end] + ("..." if end < len(message) else "")
    return text[:cap]


@settings(max_examples=25, deadline=None)
@given(
    st.integers(1, 24),
    st.sampled_from([None, "b", "AB", "abc", "zz"]),
    st.lists(st.text("abcé Z", max_size=40), min_size=20, max_size=30),
)
def test_trim(spark, cap, match, messages):
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    rows = df.select("m", trim_message(F.col("m"), cap, match).alias("t")).collect()
    assert all(r.t == shorten(r.m, cap, match) for r in rows)


def test_trim_known_cases(spark):
    df = spark.createDataFrame([("0123456789 and then some more",)], "m string")
    m = F.col("m")
    assert one(df, trim_message(m, 11, "zzz")) == "0123...more"
    assert one(df, trim_message(m, 0)) == one(df, m)
    assert one(df, truncate_message(F.lit("late invoice"), 7)) == "late..."
    assert one(df, truncate_message(F.lit("paid"), 3)) == "pai"
    assert one(df, truncate_message(F.lit("paid"), 4)) == "paid"


def test_guard(make_events):
    df = make_events(*[{"id": str(i), "ts": f"2024-01-30T23:59:0{i}Z", "message": "x" * 200} for i in range(3)])
    window = Window(1_706_659_200_000)
    answer = search(df, SearchRequest(max_output_chars=10), window).deliver()
    row = answer.first()
    assert row.blocked and row.code == "output_too_large" and row.item_count == 3
    assert row.max_output_chars == 10 and row.estimated_output_chars > 600
    assert (row.avg_message_chars, row.max_message_chars) == (200, 200)
    assert "(10)" in row.message and '"action":"force"' in row.suggestions
    for request in (SearchRequest(max_output_chars=10, force=True), SearchRequest(), SearchRequest(max_output_chars=-1)):
        assert search(df, request, window).deliver().columns == ["rank", "payload"]
    # Sizes are those of the full messages, also when the answer is trimmed.
    trimmed = search(df, SearchRequest(max_message_chars=5), window, Settings())
    assert trimmed.report().first().max_message_chars == 200
    assert len(trimmed.events().first().message) == 5


def test_caps():
    assert [output_cap(v) for v in (None, 0, -3, float("inf"), float("nan"), 0.5, 7.9)] == [None] * 6 + [7]
