"""Redaction against a plain recursive walk."""

import json
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.functions.redaction import REDACTED, RedactionPolicy, _literal, redact_data, redact_text
from emberlog.operators.events import redact_events


def walk(value, keys, patterns):
    if isinstance(value, str):
        for p in patterns:
            value = re.sub(p, REDACTED, value, flags=re.I)
        return value
    if isinstance(value, list):
        return [walk(v, keys, patterns) for v in value]
    if isinstance(value, dict):
        return {k: REDACTED if k.lower() in keys else walk(v, keys, patterns) for k, v in value.items()}
    return value


def redacted(spark, texts, policy):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, data string")
    rows = df.select("i", redact_data(F.col("data"), policy).alias("data")).collect()
    return [r.data for r in sorted(rows, key=lambda r: r.i)]


def test_an_event(spark, make_events):
    policy = RedactionPolicy(keys=("pin", "Card Number"), patterns=(r"\bticket-\d{4}\b",))
    event = make_events({
        "id": "e7", "message": "pin 99 for ticket-2041, not ticket-20412",
        "data": '{"PIN":[7,8],"order":{"card number":{"last":4},"note":"see ticket-1234","total":12.50}}',
        "tags": {"Pin": "7", "queue": "ticket-0001!"},
    })
    row = redact_events(event, policy).first()
    assert row.message == "pin 99 for [REDACTED], not ticket-20412"
    assert row.data == (
        '{"PIN":"[REDACTED]","order":{"card number":"[REDACTED]","note":"see [REDACTED]","total":12.50}}')
    assert row.tags == {"Pin": "[REDACTED]", "queue": "[REDACTED]!"}
    assert redact_events(event, RedactionPolicy(enabled=False)).first().tags == {"Pin": "7", "queue": "ticket-0001!"}


def test_patterns_of_another_dialect(spark):
    policy = RedactionPolicy(keys=(), patterns=(
        r"(?<=pass(?:word|code)?\s*=\s*)\w+", "{id:[^}]+}", r"(?<![a-z]+)\d{3,}", "(?P<x>y)", "[", "(?<n>zz)\\k<n>",
    ))
    assert policy.unusable_patterns() == ["(?P<x>y)", "["]
    df = spark.createDataFrame([("passcode =   abc; {id:5} {id:} 12345 a1 zzzz",)], "m string")
    with pytest.warns(UserWarning, match="without effect"):
        found = df.select(redact_text(F.col("m"), policy).alias("m")).first().m
    assert found == "passcode =   [REDACTED]; [REDACTED] {id:} [REDACTED] a1 [REDACTED]"
    texts = ['{"a":"password=xyz {id:7}","b":["777"]}']
    assert redacted(spark, texts, policy) == ['{"a":"password=[REDACTED] [REDACTED]","b":["[REDACTED]"]}']


@pytest.mark.parametrize("blanks", [0, 5, 1000, 1001, 5000, 60_000])
def test_look_behind_has_no_bound(spark, blanks):
    policy = RedactionPolicy(keys=(), patterns=(r"(?<=user\s*)\d+",))
    text = "id 7, USER" + " " * blanks + "12345, user"
    clean = text.replace("12345", REDACTED)
    assert spark.createDataFrame([(text,)], "m string").select(redact_text(F.col("m"), policy).alias("m")).first().m == clean
    assert redacted(spark, [json.dumps({"a": text}, separators=(",", ":"))], policy) == [
        json.dumps({"a": clean}, separators=(",", ":"))]


LOOKING = (
    r"(?<=user\s*)\d+", r"(?<=a+b*)[1-3]", r"(?<![a-z]+)\d{2,}", r"(?<=x*a|=\s*)u\w*|(?<=b+)\s", r"(?<=u.*)2",
    r"(?<=(a|s)+)=", r"(?:(?<=r+))1+", r"(?<=a\s+)(?<=\s*)b?", r"(?<=(u)s*)e\1?", r"1(?<=a[ =]{1,}1)",
)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("users=ab12 \t", max_size=24), min_size=30, max_size=60))
def test_look_behind_like_an_engine_without_bounds(spark, texts):
    """``regex`` looks behind over any length, as ECMAScript does."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    usable = RedactionPolicy(patterns=LOOKING).usable_patterns()
    assert len(usable) >= len(LOOKING) - 1
    columns = [redact_text(F.col("m"), RedactionPolicy(keys=(), patterns=(p,))).alias(f"p{i}") for i, p in enumerate(usable)]
    for row in df.select("i", *columns).collect():
        want = [regex.sub(p, REDACTED, texts[row.i], flags=regex.I | regex.V0) for p in usable]
        assert list(row)[1:] == want


@pytest.mark.parametrize("pattern, needed", [
    (r"(?<=user\s*)\d+", "user"), (r"Bearer\s+x", "bearer"), ("ab?cd", "cd"), ("a|b", ""), ("(ab)*c", "c"), ("xy{0,2}z", "x"),
    (r"(?<=a|b)cd", "cd"), (r"(?<!secret)x", "x"), (r"a\.b+c", "a.b"), ("[abc]d", "d"), ("é1", "1"), ("ab(?=cde)", "ab"),
])
def test_text_that_every_match_needs(pattern, needed):
    assert _literal(pattern) == needed


def test_data_details(spark):
    policy = RedactionPolicy(keys=(" Token ", ""), patterns=("(bad", r"Bearer\s+\w+", "^secret$"))
    texts = [
        '{"TOKEN":{"a":[1]},"n":1.50,"big":12345678901234567890,"x":null}',
        '{"a":"Bearer\\nabc"}',  # the blank is hidden by an escape
        '{"tok\\u0065n":"v"}',  # so is the key
        '{"a":"Bearer abc","b":["secret","secret "]}',
        '{"Bearer abc":1}',  # keys are never rewritten
        None,
        "not json token",
        '{"plain":"text"}',
    ]
    assert redacted(spark, texts, policy) == [
        '{"TOKEN":"[REDACTED]","n":1.50,"big":12345678901234567890,"x":null}',
        '{"a":"[REDACTED]"}',
        '{"token":"[REDACTED]"}',
        '{"a":"[REDACTED]","b":["[REDACTED]","secret "]}',
        '{"Bearer abc":1}',
        None,
        "not json token",
        '{"plain":"text"}',
    ]


@pytest.mark.parametrize("depth", [900, 6_000, 20_000])
def test_deep_and_broken_data(spark, depth):
    deep = '{"a":' * depth + '{"token":1}' + "}" * depth
    lists = "[" * depth + '"Bearer x"' + "]" * depth
    open_ = "[" * depth + '{"token": Bearer abc'
    found = redacted(spark, [deep, lists, open_], RedactionPolicy())
    assert found == [deep.replace("1", '"[REDACTED]"'), lists.replace("Bearer x", "[REDACTED]"),
                     open_.replace("Bearer abc", "[REDACTED]")]


def test_odd_json(spark):
    texts = ['"Bearer a"', '{"a":"\\ud800 Bearer b"}', '{"k":1,"token":2,"k":"Bearer c"}', '[1,]', '{"token":1} x',
             '{"\\u0000":NaN,"t\\tk":-0.10e5}', "", "{}", "[[],{}]"]
    assert redacted(spark, texts, RedactionPolicy()) == [
        '"[REDACTED]"', '{"a":"\ufffd [REDACTED]"}', '{"k":"[REDACTED]","token":"[REDACTED]"}', "[1,]", '{"token":1} x',
        '{"\\u0000":NaN,"t\\tk":-0.10e5}', "", "{}", "[[],{}]"]


def test_message_patterns_in_order(spark):
    df = spark.createDataFrame([("xx AB end\n",)], "m string")
    policy = RedactionPolicy(keys=(), patterns=("[[x]+", "ab", r"\[redacted\] end", "D]$"))
    assert df.select(redact_text(F.col("m"), policy).alias("m")).first().m == "[REDACTED] [REDACTED]\n"


LEAVES = st.one_of(
    st.none(), st.booleans(), st.integers(-5, 5),
    st.sampled_from(["ok", "Bearer x.y", "a\\b", "token", 'q"', "sk-" + "a" * 22, "é bearer  z"]),
)
TREES = st.recursive(
    LEAVES,
    lambda sub: st.one_of(
        st.lists(sub, max_size=3),
        st.dictionaries(st.sampled_from(["token", "Secret", "a", "b\\c", "tokens"]), sub, max_size=3),
    ),
    max_leaves=8,
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "PASSWORD", "x"]), TREES, max_size=3), min_size=15, max_size=25))
def test_against_plain_walk(spark, objects):
    policy = RedactionPolicy()
    texts = [json.dumps(o, separators=(",", ":"), ensure_ascii=False) for o in objects]
    found = [json.loads(t) for t in redacted(spark, texts, policy)]
    assert found == [walk(o, set(policy.keys), policy.patterns) for o in objects]


TOKENS = st.sampled_from(["{", "}", "[", "]", ":", ",", '"a"', '"token"', "1", "null", " ", '"s\\u0041"', '{"a":', '{"token":', '{"b":', "}}", "{}"])


@settings(max_examples=3000, deadline=None)
@given(st.one_of(
    st.lists(TOKENS, max_size=10).map("".join), TREES.map(json.dumps),
    TREES.map(lambda t: json.dumps(t, separators=(",", ":"), ensure_ascii=False)),
))
def test_streamed_like_the_tree(text):
    from emberlog.functions import redaction

    keys = frozenset({"token", "secret"})
    try:
        want = redaction._apart(redaction._read(text), keys)
    except ValueError:
        want = None
    try:
        assert redaction._streamed(text, keys) == want
    except ValueError:
        assert want is None
    except redaction._Repeated:
        pass
