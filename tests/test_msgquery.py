"""Boolean message search against a plain Python evaluation."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.functions.msgquery import InvalidQuery, message_query, to_sql

CASES = [
    ("foo AND bar", "foo bar", True),
    ("foo AND bar", "foo", False),
    ("foo OR bar", "foo", True),
    ("foo OR bar", "baz", False),
    ("foo AND (bar OR baz)", "foo baz", True),
    ("foo AND (bar OR baz)", "foo qux", False),
    ("NOT foo", "foo", False),
    ("NOT foo", "bar", True),
    ("!foo", "foo", False),
    ("-foo", "foo", False),
    ("foo bar", "foo bar", True),
    ("foo bar", "foo", False),
    ('"Exact Phrase"', "exact phrase", True),
    ("ERROR", "some error happened", True),
    ("ERROR", "all good", False),
    # OR binds weaker than AND, NOT strongest and repeatable.
    ("a OR b c", "a", True),
    ("not not a", "a", True),
    ("- ! a", "a", True),
    # Inside a word these characters are literal; quoting escapes.
    ("x-y!z", "x-y!z", True),
    ('"say \\"hi\\""', 'say "hi"', True),
    ("it's", "it's", True),
    ("back\\slash", "back\\slash", True),
    ("(a)(b)", "ba", True),
    ('a ""', "a", True),
    ('foo "', "foo", True),
    ("and or", "x", None),
]


@pytest.mark.parametrize("query, message, expected", CASES)
def test_cases(spark, query, message, expected):
    if expected is None:
        with pytest.raises(InvalidQuery):
            message_query(query)
        return
    df = spark.createDataFrame([(message,)], "message string")
    assert df.select(message_query(query).alias("hit")).first()["hit"] is expected


@pytest.mark.parametrize(
    "query, reason",
    [
        ("", "Empty query"),
        ("  \t", "Empty query"),
        ("(", "Unexpected end of query"),
        ("foo AND", "Unexpected end of query"),
        ('"unterminated', "Unterminated quote at position 0"),
        ('a "x\\', "Unterminated quote at position 2"),
        ("AND foo", 'Expected term at position 0, found "and"'),
        ("foo OR )", 'Expected term at position 7, found "rparen"'),
        ("foo )", 'Unexpected token "rparen" at position 4'),
        ("(foo", 'Expected ")" at position 0'),
    ],
)
def test_invalid(query, reason):
    with pytest.raises(InvalidQuery) as error:
        to_sql(query, "m")
    assert str(error.value) == f"Invalid query: {reason}"


def test_null_message_is_empty_text(spark):
    df = spark.createDataFrame([(None,)], "message string")
    hits = df.select(message_query("NOT x").alias("a"), message_query("x").alias("b")).first()
    assert (hits.a, hits.b) == (True, False)


WORDS = st.sampled_from(["ab", "B", "c d", "-x", "AND", "é"])


def trees(depth=3):
    leaf = st.tuples(st.just("term"), WORDS)
    return st.recursive(
        leaf,
        lambda sub: st.one_of(
            st.tuples(st.just("not"), sub),
            st.tuples(st.just("and"), sub, sub),
            st.tuples(st.just("or"), sub, sub),
        ),
        max_leaves=6,
    )


def text_of(tree):
    kind, *args = tree
    if kind == "term":
        return f'"{args[0]}"'
    if kind == "not":
        return f"NOT ({text_of(args[0])})"
    joined = {"and": " ", "or": " OR "}[kind]
    return f"({text_of(args[0])}){joined}({text_of(args[1])})"


def value_of(tree, message):
    kind, *args = tree
    if kind == "term":
        return args[0].lower() in message.lower()
    if kind == "not":
        return not value_of(args[0], message)
    left, right = (value_of(a, message) for a in args)
    return left and right if kind == "and" else left or right


@settings(max_examples=15, deadline=None)
@given(st.lists(trees(), min_size=4, max_size=8))
def test_against_python(spark, forest):
    messages = ["", "AB c D", "b", "-X and", "É ab", "abC D-x"]
    df = spark.createDataFrame([(m,) for m in messages], "message string")
    hits = df.select("message", F.array(*[message_query(text_of(t)) for t in forest]).alias("h"))
    for row in hits.collect():
        assert row.h == [value_of(t, row.message) for t in forest]
