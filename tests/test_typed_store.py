"""A store that keeps ``data`` as VARIANT beside its text."""

import json
import os

import pytest
from helpers import plan
from pyspark.sql import functions as F

from emberlog.operators.aggregates import stats
from emberlog.sources.store import append_events, read_store, read_typed_store

DATA = [
    '{"stage":"load","n":1}', '{"stage":"save","n":2,"deep":{"b":1,"a":[2]}}', '{"stage":7}', '{"stage":null}', '{"n":3}',
    '{"stage":{"stage":"x"}}', "[1,2]", '"stage"', None, '{"stage":"load","stage":"last"}', '{"stage":""}', '{"a.stage":"x"}',
]


def some(make_events, name, rows=DATA):
    return make_events(*(
        {"id": f"{name}{i}", "ts": f"2024-01-{1 + i % 3:02d}T00:00:00.000Z", "level": "info", "type": "log",
         "service": "api", "run_id": "r", "session_id": "s", "message": "m", "data": data}
        for i, data in enumerate(rows)
    ))


def counts(df):
    return {r["key"]: r["count"] for r in df.collect()}


@pytest.fixture(scope="module")
def store(spark, make_events, tmp_path_factory):
    """One append with text only, one with VARIANT."""
    root = str(tmp_path_factory.mktemp("typed") / "store")
    append_events(some(make_events, "old"), root)
    append_events(some(make_events, "new"), root, typed_data=True)
    return root


def test_stages_by_either_reading(spark, store):
    typed, text = stats(read_typed_store(spark, store), "stage"), stats(read_store(spark, store), "stage")
    assert counts(typed) == counts(text)
    assert counts(typed)["load"] == 2 and counts(typed)["last"] == 2 and counts(typed)[""] == 2


def test_rows_are_the_same_and_keep_their_text(spark, store):
    typed, plain = read_typed_store(spark, store), read_store(spark, store)
    assert typed.columns == [*plain.columns, "data_v"]
    shown = [c for c in plain.columns if c != "tags"]
    assert sorted(typed.select(shown).collect(), key=lambda r: r.id) == sorted(plain.select(shown).collect(), key=lambda r: r.id)
    for r in typed.select("data", F.to_json("data_v").alias("v")).collect():
        assert (r.v is None) == (r.data is None) and (r.v is None or json.loads(r.v) == json.loads(r.data))


def test_only_the_leaf_is_read(spark, make_events, tmp_path):
    append_events(some(make_events, "n"), str(tmp_path), typed_data=True)
    shown = plan(stats(read_typed_store(spark, str(tmp_path)), "stage"))
    scans = [line[line.index("ReadSchema"):] for line in shown.splitlines() if "ReadSchema" in line]
    # One scan reads the leaf, the other, of files without it, the text; neither reads both.
    assert len(scans) == 2 and "message" not in shown
    leaf = [s for s in scans if "data_v" in s]
    assert len(leaf) == 1 and "data_v:struct<" in leaf[0] and "data:string" not in leaf[0]
    assert all("data_typed" in s for s in scans)


def test_files_hold_leaves_and_a_mark(spark, make_events, tmp_path):
    import pyarrow.parquet as pq

    append_events(some(make_events, "n", ['{"stage":"a","n":1}'] * 30), str(tmp_path), typed_data=True)
    files = [os.path.join(top, f) for top, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    leaves = {c.path for f in files for c in pq.ParquetFile(f).schema}
    assert "data_v.typed_value.stage.typed_value" in leaves


def test_a_service_an_append_again_and_no_store(spark, make_events, tmp_path):
    root = f"{tmp_path}/s"
    assert stats(read_typed_store(spark, root), "stage").count() == 0
    for _ in range(2):
        append_events(some(make_events, "n"), root, append_id="one", typed_data=True)
    assert read_typed_store(spark, root, "api").count() == len(DATA)
    assert read_typed_store(spark, root, "other").count() == 0
    with pytest.raises(ValueError):
        append_events(some(make_events, "n"), root, fmt="jsonl", typed_data=True)
