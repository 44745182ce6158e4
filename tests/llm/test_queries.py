"""The registered queries against their DuckDB statements, and the pipeline against plain code."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from emberlog.llm.catalog import ORACLES, QUERIES
from plain_text import linked_components, sha

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}

with_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@with_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df, relation = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS[t] for c, t in df.dtypes} == types
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_points.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "jaccard_join", "source_mixing", "best_fit_packing"]


@with_tables
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
    texts = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in kept.items() if n != "best_fit_packing"}
    best = {}
    for i, t in texts["language_id"].items():
        best[sha(t)] = max(i, best.get(sha(t), i))
    assert set(texts["exact_dedup"]) == set(best.values())
    found, _ = linked_components(texts["exact_dedup"], 5, 8, 10)
    assert set(texts["jaccard_join"]) == {i for i, c in found.items() if i == c}
    assert set(texts["source_mixing"]) <= set(texts["jaccard_join"])
    assert kept["best_fit_packing"].select("doc_id").distinct().count() == len(texts["source_mixing"])


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, no_docs):
    for docs in (awkward, no_docs):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
            if name != "best_fit_packing":
                assert at.columns == docs.columns
        assert at.count() >= 0
