import random
import zlib

import pytest

from emberlog.llm.toxicity import FEATURES, fit, held_out, score, train


@pytest.fixture(scope="module")
def planted(spark, docs_of):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(600)]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for w in rng.sample(["Vile!", "rotten,", "nasty", "awful."], 3):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), "en", "a"))
        if i % 5 < 4:
            labels.append((i, 1, int(toxic)))
    return docs_of(rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(planted):
    docs, labels = planted
    weights = train(docs, labels)
    assert 1 < len(weights[0]) < FEATURES // 100
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = score(docs, weights)
    assert out.columns == ["doc_id", "score"]
    rows = [(r["score"] >= 0.5, toxic[r["doc_id"]]) for r in out.collect()
            if r["doc_id"] in toxic and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) > 150
    assert sum(p == t for p, t in rows) / len(rows) > 0.95


def test_held_out_labels_are_not_learned(planted):
    docs, labels = planted
    flipped = labels.selectExpr(
        "doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = train(docs, labels), train(docs, flipped)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_awkward_rows(awkward, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, None, 1), (None, 1, 1), (5, 1, None), (7, 0, 1), (8, 0, 0)],
                                "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        rows = score(awkward, train(awkward, labels)).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], set()).add(r["score"])
        assert by[1] == by[2] and len(by[9]) == 1
    assert score(no_docs, train(no_docs, none)).count() == 0
    assert {r[0] for r in awkward.filter("doc_id is null").select(held_out(awkward["doc_id"])).collect()} == {False}


def test_one_kind_of_label():
    at, w = fit([], [])
    assert list(at) == [FEATURES] and w[0] < 0
    at, w = fit([__import__("numpy").array([3])], [1])
    assert w[0] > 0
