import os
import time
import zlib

import duckdb
import pytest
import regex

from emberlog.llm.catalog import QUERIES
from emberlog.llm.quality_rules import STOP_WORDS, SYMBOLS, quality
from emberlog.llm.sharding import LAYOUT_SQL, interleave
from plain_text import WORD, repeat_words

SF = "/root/testdata/sf0.001"


def test_measures_of_awkward_rows(awkward, docs_of, no_docs):
    more = docs_of([(50, "a b c a b c x\n\na\n \na\nb *#", "en", "a"), (51, "a a a a a", "en", "a"),
                    (52, "x y z", "en", "a"), (53, "x y z w x y", "en", "a")])
    for df in (awkward, more):
        texts = {}
        for r in df.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], []).append(r["text"] or "")
        got = {}
        for r in quality(df).collect():
            got.setdefault(r["doc_id"], []).append((
                r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
            assert not (r["kept"] and r["base_failed"])
        want = {}
        for i, ts in texts.items():
            for t in ts:
                words = WORD.findall(t)
                lines = [x for x in t.split("\n") if WORD.search(x)]
                n = repeat_words(t)
                want.setdefault(i, []).append((
                    len(words), sum(map(len, words)), sum(c in SYMBOLS for c in t), len(lines) - len(set(lines)), n,
                    len(words) < 50 or 100 * n > 50 * len(words)))
        assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert quality(no_docs).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_layout_against_sql(spark):
    got = QUERIES["op10_sharding"](spark, SF)
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(LAYOUT_SQL).fetchall())
    assert sorted((r["doc_id"], r["size"], r["law"], r["shard"], r["slot"], r["grown_shard"]) for r in rows) == want


def test_every_shard_has_the_mixture(docs_of, monkeypatch):
    import emberlog.llm.sharding as s

    monkeypatch.setattr(s, "BUCKET_ROWS", 16)  # so that ranks come from many buckets
    rows = [(i, "x", "en", "big" if i % 3 else f"small{i % 2}") for i in range(1003)]
    got = interleave(docs_of(rows).select("doc_id", "source"), 8, ["doc_id"]).collect()
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(8))
    assert {len(x) for x in shards.values()} <= {125, 126}
    for x in shards.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
        assert abs(sum(r["source"] == "big" for r in x) - 668 / 8) <= 2


def test_awkward_rows_are_placed(awkward, no_docs):
    got = interleave(awkward, 4, ["doc_id"])
    assert got.columns == [*awkward.columns, "shard", "slot"]
    places = [(r["shard"], r["slot"]) for r in got.collect()]
    assert sorted(places) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3),
                              (2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (3, 1), (3, 2)]
    assert interleave(no_docs, 4, ["doc_id"]).count() == 0


def test_long_repeating_text_is_measured_in_linear_time(docs_of):
    text = " ".join(f"w{i % 100_000}" for i in range(300_000))
    started = time.monotonic()
    (row,) = quality(docs_of([(1, text, "en", "a")])).collect()
    assert (row["n_words"], row["n_repeat_words"]) == (300_000, 300_000)
    assert time.monotonic() - started < 60


def test_stop_words_end_at_their_last_letter(docs_of):
    words = "The the, THE!! the-x x-the 'the más MÁS. qu\u0130 \u0130 de\u2028 de\u2028x 1 ... them und4 und4x"
    (row,) = quality(docs_of([(1, words, "en", "a")])).collect()
    stop = {w for line in STOP_WORDS for w in line.split()}
    stripped = [regex.sub(r"[^\p{L}]+$", "", w).lower() for w in WORD.findall(words)]
    assert row["n_stop_words"] == sum(w in stop for w in stripped) == 7


def test_columns_named_like_results_move(docs_of):
    docs = docs_of([(i, "a b c", "en", "a") for i in range(4)]).selectExpr(
        "doc_id", "text", "source", "doc_id as n_words", "doc_id as KEPT", "doc_id as _kept", "doc_id as words")
    got = quality(docs, keep=["doc_id", "n_words", "KEPT", "_kept", "words"])
    assert got.columns[:5] == ["doc_id", "_n_words", "__KEPT", "_kept", "words"]
    assert {(r["doc_id"], r["_n_words"], r["__KEPT"], r["n_words"], r["kept"]) for r in got.collect()} == {
        (i, i, i, 3, False) for i in range(4)}
    rows = docs.selectExpr("doc_id", "source", "doc_id as shard", "doc_id as Slot")
    placed = interleave(rows, 2, ["shard"])
    assert placed.columns == ["doc_id", "source", "_shard", "_Slot", "shard", "slot"]
    assert sorted((r["shard"], r["slot"]) for r in placed.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert interleave(rows.limit(0), 2, ["shard"]).columns == placed.columns
