"""Benchmark decontamination against plain code."""

import re

import pytest
from pyspark.sql import functions as F

from emberlog.llm import decontamination
from emberlog.llm.decontamination import contamination
from plain_text import ascii_lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(texts, items, window=10):
    """For each text: number of words, places hit, ids of items found."""
    windows = {}
    for id_, text in items:
        words = WORD.findall(ascii_lower(text))
        for i in range(max(len(words) - window + 1, 1) if words else 0):
            windows.setdefault(tuple(words[i : i + window]), set()).add(id_)
    out = []
    for text in texts:
        words = WORD.findall(ascii_lower(text))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                ids = windows.get(tuple(words[i : i + size]))
                if ids is not None:
                    hit |= set(range(i, i + size))
                    found |= ids
        out.append((len(words), frozenset(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return out


def answers(df):
    out = []
    for r in df.collect():
        hit = frozenset(i for s in r["spans"] for i in range(s["start"], s["end"]))
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        out.append((r["n_words"], hit, tuple(r["items"])))
    return sorted(out, key=repr)


LONG = "the quick brown fox jumps over the lazy dog and then runs far away from it all"
ITEMS = [
    (1, LONG), (2, "Ünder-Water  words. ONE two THREE four five six seven eight nine"), (3, "a b"), (4, "rare"),
    (5, None), (6, " -- "), (7, "x x x x x x x x x x x x"), (8, "the quick brown fox jumps over the lazy dog and"), (None, "no id here"), (1, LONG),
]
TEXTS = [
    None, "", "...", "nothing of it", LONG.upper() + "!", "before " + LONG[:60] + " cut", "x " * 30, "x " * 9, "a b a b c a-b",
    "say: rare rare", "under-water", "ünder water words one two three four five six seven eight nine ten",
    "b a no id here", " ".join([LONG] * 3), "the quick brown fox " * 3 + LONG, "rare",
]


def tables(spark, clash=False):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    if clash:
        for c in ("row", "id", "words", "h", "pos", "window", "win", "start", "end", "item", "spans", "items", "n_words"):
            docs, items = docs.withColumn(c, F.lit("x")), items.withColumn(c, F.lit("y"))
    return docs.repartition(3), items


@pytest.mark.parametrize("small", [True, False])
def test_like_plain_code(spark, monkeypatch, small):
    if not small:  # the way of benchmarks that are too large to broadcast
        monkeypatch.setattr(decontamination, "MOST_PREFIXES", 0)
    docs, items = tables(spark, clash=True)
    assert answers(contamination(docs, items)) == sorted(plain(TEXTS, ITEMS), key=repr)


def test_windows_of_other_sizes(spark):
    docs, items = tables(spark)
    for window in (1, 2, 4):
        assert answers(contamination(docs, items, window)) == sorted(plain(TEXTS, ITEMS, window), key=repr)


def test_empty_tables_and_repeated_rows(spark):
    docs, items = tables(spark)
    assert contamination(docs.limit(0), items).count() == 0
    none = contamination(docs, items.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r["spans"] or r["items"] for r in none)
    twice = answers(contamination(docs.union(docs), items.union(items)))
    assert twice == sorted(plain(TEXTS * 2, ITEMS), key=repr)


def test_very_long_text_and_common_words(spark):
    passage = "the of the of the of the of the of a the of"
    text = " ".join(["the of"] * 40_000 + [passage] + ["of the"] * 20_000)
    docs = spark.createDataFrame([(1, text), (2, "the of " * 4), (None, passage)], "doc_id long, text string")
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    assert answers(contamination(docs, items)) == sorted(plain([text, "the of " * 4, passage], [("i", passage)]), key=repr)
