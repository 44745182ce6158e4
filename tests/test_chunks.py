"""Line assembly against plain string handling, with streams of very different size."""

import random
import re

from helpers import plan

from emberlog.sources.chunks import chunk_events, lines_from_chunks

BLANK = " \t\n\x0b\f\r ﻿"


def expected(chunks):
    """(stream, kind) -> lines, the way a reader of one buffer sees them."""
    out = {}
    for (stream, kind), parts in chunks.items():
        text = "".join(c or "" for _, c in sorted(parts, key=lambda p: p[0]))
        out[stream, kind] = [x for x in re.split(r"\r?\n", text) if x.strip(BLANK)]
    return out


def run(spark, chunks, **options):
    rows = [(s, k, q, c) for (s, k), parts in chunks.items() for q, c in parts]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id string, kind string, seq bigint, chunk string").repartition(5)
    found = {}
    for r in lines_from_chunks(df, **options).collect():
        place = (-1 if r.open_seq is None else r.open_seq + 10**9, r.line_no)
        found.setdefault((r.stream_id, r.kind), []).append((place, r.line))
    return {k: [line for _, line in sorted(v)] for k, v in found.items()}


def compare(spark, chunks, **options):
    want = {k: v for k, v in expected(chunks).items() if v}
    assert run(spark, chunks, **options) == want


def test_small_cases(spark):
    compare(spark, {
        ("a", "stdout"): [(0, "hello std"), (1, "out\nnext"), (2, None), (3, " line\n\n"), (4, "tail")],
        ("a", "stderr"): [(0, "oops\r"), (1, "\nmore\r\n"), (2, "\r"), (3, "")],
        ("b", "stdout"): [(7, "no break"), (9, " at all")],
        (None, "stdout"): [(0, "x\ny"), (1, "z\n")],
        ("c", "stdout"): [(0, "a\nb\nc\nd")],
        ("d", "stdout"): [(0, "   \n"), (1, "\t")],
    })


def test_random_streams_with_a_hot_one(spark):
    rng = random.Random(7)
    chunks = {}
    for stream, n in (("hot", 900), ("warm", 40), ("cold", 3)):
        for kind in ("stdout", "stderr"):
            # Sparse positions, so that blocks are mostly empty.
            seqs = sorted(rng.sample(range(-5_000, 10_000_000), n))
            chunks[stream, kind] = [
                (q, "".join(rng.choice(["ab", "é", "\n", "\r\n", " ", ""]) for _ in range(rng.randrange(6))))
                for q in seqs
            ]
    # Tiny blocks force every level to carry lines over.
    for block, levels in ((50, 3), (1000, 2), (1 << 16, 1)):
        compare(spark, chunks, block=block, levels=levels)


def test_no_task_holds_a_stream(spark):
    df = spark.createDataFrame([("a", "stdout", 0, "x")], "stream_id string, kind string, seq bigint, chunk string")
    text = plan(lines_from_chunks(df))
    # Every shuffle of chunk text is keyed by a block or by the chunk a line begins in.
    wide = [x for x in text.split("\n") if "Exchange hashpartitioning(stream_id" in x]
    assert any("_block2" in x for x in wide)
    assert "Join" not in text


def test_events_of_lines(spark):
    df = spark.createDataFrame(
        [("p", "stdout", 0, "hello stdout\n"), ("p", "stderr", 0, "oops\n")],
        "stream_id string, kind string, seq bigint, chunk string",
    )
    rows = {r.type: (r.level, r.message) for r in chunk_events(df).collect()}
    assert rows == {"stdout": ("info", "hello stdout"), "stderr": ("error", "oops")}
