"""Exact deduplication by two passes over a Bloom filter of text hashes.

``exact_groups`` looks rows up in a :class:`RepeatFilter`, of several hash functions, which grows with the rows.

``exact_dedup`` marks, in a bit array of one hash function, the cells that two or more rows fall into. The
array has about 16 bits for each row, up to ``MAX_BITS`` (4 million 64-bit words, about 130 MB as a broadcast
table). Beyond that bound more rows are possibly repeated and take the shuffle; results stay the same.

In both, a row that no other can be equal to passes straight through; the others alone are shuffled
and settled by their whole SHA-256.

NULL texts count as empty, empty texts equal each other. Of equal texts the row with the largest
id stays, rows without an id stay only where no row of the group has one; of rows that agree in
text and id exactly one stays. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.repeat_filter import RepeatFilter
from emberlog.llm.support import fresh, lower_ascii, table, with_bit, written

MIN_BITS = 1 << 20
MAX_BITS = 1 << 28
_SEGMENT = 1 << 18


def text_hash(text: Column) -> Column:
    """SHA-256, as 32 bytes, of a text whose A-Z are in lower case."""
    return F.unhex(F.sha2(lower_ascii(text), 256))


def _cell(sha: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(bits))


def _task_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's rows, the cells met once and those met again, by segment."""
    seen = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
    cells, counts = np.unique(np.concatenate(seen) if seen else np.empty(0, np.int64), return_counts=True)
    segments, starts = np.unique(cells // _SEGMENT, return_index=True)
    bounds = [*starts, len(cells)]
    local = (cells % _SEGMENT).astype(np.uint32)
    for seg, a, b in zip(segments, bounds, bounds[1:]):
        yield pa.RecordBatch.from_pydict({
            "seg": pa.array([seg], pa.int64()),
            "cells": [local[a:b].tobytes()],
            "again": [local[a:b][counts[a:b] > 1].tobytes()],
        })


def _merge_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment, rows sorted by it, the cells met in two rows or more, as 64-bit words."""
    at, once, twice = None, None, None

    def done():
        words = np.packbits(twice, bitorder="little").view(np.int64)
        filled = np.flatnonzero(words)
        return pa.RecordBatch.from_arrays(
            [pa.array(filled + at * (_SEGMENT // 64)), pa.array(words[filled])], ["word", "bits"]
        )

    for batch in batches:
        for seg, cells, again in zip(*(c.to_pylist() for c in batch.columns)):
            if seg != at:
                if at is not None:
                    yield done()
                at, once, twice = seg, np.zeros(_SEGMENT, bool), np.zeros(_SEGMENT, bool)
            cells = np.frombuffer(cells, np.uint32)
            twice[cells[once[cells]]] = True
            twice[np.frombuffer(again, np.uint32)] = True
            once[cells] = True
    if at is not None:
        yield done()


def repeated_cells(df: DataFrame, sha: str, bits: int) -> DataFrame:
    """The words of the bit array of the cells that two or more rows fall into."""
    return written(
        df.select(_cell(sha, bits).alias("cell"))
        .mapInArrow(_task_cells, "seg long, cells binary, again binary")
        .repartition("seg")
        .sortWithinPartitions("seg")
        .mapInArrow(_merge_cells, "word long, bits long"),
        "repeated",
    )


def _filter_bits(rows: int) -> int:
    return min(max(1 << (16 * max(rows, 1) - 1).bit_length(), MIN_BITS), MAX_BITS)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its group of equal texts: id, keep_id, group_size, kept, text_sha256."""
    keys = written(
        docs.select(
            F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "text-hashes",
    )
    marked = RepeatFilter(keys, "sha", keys.count()).marked(keys, "sha", "again")
    alone = marked.filter(~F.col("again")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    rest = marked.filter("again").select("id", "row", "sha")
    # The first half of the hash is a join key of its own, so that both sides are shuffled for
    # the join and adaptive execution can split a partition that one large group fills.
    half = F.substring("sha", 1, 16)
    groups = rest.groupBy("sha").agg(
        F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size")
    )
    joined = rest.withColumn("half", half).join(groups.withColumn("half", half), ["sha", "half"])
    settled = joined.select(
        "id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "sha",
    )
    return alone.unionByName(settled).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; only possibly repeated rows are shuffled."""
    sha, half, flag = fresh(docs, "sha", "half", "again")
    hashed = docs.withColumn(sha, text_hash(F.col(text_col)))
    keys = written(hashed.select(F.col(id_col).alias("id"), F.col(sha).alias("sha")), "text-hashes")
    bits = _filter_bits(keys.count())
    words = repeated_cells(keys, "sha", bits)
    best = (
        with_bit(keys, _cell("sha", bits), words, "again").filter("again").groupBy("sha").agg(F.max("id").alias("id"))
        .withColumn("half", F.substring("sha", 1, 16))
    )
    marked = with_bit(hashed, _cell(sha, bits), words, flag)
    alone = marked.filter(~F.col(flag)).select(*docs.columns)
    rest = marked.filter(flag).withColumn(half, F.substring(sha, 1, 16)).alias("r")
    b = best.alias("b")
    winners = rest.join(
        b,
        (F.col(f"r.{sha}") == F.col("b.sha")) & (F.col(f"r.{half}") == F.col("b.half"))
        & F.col(f"r.{id_col}").eqNullSafe(F.col("b.id")),
        "left_semi",
    )
    return alone.unionByName(winners.dropDuplicates([sha]).select(*docs.columns))


@query(
    "op4_exact_dedup",
    """
    with t as (
      select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz')) as text_sha256
      from documents)
    select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
           count(*) over (partition by text_sha256) as group_size,
           doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
    from t
    """,
)
def _op4(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))
