"""A Bloom filter that tells which rows may share their hash with others, in two passes.

Each text sets ``HASHES`` bits of one 64-bit word of the filter. Pass 1 marks the bits that two or
more rows set. Pass 2 looks every row up: a row with a bit that no other row sets is the only one with
its text and passes straight through; the others alone are shuffled and settled by their whole SHA-256.

The filter has ``ROW_BITS`` to twice as many bits for each row, whatever their number, so about one row
without an equal in a hundred is shuffled in vain. It is cut by ranges of the hash into parts of
``PART_BITS`` at most, some 150 MB as a broadcast table of packed blocks. Where there are several, rows are
first written by part, without a shuffle, and the parts are looked up one after another. So what is
broadcast at a time has a bound, and rows pass straight through at any size.

NULL hashes count as equal to each other; an empty table gives an empty filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.support import fresh
from emberlog.session import shared_dir

HASHES = 3
ROW_BITS = 16
MIN_BITS = 1 << 20
PART_BITS = 1 << 30
_BLOCK = 1 << 12  # bits of a row of the broadcast table
_SEGMENT = 1 << 18  # bits that one row of pass 1 covers


def _hash(sha: str) -> Column:
    return F.xxhash64(sha)


def _word(hash_: Column, bits: int) -> Column:
    """The 64-bit word of the filter that a hash belongs to."""
    return F.pmod(F.shiftrightunsigned(hash_, 6 * HASHES), F.lit(bits // 64))


def _mask(hash_: Column) -> Column:
    """The bits of that word that a hash sets."""
    mask = F.lit(0).cast("long")
    for i in range(HASHES):
        at = F.shiftrightunsigned(hash_, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def _task_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's rows (word, mask), the bits set once and those set again, by segment."""
    met = []
    for batch in batches:
        word, mask = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        # The set bits of each mask, lowest first; a row counts once for a bit.
        left = mask.view(np.uint64).copy()
        while len(left):
            low = left & (~left + np.uint64(1))
            met.append(word * 64 + np.log2(low.astype(np.float64)).astype(np.int64))
            left ^= low
            word, left = word[left != 0], left[left != 0]
    cells, counts = np.unique(np.concatenate(met) if met else np.empty(0, np.int64), return_counts=True)
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
    """For each segment, rows sorted by it, the bits set by two rows or more, packed by block."""
    at, once, twice = None, None, None

    def done():
        # Big-endian words, as the look-up reads them as hexadecimal numbers.
        blocks = np.packbits(twice, bitorder="little").view("<u8").astype(">u8").reshape(-1, _BLOCK // 64)
        filled = np.flatnonzero(blocks.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(filled + at * (_SEGMENT // _BLOCK), pa.int64()), pa.array([blocks[i].tobytes() for i in filled], pa.binary())],
            ["block", "bits"],
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


def _filter_bits(rows: int) -> int:
    return max(1 << (ROW_BITS * max(rows, 1) - 1).bit_length(), MIN_BITS)


def _by_part(df: DataFrame, name: str, part: str) -> DataFrame:
    """``df`` as a table with a folder for each value of ``part``; what is read once is read from there."""
    path = shared_dir(df.sparkSession, name)
    df.write.partitionBy(part).parquet(path)
    columns = [c for c in df.columns if c != part]
    return df.sparkSession.read.schema(df.select(*columns, part).schema).parquet(path)


class RepeatFilter:
    """The Bloom filter of the rows of ``df``: which of them may share their ``sha`` with others."""

    def __init__(self, df: DataFrame, sha: str, rows: int) -> None:
        self.bits = _filter_bits(rows)
        self.parts = max(1, self.bits // PART_BITS)
        hash_ = _hash(sha)
        self.blocks = _by_part(
            df.select(_word(hash_, self.bits).alias("word"), _mask(hash_).alias("mask"))
            .mapInArrow(_task_cells, "seg long, cells binary, again binary")
            .repartition("seg")
            .sortWithinPartitions("seg")
            .mapInArrow(_merge_cells, "block long, bits binary")
            .withColumn("part", F.expr(f"cast(block div {self.bits // self.parts // _BLOCK} as int)")),
            "repeated", "part",
        )

    def _part(self, sha: str) -> Column:
        words = self.bits // self.parts // 64
        return F.shiftright(_word(_hash(sha), self.bits), words.bit_length() - 1).cast("int")

    def marked(self, df: DataFrame, sha: str, flag: str) -> DataFrame:
        """``df`` with a boolean column: whether a row may be repeated."""
        if self.parts == 1:
            return self._looked_up(df, sha, flag, self.blocks)
        (part,) = fresh(df, "part")
        placed = _by_part(df.withColumn(part, self._part(sha)), "by-part", part)
        path = shared_dir(df.sparkSession, "marked")
        for p in range(self.parts):
            rows = placed.filter(F.col(part) == p).select(*df.columns)
            self._looked_up(rows, sha, flag, self.blocks.filter(F.col("part") == p)).write.mode("append").parquet(path)
        schema = df.withColumn(flag, F.lit(True)).schema
        return df.sparkSession.read.schema(schema).parquet(path)

    def _looked_up(self, df: DataFrame, sha: str, flag: str, blocks: DataFrame) -> DataFrame:
        """One part: its packed blocks are broadcast, ``PART_BITS`` at most whatever the number of rows."""
        block, bits, word, mask = fresh(df, "its_block", "its_bits", "its_word", "its_mask")
        table_ = blocks.select(F.col("block").alias(block), F.col("bits").alias(bits))
        placed = df.withColumns({word: _word(_hash(sha), self.bits), mask: _mask(_hash(sha))})
        joined = placed.join(F.broadcast(table_), F.expr(f"`{word}` div {_BLOCK // 64}") == F.col(block), "left")
        found = F.expr(f"cast(conv(hex(substring(`{bits}`, cast(pmod(`{word}`, {_BLOCK // 64}) as int) * 8 + 1, 8)), 16, -10) as long)")
        again = F.coalesce(found.bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
        return joined.select(*df.columns, again.alias(flag))
