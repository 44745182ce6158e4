"""Hashes of the words of many texts at once, with numpy on the UTF-8 bytes.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. All of these are single bytes in UTF-8, so words of bytes are words of
characters. Work goes through slices of about a quarter of a megabyte of text, so that memory does
not depend on the size of a batch; one long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from emberlog.llm.support import process_cache

SLICE = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Words(NamedTuple):
    """Words of rows ``first`` to ``first`` + ``rows`` - 1 of a column: hashes, and for each row
    the place of its first word (``rows`` + 1 places)."""

    first: int
    rows: int
    hashes: np.ndarray
    bounds: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64. Those for a usual slice are kept,
    those for a long text are not."""
    cache = process_cache()
    usual = SLICE + 1
    if n <= usual and "powers" in cache:
        return cache["powers"]
    up = np.full(max(n, usual), _ODD, np.uint64)
    down = np.full(max(n, usual), pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    found = np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)
    if n <= usual:
        cache["powers"] = found
    return found


def _tables(letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte a random value, and whether it is part of a word."""
    codes = np.arange(256, dtype=np.uint64)
    lower = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
    values = mix((lower + np.uint64(1)) * np.uint64(_ODD))
    if letters_only:
        inside = ((lower >= 97) & (lower <= 122)) | ((codes >= 48) & (codes <= 57)) | (codes >= 128)
    else:
        inside = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    return values, inside


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, NULL as empty, and where each row starts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), bounds
    return np.frombuffer(data, np.uint8), bounds


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE`` bytes."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_hashes(column: pa.Array, letters_only: bool = False) -> Iterator[Words]:
    """Hashes of all words of a column. ``letters_only``: words are runs of ASCII letters, digits
    and of what is not ASCII, so that punctuation separates them."""
    data, bounds = utf8(column)
    values, inside = _tables(letters_only)
    for a, b in slices(bounds):
        text = data[bounds[a] : bounds[b]]
        starts_of_rows = bounds[a : b + 1] - bounds[a]
        if len(text) == 0:
            yield Words(a, b - a, np.empty(0, np.uint64), np.zeros(b - a + 1, np.int64))
            continue
        word = inside[text]
        first = word.copy()
        first[1:] &= ~word[:-1]
        row_starts = starts_of_rows[:-1][starts_of_rows[:-1] < len(text)]
        first[row_starts] = word[row_starts]
        last = word.copy()
        last[:-1] &= ~word[1:]
        row_ends = starts_of_rows[1:][starts_of_rows[1:] > 0] - 1
        last[row_ends] = word[row_ends]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        up, down = _powers(len(text) + 1)
        sums = np.empty(len(text) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[text] * up[: len(text)], out=sums[1:])
        hashes = mix((sums[ends + 1] - sums[starts]) * down[starts])
        yield Words(a, b - a, hashes, np.searchsorted(starts, starts_of_rows))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and where each row's runs start. A row
    with fewer words, but not without any, has one run of all its words."""
    h, bounds = words.hashes, words.bounds
    counts = np.diff(bounds)
    short = (counts > 0) & (counts < size)
    runs = np.where(short, 1, np.maximum(counts - size + 1, 0))
    starts = np.concatenate(([0], np.cumsum(runs)))
    # The place of each run's first word.
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], runs) + np.repeat(bounds[:-1], runs)
    out = np.zeros(len(at), np.uint64)
    length = np.repeat(np.minimum(counts, size), runs)
    for i in range(size):
        part = h[np.minimum(at + i, max(len(h) - 1, 0))] if len(h) else np.empty(0, np.uint64)
        step = out * np.uint64(_ODD) + part
        out = np.where(i < length, mix(step), out)
    return out, starts
