"""Scratch tables, bounded bit arrays and small helpers shared by the operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts, and their bytes, that go to Python at a time; Spark's own bounds, of 10,000
#: rows, are for short rows.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch sizes to ``BATCH_ROWS`` and ``BATCH_BYTES`` unless they are
    lower already, written as plain numbers.

    A batch is held several times over, by Spark and by its Python worker, and a row may be a
    long text, so this bounds the memory of operators that read texts in Python.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below the shared checkpoint folder.

    Cuts the lineage: a lost executor costs a read of shared files, and what follows sees the
    same rows each time.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; NULL as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, for what is costly to load."""
    return sys.modules.setdefault("_emberlog_cache", types.ModuleType("_emberlog_cache")).__dict__


def bit_words(cells: DataFrame) -> DataFrame:
    """(word, bits): a bit array with the bits at the positions of the one column of ``cells`` set,
    as those of its 64-bit words that are not zero. Written, so that its size is known."""
    (cell,) = cells.columns
    return written(
        cells.select(F.shiftright(cell, 6).alias("word"), F.expr(f"shiftleft(1L, cast({cell} & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")),
        "bits",
    )


def with_bit(df: DataFrame, cell: Column, words: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean column: whether the bit at a position is set.

    The words are broadcast: a bit array of n bits has n / 64 words at most, whatever the number
    of rows, and callers bound n.
    """
    word, bits, at = fresh(df, "bit_word", "bit_bits", "bit_cell")
    table_ = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    placed = df.withColumn(at, cell)
    joined = placed.join(F.broadcast(table_), F.shiftright(at, 6) == F.col(word), "left")
    is_set = F.expr(f"coalesce((shiftright({bits}, cast({at} & 63 as int)) & 1L) = 1L, false)")
    return joined.select(*df.columns, is_set.alias(flag))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have in any spelling of case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def beside(columns: Sequence[str], own: Sequence[str]) -> dict[str, str]:
    """Names for ``columns`` next to an operator's ``own``: the same name, with underscores in front
    where it would be taken, in any spelling of case."""
    taken = {c.lower() for c in own} | {c.lower() for c in columns}
    out = {}
    for c in columns:
        name = c
        if c.lower() in {o.lower() for o in own}:
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
        out[c] = name
    return out
