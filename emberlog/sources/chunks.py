"""Whole lines from the chunks a process wrote to its output streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.times import trimmed
from emberlog.operators.events import source_struct

# Chunks per window block. Positions below the square of it need two levels of blocks.
BLOCK = 1 << 16


def lines_from_chunks(
    df: DataFrame,
    stream: Sequence[str] = ("stream_id", "kind"),
    seq: str = "seq",
    chunk: str = "chunk",
    block: int = BLOCK,
    levels: int = 2,
) -> DataFrame:
    """Lines of each stream: chunks in ``seq`` order joined, cut at ``\\n`` or ``\\r\\n``.

    Blank lines are dropped and an unfinished last line is kept. ``seq`` is a whole number,
    unique within its stream. A line is placed by ``open_seq``, the chunk it begins in (NULL for
    what precedes the first line break of a stream), and ``line_no`` within that chunk.

    A stream is never brought together in one task, so one that wrote a third of all data is
    no harder than many small ones. Lines inside a chunk come straight from its row. Only the
    ragged ends of chunks are shuffled, to the chunk their line begins in: that is the last
    earlier chunk with a line break, found within blocks of at most ``block`` positions and,
    across blocks, carried over by one row per block. Only the pieces of one line meet in a
    group, and they make up one output row anyway (a line must fit a row).
    """
    key = list(stream)
    rows = break_apart(df, key, seq, chunk)
    count = F.size("_pieces")
    whole = inner_lines(rows, key)

    ends = rows.select(
        *key,
        "_seq",
        F.when(count > 1, F.col("_seq")).alias("_break"),
        count.alias("_n"),
        F.get("_pieces", 0).alias("_head"),
        F.when(count > 1, F.element_at("_pieces", -1)).alias("_tail"),
    )
    placed = _carry(ends, key, "_seq", "_break", "_opener", block, levels)
    # The head of a chunk continues an earlier line; its tail begins one of its own.
    head = F.struct(
        F.col("_opener").alias("open_seq"),
        F.col("_head").alias("text"),
        F.col("_break").isNotNull().alias("closes"),
        F.lit(0).alias("line_no"),
    )
    tail = F.struct(
        F.col("_break").alias("open_seq"),
        F.col("_tail").alias("text"),
        F.lit(False).alias("closes"),
        (F.col("_n") - 1).alias("line_no"),
    )
    ragged = (
        placed.select(
            *key, "_seq", F.explode(F.when(F.col("_break").isNull(), F.array(head)).otherwise(F.array(head, tail))).alias("_p")
        )
        .filter(F.col("_p.closes") | (F.col("_p.text") != "") | (F.col("_p.line_no") > 0))
        .groupBy(*key, F.col("_p.open_seq").alias("open_seq"))
        .agg(
            F.array_sort(F.collect_list(F.struct("_seq", F.col("_p.text").alias("text")))).alias("_parts"),
            F.bool_or("_p.closes").alias("_closed"),
            F.max("_p.line_no").alias("line_no"),
        )
    )
    text = F.array_join(F.transform("_parts", lambda p: p["text"]), "")
    joined = ragged.select(
        *key, "open_seq", "line_no", F.when(F.col("_closed"), without_cr(text)).otherwise(text).alias("line")
    )
    return whole.unionByName(joined).filter(trimmed(F.col("line")) != "")


def break_apart(df: DataFrame, key: list[str], seq: str, chunk: str) -> DataFrame:
    """The pieces between the line breaks of each chunk."""
    pieces = F.split(F.coalesce(F.col(chunk), F.lit("")), "\n", -1)
    return df.select(*key, F.col(seq).cast("bigint").alias("_seq"), pieces.alias("_pieces"))


def inner_lines(rows: DataFrame, key: list[str]) -> DataFrame:
    """Lines that begin and end inside a chunk."""
    count = F.size("_pieces")
    inside = F.transform(
        F.slice("_pieces", 2, F.greatest(count - 2, F.lit(0))), lambda p, i: F.struct((i + 1).alias("no"), p.alias("text"))
    )
    return (
        rows.filter(count > 2)
        .select(*key, F.col("_seq").alias("open_seq"), F.explode(inside).alias("_p"))
        .select(*key, "open_seq", F.col("_p.no").alias("line_no"), without_cr(F.col("_p.text")).alias("line"))
    )


def chunk_events(df: DataFrame, **options) -> DataFrame:
    """Captured lines with the event fields they get; the stream kind decides the level."""
    kind = F.col("kind")
    return lines_from_chunks(df, **options).select(
        "*",
        kind.alias("type"),
        F.when(kind == "stderr", "error").otherwise("info").alias("level"),
        F.col("line").alias("message"),
        source_struct(kind=kind).alias("source"),
    )


def without_cr(text: Column) -> Column:
    return F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)


def _carry(
    df: DataFrame, key: list[str], pos: str, value: str, out: str, block: int, levels: int
) -> DataFrame:
    """Add ``out``: the greatest ``value`` at an earlier ``pos`` of the same key.

    Positions are cut into blocks. What the blocks before a block amount to comes from the
    same computation over one row per block, and enters the block as a leading row, so the
    wide rows are shuffled once and joined to nothing.
    """
    before = Window.orderBy(F.col(pos).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        return df.withColumn(out, F.max(value).over(before.partitionBy(*key)))
    name = f"_block{levels}"
    blocked = df.withColumn(name, F.expr(f"{pos} div {block}"))
    summary = blocked.groupBy(*key, name).agg(F.max(value).alias(value))
    above = _carry(summary, key, name, value, "_above", block, levels - 1)
    leads = above.select(*key, name, F.col("_above").alias(value), F.lit(True).alias("_lead"))
    rows = blocked.withColumn("_lead", F.lit(False))
    placed = rows.unionByName(leads, allowMissingColumns=True).withColumn(
        out, F.max(value).over(before.partitionBy(*key, name))
    )
    return placed.filter(~F.col("_lead")).drop("_lead", name)
