"""Whole lines from the chunks of running processes, as they arrive."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.functions.times import trimmed
from emberlog.sources.chunks import break_apart, inner_lines, without_cr

# Executors get the code of the state step with each task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a stream of output has said last: where its open line began, its text so far, and the
# last chunk seen.
_STATE = "open_seq long, line_no int, text string, last_seq long"


def stream_lines(
    chunks: DataFrame,
    stream: Sequence[str] = ("stream_id", "kind"),
    seq: str = "seq",
    chunk: str = "chunk",
    idle_ms: int | None = None,
) -> DataFrame:
    """The lines :func:`emberlog.sources.chunks.lines_from_chunks` gives, on a stream of chunks.

    Lines inside a chunk come straight from its row and keep no state. Only the ragged ends of
    chunks go to their stream's state, which holds the unfinished last line over micro-batches
    and restarts. A line comes out when its break arrives or, if ``idle_ms`` is given, after that
    time without a chunk; what is still open when the query ends is told by
    :func:`unfinished_lines`. Waiting for idle streams is for queries that run on: one that is to
    end when all is read would never end.

    Chunks may come in any order within a micro-batch. A chunk that comes after a later one of
    its stream was taken makes lines of its own.
    """
    key = list(stream)
    rows = break_apart(chunks, key, seq, chunk)
    count = F.size("_pieces")
    ends = rows.select(
        *key, "_seq", count.alias("_n"), F.get("_pieces", 0).alias("_head"),
        F.when(count > 1, F.element_at("_pieces", -1)).alias("_tail"),
    )
    fields = [rows.schema[k] for k in key]
    out = T.StructType([
        *fields, T.StructField("open_seq", T.LongType()), T.StructField("line_no", T.IntegerType()),
        T.StructField("line", T.StringType()),
    ])
    joined = ends.groupBy(*key).applyInPandasWithState(
        _joiner(key, idle_ms), out, _STATE, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    return inner_lines(rows, key).unionByName(joined).filter(trimmed(F.col("line")) != "")


def _joiner(key: list[str], idle_ms: int | None):
    names = [*key, "open_seq", "line_no", "line"]

    def lines(of: tuple, rows: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(names, zip(*[(*of, *r) for r in rows]))) if rows else {n: [] for n in names}
        frame = pd.DataFrame({n: pd.Series(list(v), dtype=object) for n, v in columns.items()})
        return frame.astype({"open_seq": "Int64", "line_no": "int32"})

    def join(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_seq, line_no, text, last = state.get if state.exists else (None, 0, "", None)
        if state.hasTimedOut:
            state.remove()
            yield lines(of, [(open_seq, line_no, text)])
            return
        parts, found = [text], []
        chunks = [c for f in frames for c in zip(f["_seq"], f["_n"], f["_head"], f["_tail"])]
        for seq, n, head, tail in sorted(chunks, key=lambda c: c[0]):
            seq, n = int(seq), int(n)
            if last is not None and seq < last:
                found += [(seq, 0, without_cr_text(head) if n > 1 else head), *([(seq, n - 1, tail)] if n > 1 else [])]
                continue
            last = seq
            parts.append(head)
            if n > 1:
                found.append((open_seq, line_no, without_cr_text("".join(parts))))
                open_seq, line_no, parts = seq, n - 1, [tail]
        state.update((open_seq, line_no, "".join(parts), last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield lines(of, found)

    return join


def without_cr_text(text: str) -> str:
    return text[:-1] if text.endswith("\r") else text


def unfinished_lines(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The open last lines that a query of :func:`stream_lines` holds, read from its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    held = F.col("value.groupState")
    return state.select("key.*", held["open_seq"].alias("open_seq"), held["line_no"].alias("line_no"),
                        held["text"].alias("line")).filter(trimmed(F.col("line")) != "")
