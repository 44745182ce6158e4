"""Sketches of the text in each file of a Parquet store, for substring searches.

A substring search has no bound that a Parquet reader could use. Beside the store, two tables tell
which runs of three characters the files hold: ``words``, the 64-bit words of a hashed bit array for
each file and field, sorted by word so that a search reads few of them, and ``files``, the files
that are sketched as a whole. A file that lacks a run of the searched text cannot match and is not
opened. Runs are those of the lower-cased text, which is what searches compare.

``files`` is written after ``words``, so sketching that was cut off leaves files that count as not
sketched. Those are always read, as are files that came later; a file that is gone does no harm.
The answer is the same with and without sketches. Texts below three characters leave out nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.msgquery import required_terms
from emberlog.plans.request import SearchRequest
from emberlog.sources.store import read_store

#: Bits for each field of a file. Logs of one service have some ten thousand different runs.
BITS = 1 << 18
#: What ``contains`` looks at; ``query`` looks at the message alone.
FIELDS = ("message", "type", "session_id", "data")


class Need(NamedTuple):
    """A text that one of the fields of an event must hold."""

    text: str
    fields: tuple[str, ...]


def needs_of(request: SearchRequest) -> list[Need]:
    """What every event that a request finds must hold."""
    found = [Need(t, ("message",)) for t in required_terms(request.query)] if request.query else []
    return found + ([Need(request.contains, FIELDS)] if request.contains else [])


def _characters(text: Column) -> Column:
    return F.split(F.lower(text), "")


def _cells(chars: Column) -> Column:
    """Positions, in a bit array, of the runs of three among an array of characters."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(chars) - 3),
        lambda i: F.pmod(F.xxhash64(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)), F.lit(BITS)),
    )
    return F.when(F.size(chars) >= 3, F.array_distinct(runs))


def _bits(cells: Column, field: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(
        field.alias("field"), F.shiftright(c, 6).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(F.lit(63)).cast("int")).alias("bits"),
    ))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def sketched_files(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/files", "file string").distinct()


def write_sketches(spark: SparkSession, root: str, path: str) -> None:
    """Sketch the files of the store ``root`` that have no sketch in ``path`` yet.

    One row for each word of a file and field is shuffled, however many events the file has. The
    list of files passes through the driver, which lists the store for every read anyway.
    """
    done = [r["file"] for r in sketched_files(spark, path).collect()]
    events = read_store(spark, root)
    if "_metadata" not in _hidden(events):
        return
    new = events.withColumn("file", F.col("_metadata.file_path"))
    if done:
        new = new.filter(~F.col("_metadata.file_path").isin(done))
    split = new.select("file", *(_characters(F.col(f)).alias(f) for f in FIELDS))
    listed = split.select("file", F.explode(F.flatten(F.array_compact(F.array(
        *(_bits(_cells(F.col(f)), F.lit(f)) for f in FIELDS)
    )))).alias("b"))
    words = listed.groupBy("file", "b.field", "b.word").agg(F.bit_or("b.bits").alias("bits"))
    ordered = words.repartitionByRange("field", "word").sortWithinPartitions("field", "word", "file")
    ordered.write.mode("append").parquet(f"{path}/words")
    new.select("file").distinct().coalesce(1).write.mode("append").parquet(f"{path}/files")


def _hidden(df: DataFrame) -> tuple[str, ...]:
    """``("_metadata",)`` for a frame that is read from files."""
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return ()
    return ("_metadata",)


def files_without(spark: SparkSession, path: str, needs: Sequence[Need]) -> list[str]:
    """Sketched files that cannot hold an event with all the texts needed."""
    files = sketched_files(spark, path)
    able = files
    for need in needs:
        chars = _characters(F.lit(need.text))
        one = spark.range(1).select(F.explode(_bits(_cells(chars), F.lit(""))).alias("b"))
        masks = one.groupBy("b.word").agg(F.bit_or("b.bits").alias("mask")).collect()
        if not masks:
            continue
        wanted = spark.createDataFrame([(r["word"], r["mask"]) for r in masks], "word int, mask long")
        words = _read(spark, f"{path}/words", "file string, field string, word int, bits long")
        held = (
            words.filter(F.col("field").isin(*need.fields) & F.col("word").isin([r["word"] for r in masks]))
            .groupBy("file", "field", "word").agg(F.bit_or("bits").alias("bits"))
            .join(wanted, "word")
            .filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
            .groupBy("file", "field").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(masks))
        )
        able = able.join(held, "file", "left_semi")
    return [r["file"] for r in files.join(able, "file", "left_anti").collect()]


def read_store_for(
    spark: SparkSession, root: str, path: str, request: SearchRequest, service: str | None = None
) -> DataFrame:
    """The store without the files that cannot hold what ``request`` looks for.

    Asks the sketches at once. Filter the events as usual: files that may match are read whole.
    """
    events = read_store(spark, root, service)
    needs = needs_of(request)
    absent = files_without(spark, path, needs) if needs else []
    return events.filter(~F.col("_metadata.file_path").isin(absent)) if absent and _hidden(events) else events
