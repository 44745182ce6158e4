"""Continuous ingest: raw lines in, completed and redacted events in the store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.redaction import RedactionPolicy
from emberlog.operators.events import complete_events, redact_events
from emberlog.sources.store import BLOOM, parse_lines, with_day


@dataclass(frozen=True)
class IngestDefaults:
    """What events lacking it are given."""

    service: str
    run_id: str
    now_ms: int
    session_id: str | None = None


def read_line_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Lines of JSONL files as they arrive below ``root``."""
    return (
        spark.readStream.format("text")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jsonl")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )


def prepare(
    lines: DataFrame, defaults: IngestDefaults, policy: RedactionPolicy | None = None
) -> DataFrame:
    """The emit path: parse, complete, redact. The same columns serve batches and streams."""
    events = complete_events(
        parse_lines(lines),
        defaults.service,
        defaults.now_ms,
        defaults.run_id,
        defaults.session_id,
    )
    return redact_events(events, policy)


def stream_ingest(
    lines: DataFrame,
    root: str,
    checkpoint: str,
    defaults: IngestDefaults,
    policy: RedactionPolicy | None = None,
    trigger: dict | None = None,
    spread: int | None = None,
) -> StreamingQuery:
    """Start the ingest of a streaming frame of lines into the Parquet store at ``root``.

    The file sink's log and the checkpoint make each event appear once, also after a failure.
    Nothing is kept between batches. Adaptive splitting does not apply to streams, so rows of
    one service and day are dealt out by input split, to ``spread`` tasks, which is also the
    most files it gets in a batch; by default as many as the session has shuffle partitions.
    """
    width = spread or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = with_day(prepare(lines, defaults, policy))
    deal = F.pmod(F.spark_partition_id(), F.lit(width))
    dealt = events.withColumn("_deal", deal).repartition("service", "date", "_deal").drop("_deal")
    return (
        dealt.writeStream.format("parquet")
        .options(**BLOOM)
        .partitionBy("service", "date")
        .option("path", root)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
