"""Several sources answered as one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from emberlog.model import EVENT_SCHEMA
from emberlog.operators.events import as_events, tag_source
from emberlog.session import shared_dir

# The source types there are.
SOURCE_TYPES = ("local", "cloudwatch", "k8s")


@dataclass(frozen=True)
class EventSource:
    """A named source; ``load`` returns its events and may fail."""

    type: str
    load: Callable[[], DataFrame]
    id: str | None = None


@dataclass(frozen=True)
class SourceError:
    backend: str
    backend_id: str | None
    message: str


@dataclass(frozen=True)
class Sources:
    """Loaded sources with their tagged events, and what went wrong with the others."""

    frames: list[tuple[EventSource, DataFrame]]
    errors: list[SourceError]

    def events(self, spark: SparkSession) -> DataFrame:
        """All events. The union is read as one set of tasks; no source waits for another."""
        if not self.frames:
            return spark.createDataFrame([], EVENT_SCHEMA)
        result = self.frames[0][1]
        for _, frame in self.frames[1:]:
            result = result.unionByName(frame)
        return result

    def gather(
        self, spark: SparkSession, work: Callable[[DataFrame], DataFrame], at_once: int = 8
    ) -> tuple[DataFrame, list[SourceError]]:
        """``work`` done on each source by itself, its results together; and all errors.

        A source may turn out to be unreadable only while it is read, which would take a job over
        all sources down. So each has an action of its own, ``at_once`` of them at a time, that
        writes what ``work`` leaves of it to the shared folder. Ask for work that leaves little:
        the newest rows, or counts that are added up afterwards.
        """
        empty = work(spark.createDataFrame([], EVENT_SCHEMA))

        def one(item: tuple[EventSource, DataFrame]) -> DataFrame | SourceError:
            source, frame = item
            path = shared_dir(spark, "source")
            try:
                work(frame).write.parquet(path)
            except Exception as error:  # noqa: BLE001 - any failure is reported, not raised
                return SourceError(source.type, source.id, reason(error))
            return spark.read.schema(empty.schema).parquet(path)

        result, errors = empty, list(self.errors)
        if self.frames:
            with ThreadPoolExecutor(at_once) as pool:
                for found in pool.map(one, self.frames):
                    if isinstance(found, SourceError):
                        errors.append(found)
                    else:
                        result = result.unionByName(found)
        return result, errors

    def error_rows(self, spark: SparkSession) -> DataFrame:
        return error_rows(spark, self.errors)


def error_rows(spark: SparkSession, errors: Sequence[SourceError]) -> DataFrame:
    """``(backend, backend_id, message)`` of what went wrong."""
    return spark.createDataFrame(
        [(e.backend, e.backend_id, e.message) for e in errors], "backend string, backend_id string, message string"
    )


def reason(error: Exception) -> str:
    """The first line of what an error says, or its kind."""
    return (str(error).strip().splitlines() or [type(error).__name__])[0]


def open_sources(
    sources: Sequence[EventSource], backends: Sequence[str] | None = None
) -> Sources:
    """Load the sources whose type or id is in ``backends`` (all without it).

    A source that cannot be loaded becomes an error entry and the others still answer.
    """
    errors = [
        SourceError(s.type, s.id, f"Unknown backend type: {s.type}")
        for s in sources
        if s.type not in SOURCE_TYPES
    ]
    known = [s for s in sources if s.type in SOURCE_TYPES]
    wanted = set(backends or ())
    chosen = [s for s in known if not wanted or s.type in wanted or (s.id and s.id in wanted)]
    if wanted and not chosen:
        errors.append(
            SourceError("multi", None, "No backends matched filter: " + ", ".join(backends))
        )
    frames = []
    for source in chosen:
        try:
            # Looking at the columns makes Spark resolve the plan, so a bad source shows here.
            events = as_events(source.load())
        except Exception as error:  # noqa: BLE001 - any failure is reported, not raised
            errors.append(SourceError(source.type, source.id, reason(error)))
            continue
        remote = source.type != "local"
        frames.append((source, tag_source(events, source.type, source.id, remote=remote)))
    return Sources(frames, errors)
