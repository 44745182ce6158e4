"""Search and tail from request to answer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import trim_message
from emberlog.functions.times import Window
from emberlog.operators.events import redact_events
from emberlog.operators.shaping import guard_report, output_cap, payload_size, row_payload
from emberlog.operators.topn import is_truncated, newest, newest_part, newest_ranked, source_key
from emberlog.plans.request import SearchRequest, Settings
from emberlog.sources.multi import SourceError, Sources, error_rows


def char_cap(own: float | None, default: float | None) -> int | None:
    """The cap a request gets: its own, else the deployment's; None for no cap."""
    return output_cap(default if own is None else own)


@dataclass(frozen=True)
class SearchResult:
    """A lazy answer. Nothing runs before an action on one of its frames."""

    top: DataFrame
    request: SearchRequest
    settings: Settings
    errors: tuple[SourceError, ...] = ()
    # A tail asks for less than it searches: its answer is cut if there was more than it shows.
    fills: int | None = None

    @property
    def limit(self) -> int:
        return self.request.rows(self.settings)

    def _cut(self, n: Column, sources: Column) -> Column:
        if self.fills is not None and self.limit < self.fills:
            return n > self.limit
        return F.coalesce(is_truncated(n, sources, self.limit), F.lit(False))

    def _redacted(self) -> DataFrame:
        # Only rows of the answer are redacted; filters have seen the stored text.
        rows = self.top.filter(F.col("rank") <= self.limit)
        return redact_events(rows, self.settings.redaction)

    def _trimmed(self, redacted: DataFrame) -> DataFrame:
        cap = char_cap(self.request.max_message_chars, self.settings.max_message_chars)
        match = self.request.contains
        return redacted.withColumn("message", trim_message(F.col("message"), cap, match))

    def events(self) -> DataFrame:
        """Found events, newest first, redacted and trimmed, numbered in ``rank``."""
        return self._trimmed(self._redacted())

    def error_rows(self, spark: SparkSession) -> DataFrame:
        """Sources that did not answer: ``(backend, backend_id, message)``."""
        return error_rows(spark, self.errors)

    def payload_column(self) -> Column:
        r = self.request
        return row_payload(r.format or "json", r.fields, bool(r.flatten), r.template)

    def payload(self) -> DataFrame:
        """``(rank, payload)``: one answer text per event."""
        return self.events().select("rank", self.payload_column().alias("payload"))

    def truncated(self) -> DataFrame:
        """One row: rows returned and whether the answer was cut. Reads ``limit + 1`` rows."""
        n, sources = F.count(F.lit(1)), F.count_distinct(source_key())
        return self.top.agg(
            F.least(n, F.lit(self.limit)).cast("bigint").alias("returned"),
            self._cut(n, sources).alias("truncated"),
        )

    def report(self) -> DataFrame:
        """One row of the size guard: see :func:`emberlog.operators.shaping.guard_report`."""
        fmt = self.request.format or "json"
        full = F.col("_full")
        redacted = self._redacted_all().withColumn("_full", F.col("message"))
        shaped = self._trimmed(redacted)
        kept = F.col("rank") <= self.limit
        sized = shaped.select(
            F.when(kept, payload_size(self.payload_column(), fmt)).alias("size"),
            F.when(kept, full).alias("message"),
            F.when(kept, F.lit(1)).alias("kept"),
            source_key().alias("source"),
        )
        n, sources = F.count(F.lit(1)), F.count_distinct("source")
        cut = self._cut(n, sources)
        cap = self.request.max_output_chars
        report = guard_report(
            sized,
            self.settings.max_output_chars if cap is None else cap,
            bool(self.request.force),
            fmt,
            cut,
        )
        return report.withColumn("item_count", F.least("item_count", F.lit(self.limit)).cast("bigint"))

    def _redacted_all(self) -> DataFrame:
        return redact_events(self.top, self.settings.redaction)

    def deliver(self) -> DataFrame:
        """The payload, or the guard's one-row warning when the answer is too large.

        Runs the search once: its rows, no more than the limit and one, are kept for both.
        """
        kept = replace(self, top=self.top.persist())
        report = kept.report()
        if report.first()["blocked"]:
            kept.top.unpersist()
            return report
        return kept.payload()


def search(
    events: DataFrame,
    request: SearchRequest,
    window: Window,
    settings: Settings | None = None,
    errors: Sequence[SourceError] = (),
    count_first: bool = False,
) -> SearchResult:
    """Newest matching events. Pass a frame with a ``date`` column to prune day partitions.

    With ``count_first``, for windows over much of a store, matching events are counted by hour
    at once, and whole events are read from the day and hour on in which the answer begins.
    """
    settings = settings or Settings()
    # One row beyond the limit tells whether the answer was cut without a second read.
    most = request.rows(settings) + 1
    top = newest_ranked(_found(events, request, window, most if count_first else None), most)
    return SearchResult(top, request, settings, tuple(errors))


def _found(events: DataFrame, request: SearchRequest, window: Window, newest_of: int | None = None) -> DataFrame:
    """Matching events, or with ``newest_of`` only the part of them that holds so many newest."""
    day = "date" if "date" in events.columns else None
    found = events.filter(request.predicate(window, day))
    if newest_of is not None:
        found = newest_part(found, newest_of, day)
    return found.drop(day) if day else found


def search_sources(
    spark: SparkSession,
    sources: Sources,
    request: SearchRequest,
    window: Window,
    settings: Settings | None = None,
) -> SearchResult:
    """Newest matching events of all sources that can be read to their end.

    Each source gives its own newest rows, no more than the limit and one, under an action of its
    own; one that fails on the way is among the errors of the answer. Runs those actions at once.
    """
    settings = settings or Settings()
    most = request.rows(settings) + 1
    parts, errors = sources.gather(spark, lambda events: newest(_found(events, request, window), most))
    return SearchResult(newest_ranked(parts, most), request, settings, tuple(errors))


def tail(
    events: DataFrame,
    request: SearchRequest,
    window: Window,
    settings: Settings | None = None,
    errors: Sequence[SourceError] = (),
    count_first: bool = False,
) -> SearchResult:
    """The most recent events, within the default window.

    Only service, session, run, query and backends narrow it down, and it never returns more
    than the deployment's maximum. ``count_first`` is that of :func:`search`.
    """
    settings = settings or Settings()
    # The rule that a full answer of one source counts as cut holds for the search below the
    # tail, which goes up to the deployment's maximum.
    found = search(events, _narrowed(request, settings), window, settings, errors, count_first)
    return replace(found, fills=settings.max_results)


def tail_sources(
    spark: SparkSession,
    sources: Sources,
    request: SearchRequest,
    window: Window,
    settings: Settings | None = None,
) -> SearchResult:
    """:func:`tail` over sources that may fail while they are read, as :func:`search_sources`."""
    settings = settings or Settings()
    found = search_sources(spark, sources, _narrowed(request, settings), window, settings)
    return replace(found, fills=settings.max_results)


def _narrowed(request: SearchRequest, settings: Settings) -> SearchRequest:
    """What a tail asks for."""
    default = min(settings.max_results, settings.tail_rows)
    wanted = replace(request, limit=default if request.limit is None else request.limit)
    rows = min(wanted.rows(settings), settings.max_results)
    return replace(wanted, types=None, levels=None, contains=None, since=None, until=None, limit=rows)
