"""Many searches answered by one read of the events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.msgquery import InvalidQuery
from emberlog.functions.text import trim_message
from emberlog.functions.times import Window as TimeWindow
from emberlog.operators.events import redact_events
from emberlog.operators.shaping import payload_size, row_payload
from emberlog.operators.topn import at_or_after, is_truncated, newest_order, newest_since_each, source_key
from emberlog.plans.request import SearchRequest, Settings
from emberlog.plans.search import char_cap



def _trimmed(cap: int, match: str | None) -> Column:
    return trim_message(F.col("message"), cap, match)


@dataclass(frozen=True)
class BatchResult:
    """Answers of all searches: ``rows`` and one ``summary`` line per search."""

    hits: DataFrame
    searches: list[tuple[str, SearchRequest, str | None]]
    settings: Settings
    force: bool
    spark: SparkSession

    def _value(self, per_search, sql_type: str) -> Column:
        """A constant chosen by the search a row belongs to."""
        values = [F.lit(per_search(r) if e is None else None) for _, r, e in self.searches]
        return F.get(F.array(*values), F.col("search_no")).cast(sql_type)

    def _column(self, per_search, otherwise: Column) -> Column:
        """A column chosen by the search; searches with the same recipe share it.

        ``per_search`` gives a hashable recipe and a function of it, or None.
        """
        numbers: dict = {}
        for no, (_, request, error) in enumerate(self.searches):
            recipe = None if error else per_search(request)
            if recipe is not None:
                numbers.setdefault(recipe, []).append(no)
        result = otherwise
        for (make, *args), nos in numbers.items():
            result = F.when(F.col("search_no").isin(nos), make(*args)).otherwise(result)
        return result

    def _limit(self) -> Column:
        return F.coalesce(self._value(lambda r: r.rows(self.settings), "int"), F.lit(0))

    def _cap_of(self) -> Column:
        default = self.settings.max_output_chars
        return self._value(lambda r: char_cap(r.max_output_chars, default), "bigint")

    def _shaped(self) -> DataFrame:
        def trim(r: SearchRequest):
            cap = char_cap(r.max_message_chars, self.settings.max_message_chars)
            return (_trimmed, cap, r.contains) if cap else None

        def payload(r: SearchRequest):
            fields = tuple(r.fields) if r.fields else None
            return row_payload, r.format or "json", fields, bool(r.flatten), r.template

        redacted = redact_events(self.hits, self.settings.redaction)
        whole = redacted.withColumns({
            "_full": F.col("message"), "message": self._column(trim, F.col("message")),
        })
        shaped = self._column(payload, F.lit(None).cast("string"))
        return whole.withColumn("payload", shaped)

    def _size(self) -> Column:
        texts = [
            no for no, (_, r, e) in enumerate(self.searches) if e is None and r.format == "text"
        ]
        payload = F.col("payload")
        size = payload_size(payload, "json")
        if texts:
            in_text = F.col("search_no").isin(texts)
            size = F.when(in_text, payload_size(payload, "text")).otherwise(size)
        return size

    def rows(self) -> DataFrame:
        """``(search_id, rank, payload)`` with the event columns, best rank first per search.

        Searches whose answer is too large are left out unless the batch is forced; the
        summary names them.
        """
        kept = F.col("rank") <= self._limit()
        shaped = self._shaped()
        if self.force:
            return shaped.filter(kept).drop("_full", "search_no")
        # Answers are small (the limits add up), so a window per search is cheap.
        size = F.sum(F.when(kept, self._size())).over(Window.partitionBy("search_no"))
        fits = F.coalesce(size <= self._cap_of(), F.lit(True))
        return shaped.withColumn("_fits", kept & fits).filter("_fits").drop("_full", "_fits", "search_no")

    def summary(self) -> DataFrame:
        """Per search: rows found, whether cut, size, whether blocked, message sizes, error."""
        within = F.col("rank") <= self._limit()
        sized = self._shaped().select(
            "search_no",
            F.when(within, self._size()).alias("size"),
            F.when(within, F.length("_full")).alias("chars"),
            source_key().alias("source"),
        )
        counted = sized.groupBy("search_no").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("source").alias("sources"),
            F.sum("size").alias("size"),
            F.avg("chars").alias("avg"),
            F.max("chars").alias("max"),
        )
        asked = self.spark.createDataFrame(
            [
                (no, sid, r.rows(self.settings) if e is None else 0, e, r.query if e else None)
                for no, (sid, r, e) in enumerate(self.searches)
            ],
            "no int, search_id string, asked int, error string, query string",
        )
        # Both sides have one row per search.
        joined = asked.join(counted, F.col("no") == F.col("search_no"), "left")
        n = F.coalesce("n", F.lit(0))
        ok = F.col("error").isNull()
        cut = F.coalesce(is_truncated(n, F.coalesce("sources", F.lit(0)), F.col("asked")), F.lit(False))
        size = F.coalesce("size", F.lit(0)).cast("bigint")
        joined = joined.withColumn("search_no", F.col("no"))
        too_large = F.coalesce(size > self._cap_of(), F.lit(False)) & F.lit(not self.force)
        return joined.select(
            "search_id",
            F.when(ok, F.least(n, F.col("asked"))).cast("bigint").alias("returned"),
            F.when(ok, cut).alias("truncated"),
            F.when(ok, size).alias("output_chars"),
            F.when(ok, too_large).alias("blocked"),
            F.when(ok, F.coalesce(F.floor(F.col("avg") + 0.5), F.lit(0))).cast("bigint").alias("avg_message_chars"),
            F.when(ok, F.coalesce("max", F.lit(0))).cast("bigint").alias("max_message_chars"),
            "error",
            "query",
        )


def _repeated(events: DataFrame, tests: Sequence[tuple[int, Column]]) -> DataFrame:
    """Each event once for each search that finds it, with its number in ``search_no``."""
    any_hit = tests[0][1]
    for _, test in tests[1:]:
        any_hit = any_hit | test
    which = F.array_compact(F.array(*[F.when(test, F.lit(no)) for no, test in tests]))
    return events.filter(any_hit).select("*", F.explode(which).alias("search_no"))


def search_batch(
    events: DataFrame,
    searches: Sequence[tuple[str, SearchRequest]],
    window: TimeWindow,
    common: SearchRequest | None = None,
    settings: Settings | None = None,
    force: bool = False,
    count_first: bool = False,
) -> BatchResult:
    """Run ``(id, request)`` searches over one read of ``events``.

    Each search keeps its own filters, limit and format; ``common`` fills its gaps. A search
    with an invalid query becomes an error in the summary and does not disturb the others.

    An event is repeated once per search that finds it. Ranking happens in two steps: within
    parts of a search, where each task already drops what cannot be in the answer before the
    shuffle, then over the few rows the parts leave. A search that finds a third of all events
    is therefore spread over many tasks.

    With ``count_first`` the events of each search are counted by hour at once, and only those from
    the hour on in which its answer begins are read whole, repeated and ranked.
    """
    settings = settings or Settings()
    day = "date" if "date" in events.columns else None
    asked: list[tuple[str, SearchRequest, str | None]] = []
    tests: list[tuple[int, Column]] = []
    for no, (search_id, own) in enumerate(searches):
        request = own.over(common) if common else own
        try:
            tests.append((no, request.predicate(window, day)))
            asked.append((search_id, request, None))
        except InvalidQuery as error:
            asked.append((search_id, request, str(error)))
    if tests and count_first:
        limits = {no: asked[no][1].rows(settings) + 1 for no, _ in tests}
        since = newest_since_each(_repeated(events, tests), "search_no", limits)
        tests = [(no, test & at_or_after(since[no], day) if no in since else test) for no, test in tests]
    if tests:
        keep = max(asked[no][1].rows(settings) for no, _ in tests) + 1
        found = _repeated(events, tests)
    else:
        keep = 1
        found = events.filter(F.lit(False)).withColumn("search_no", F.lit(0))
    if day:
        found = found.drop(day)
    # By input task: each task then passes on at most ``keep`` rows of a search.
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.spark_partition_id(), F.lit(parts))
    parted = Window.partitionBy("search_no", "_part").orderBy(*newest_order())
    final = Window.partitionBy("search_no").orderBy(*newest_order())
    first = (
        found.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(parted))
        .filter(F.col("_rank") <= keep)
        .drop("_rank", "_part")
    )
    number = F.col("search_no")
    ids = F.array(*[F.lit(search_id) for search_id, _, _ in asked])
    most = F.array(*[F.lit(0 if e else r.rows(settings) + 1) for _, r, e in asked])
    hits = first.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= keep)
    if asked:
        hits = hits.filter(F.col("rank") <= F.get(most, number))
        hits = hits.withColumn("search_id", F.get(ids, number))
    else:
        hits = hits.withColumn("search_id", F.lit(None).cast("string"))
    return BatchResult(hits, asked, settings, force, events.sparkSession)
