"""What a search asks for, and the settings it runs under."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column

from emberlog.functions.redaction import RedactionPolicy
from emberlog.functions.times import Window, bound_ms, resolve_since
from emberlog.operators.filters import all_of, event_filter, from_backends
from emberlog.operators.topn import check_limit

# Short parameter names, and the layout they imply for text answers.
SHORT_NAMES = {
    "s": "service", "sid": "session_id", "rid": "run_id", "ty": "types", "lv": "levels",
    "cn": "contains", "q": "query", "since": "since", "until": "until", "lim": "limit",
    "fmt": "format", "flds": "fields", "tpl": "template", "b": "backends",
}
SHORT_TEMPLATE = "{ts}|{service}|{message}"


@dataclass(frozen=True)
class Settings:
    """Defaults of a deployment."""

    max_results: int = 200
    tail_rows: int = 50
    max_output_chars: float | None = 20_000
    max_message_chars: float | None = 0
    redaction: RedactionPolicy = field(default_factory=RedactionPolicy)


@dataclass(frozen=True)
class SearchRequest:
    """One search. ``since`` and ``until`` take dates or ages such as ``15m``."""

    service: str | None = None
    session_id: str | None = None
    run_id: str | None = None
    types: tuple[str, ...] | None = None
    levels: tuple[str, ...] | None = None
    contains: str | None = None
    query: str | None = None
    since: str | None = None
    until: str | None = None
    limit: int | None = None
    max_output_chars: float | None = None
    max_message_chars: float | None = None
    format: str | None = None
    fields: tuple[str, ...] | None = None
    flatten: bool | None = None
    template: str | None = None
    backends: tuple[str, ...] | None = None
    force: bool | None = None

    @classmethod
    def short(cls, **short) -> SearchRequest:
        """A request in short parameter names; it answers in text lines unless told otherwise."""
        request = cls(**{SHORT_NAMES[k]: v for k, v in short.items()})
        fmt = request.format or "text"
        template = request.template or (SHORT_TEMPLATE if fmt == "text" else None)
        return replace(request, format=fmt, template=template)

    def over(self, common: SearchRequest) -> SearchRequest:
        """This request with gaps filled from a common one."""
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        given = {k: v for k, v in own.items() if v is not None}
        return replace(common, **given)

    def rows(self, settings: Settings) -> int:
        return check_limit(settings.max_results if self.limit is None else self.limit)

    def predicate(self, window: Window, day_column: str | None = None) -> Column:
        """Everything that decides whether an event is found."""
        found = event_filter(
            service=self.service,
            session_id=self.session_id,
            run_id=self.run_id,
            types=self.types,
            levels=self.levels,
            contains=self.contains,
            query=self.query,
            since=resolve_since(self.since, window),
            until=bound_ms(self.until, window.now_ms),
            day_column=day_column,
        )
        return all_of([found, from_backends(self.backends) if self.backends else None])
