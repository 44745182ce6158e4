"""Event time: instants from text, time bounds, and the leading stamp of a log line."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.model import WHITESPACE

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

# Milliseconds per unit of a relative time such as ``15m``.
UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}

_RELATIVE = re.compile(r"([0-9]+)(ms|s|m|h|d)", re.IGNORECASE)

# Spark would read a bare clock time as today's, so a date must come first.
_DATED = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}([T ].*)?)?)?$"
_NO_SECONDS = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:?[0-9]{2})$"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def event_time_ms(text: Column) -> Column:
    """Epoch milliseconds of a date text, NULL when it cannot be read; never fails."""
    t = trimmed(text)
    # Spark wants seconds before a zone. Only texts as short as that are looked at.
    brief = F.length(t).between(17, 22) & t.rlike(_NO_SECONDS)
    full = F.when(brief, F.concat(F.left(t, F.lit(16)), F.lit(":00"), F.substr(t, F.lit(17)))).otherwise(t)
    return F.when(t.rlike(_DATED), F.unix_millis(F.try_to_timestamp(full)))


def iso_text(ms: Column) -> Column:
    """Epoch milliseconds as ``2024-01-31T00:00:00.000Z`` (the session zone must be UTC)."""
    return F.date_format(F.timestamp_millis(ms), ISO_PATTERN)


_SPELLED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.]([0-9]{3}|[0-9]{6}))?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def spelling(text: Column) -> Column:
    """How a plain date text is written: its separator, its digits of a second and its zone, such as
    ``T3+02:00``; NULL for other texts. Of one spelling, later instants have greater texts."""
    zone = F.regexp_extract(text, _SPELLED, 3)
    digits = F.length(F.regexp_extract(text, _SPELLED, 2)).cast("string")
    return F.when(text.rlike(_SPELLED), F.concat(F.substring(text, 11, 1), digits, zone))


def spelled(us: Column, how: Column) -> Column:
    """Epoch microseconds written as :func:`spelling` names it (the session zone must be UTC)."""
    zone = F.substr(how, F.lit(3))
    digits = F.substring(how, 2, 1)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int")
    shift = F.when(F.length(zone) > 1, F.when(F.left(zone, F.lit(1)) == "-", -minutes).otherwise(minutes))
    local = F.timestamp_micros(us + F.coalesce(shift, F.lit(0)).cast("bigint") * 60_000_000)
    part = F.when(digits == "3", F.date_format(local, ".SSS")).when(digits == "6", F.date_format(local, ".SSSSSS"))
    return F.concat(
        F.date_format(local, "yyyy-MM-dd"), F.left(how, F.lit(1)), F.date_format(local, "HH:mm:ss"),
        F.coalesce(part, F.lit("")), zone,
    )


def utc_day(ms: Column) -> Column:
    """The UTC calendar day of an instant; NULL when there is none."""
    return F.timestamp_millis(ms).cast("date")


def coerce_timestamp(v: Column) -> Column:
    """ISO text from a VARIANT: a date text, a numeric text, or a number of epoch ms."""
    text = trimmed(v.cast("string"))
    shape = F.schema_of_variant(v)
    number = text.try_cast("double")
    # Beyond +-8.64e15 ms there is no calendar date.
    as_ms = F.when(F.abs(number) <= 8.64e15, number.cast("bigint"))
    numeric = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return F.when(
        shape == "STRING",
        F.when(text != "", iso_text(F.coalesce(event_time_ms(text), as_ms))),
    ).when(numeric, iso_text(as_ms))


def split_log_line(line: Column, now_ms: int) -> tuple[Column, Column]:
    """``(ts, message)`` of a log line whose first word may be a timestamp.

    Without one the line is stamped with ``now_ms``, an argument so that a re-run job gives
    the same rows.
    """
    t = trimmed(line)
    space = F.instr(t, " ")
    stamp = F.when(space > 1, event_time_ms(F.left(t, space - 1)))
    now = iso_text(F.lit(now_ms).cast("bigint"))
    ts = F.coalesce(iso_text(stamp), now)
    message = F.when(stamp.isNotNull(), F.substr(t, space + 1)).otherwise(t)
    return ts, message


@dataclass(frozen=True)
class Window:
    """Anchors for time bounds. ``now_ms`` is explicit so results can be reproduced."""

    now_ms: int
    lookback_ms: int = 300_000
    checkpoint_ms: int | None = None


def bound_ms(text: str | None, now_ms: int) -> Column | None:
    """A time bound: ``15m`` style ages count back from ``now_ms``, other text is a date.

    Blank text is no bound (None). Text that is no date folds to NULL, which admits all.
    """
    word = (text or "").strip(WHITESPACE)
    if not word:
        return None
    relative = _RELATIVE.fullmatch(word)
    if relative:
        amount = int(relative.group(1)) * UNIT_MS[relative.group(2).lower()]
        return F.lit(now_ms - amount).cast("bigint")
    return event_time_ms(F.lit(word))


def resolve_since(since: str | None, window: Window) -> Column | None:
    """The lower bound a request gets: its own, else the checkpoint, else the lookback."""
    if since and since != "checkpoint":
        return bound_ms(since, window.now_ms)
    if window.checkpoint_ms is not None:
        return F.lit(window.checkpoint_ms).cast("bigint")
    return F.lit(window.now_ms - window.lookback_ms).cast("bigint")
