"""Message shortening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "..."
_DOTS = len(ELLIPSIS)


def truncate_message(message: Column, max_chars: int | None) -> Column:
    """The first characters and an ellipsis; no cap when ``max_chars`` is not positive."""
    if not max_chars or max_chars <= 0:
        return message
    if max_chars <= _DOTS:
        return F.left(message, F.lit(max_chars))
    cut = F.concat(F.left(message, F.lit(max_chars - _DOTS)), F.lit(ELLIPSIS))
    return F.when(F.length(message) > max_chars, cut).otherwise(message)


def trim_message(message: Column, max_chars: int | None, match: str | None = None) -> Column:
    """At most ``max_chars`` characters: around the first ``match``, else head and tail.

    A window on a match is centred on it, shows an ellipsis only on a side that is cut, and
    is widened by the ellipsis an uncut side does not need.
    """
    if not max_chars or max_chars <= 0:
        return message
    if max_chars <= _DOTS:
        return F.left(message, F.lit(max_chars))
    tail = (max_chars - _DOTS) // 2
    head = max_chars - _DOTS - tail
    ends = [F.left(message, F.lit(head)), F.lit(ELLIPSIS)]
    if tail:
        ends.append(F.right(message, F.lit(tail)))
    short = F.concat(*ends)
    if match:
        needle = F.lower(F.lit(match))
        found = F.struct(
            (F.instr(F.lower(message), needle) - 1).alias("at"), F.length(message).alias("total")
        )
        ends_only = short

        def shorten(f: Column) -> Column:
            window = _window(message, f["at"], f["total"], F.length(needle), max_chars)
            return F.when(f["at"] >= 0, window).otherwise(ends_only)

        # The lambda binds the position, so a long text is searched once.
        short = F.get(F.transform(F.array(found), shorten), 0)
    return F.when(F.length(message) > max_chars, short).otherwise(message)


def _window(message: Column, at: Column, total: Column, match_len: Column, max_chars: int) -> Column:
    centre = at + F.floor(match_len / 2)

    def span(width: Column) -> tuple[Column, Column]:
        last_start = F.greatest(F.lit(0), total - width)
        start = F.least(F.greatest(centre - F.floor(width / 2), F.lit(0)), last_start)
        return start, F.least(total, start + width)

    width = F.lit(max(1, max_chars - 2 * _DOTS))
    start, end = span(width)
    spare = F.when(start <= 0, _DOTS).otherwise(0) + F.when(end >= total, _DOTS).otherwise(0)
    start, end = span(F.least(total, width + spare))
    shown = F.concat(
        F.when(start > 0, ELLIPSIS).otherwise(""),
        F.substr(message, (start + 1).cast("int"), (end - start).cast("int")),
        F.when(end < total, ELLIPSIS).otherwise(""),
    )
    return F.left(shown, F.lit(max_chars))
