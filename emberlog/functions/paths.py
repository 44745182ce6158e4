"""Fields and dotted paths of an event as columns, and text lines built from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.jsontext import NESTED, kind_of, object_text, quote, value_text
from emberlog.model import EVENT_FIELDS, SOURCE_TYPE, WHITESPACE

_TOKEN = re.compile(r"\{([a-zA-Z0-9_.]+)\}")
_STRUCTURED = ("data", "tags", "source")


def split_path(path: str) -> list[str] | None:
    """Segments of a path into an event; None for paths that name no event field."""
    parts = path.split(".")
    if not all(parts) or parts[0] not in EVENT_FIELDS:
        return None
    return parts


def path_json(parts: list[str]) -> Column:
    """The value at a path as JSON text; NULL when absent."""
    top, rest = parts[0], parts[1:]
    if top == "data":
        if not rest:
            return F.col("data")
        value, raw = _data_value(rest)
        return F.when(kind_of(value).isNotNull(), value_text(value, raw))
    if top in ("tags", "source") and not rest:
        return F.to_json(F.col(top))
    text = _scalar(top, rest)
    if parts == ["source", "line"]:
        return text
    return F.when(text.isNotNull(), quote(text))


def path_text(parts: list[str]) -> Column:
    """The value at a path for display: strings bare, other values as JSON, NULL when absent."""
    top, rest = parts[0], parts[1:]
    if top == "data" and rest:
        value, raw = _data_value(rest)
        return F.when(kind_of(value).isNotNull(), raw)
    if top in _STRUCTURED and not rest:
        return path_json(parts)
    return _scalar(top, rest)


def _scalar(top: str, rest: list[str]) -> Column:
    column = F.col(top)
    if top == "tags" and len(rest) == 1:
        return F.try_element_at(column, F.lit(rest[0]))
    if top == "source" and len(rest) == 1 and rest[0] in SOURCE_TYPE.names:
        return column.getField(rest[0]).cast("string")
    if not rest and top not in _STRUCTURED:
        return column
    return F.lit(None).cast("string")


def _data_value(rest: list[str]) -> tuple[Column, Column]:
    variant_path = "$" + "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in rest)
    text_path = "$" + "".join(f".{p}" if "'" in p else f"['{p}']" for p in rest)
    value = F.try_variant_get(F.try_parse_json("data"), variant_path, "variant")
    raw = F.get_json_object("data", text_path)
    present = F.when(kind_of(value).isin(*NESTED, "STRING"), raw).otherwise(value.cast("string"))
    return value, present


def path_tree(fields: list[str]) -> dict:
    """Nested dict of the requested paths; a leaf (None) stands for the whole value."""
    tree: dict = {}
    for field in fields:
        parts = split_path(field)
        if not parts:
            continue
        node = tree
        for part in parts[:-1]:
            node = node.setdefault(part, {})
            if node is None:
                break
        if node is not None:
            node[parts[-1]] = None
    return tree


def event_json(fields: list[str] | None = None, flatten: bool = False) -> Column:
    """An event as one JSON object, whole or cut down to ``fields`` in their order.

    Absent values are left out. Dotted paths become nested objects, or keep their text as
    the key with ``flatten``.
    """
    if not fields:
        return object_text(*[(f, path_json([f])) for f in EVENT_FIELDS])
    if flatten:
        known = [f for f in dict.fromkeys(fields) if split_path(f)]
        return object_text(*[(f, path_json(split_path(f))) for f in known])

    def render(prefix: list[str], node: dict) -> Column:
        members = []
        for name, child in node.items():
            here = [*prefix, name]
            if child is None:
                members.append((name, path_json(here)))
            else:
                inner = render(here, child)
                members.append((name, F.when(inner != "{}", inner)))
        return object_text(*members)

    return render([], path_tree(fields))


def event_line(template: str | None = None) -> Column:
    """An event as one text line, by a ``{field}`` template or the default layout.

    Missing and unknown fields print as nothing; the end of the line is trimmed.
    """
    if template:
        parts, at = [], 0
        for m in _TOKEN.finditer(template):
            parts.append(F.lit(template[at : m.start()]))
            path = split_path(m.group(1))
            if path:
                parts.append(F.coalesce(path_text(path), F.lit("")))
            at = m.end()
        parts.append(F.lit(template[at:]))
        line = F.concat(*parts)
    else:
        session = F.col("session_id")
        suffix = F.when(session != "", F.concat(F.lit(" session="), session))
        shown = [F.coalesce(F.col(c), F.lit("")) for c in ("ts", "level", "service", "type")]
        line = F.concat(
            F.concat_ws(" ", *shown),
            F.coalesce(suffix, F.lit("")),
            F.lit(" "),
            F.coalesce(F.col("message"), F.lit("")),
        )
    return F.rtrim(line, F.lit(WHITESPACE))
