"""Reading log records written as JSON by someone else into event fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.jsontext import (
    NESTED,
    STRICT,
    bind,
    compact,
    kind_of,
    read_items,
    read_map,
    string_of,
    value_text,
)
from emberlog.functions.levels import infer_level, normalize_level
from emberlog.model import EVENT_FIELDS

_VALUES = "_values"
_RAW = "_raw"
_ENTRY = "array<struct<key:string,text:string>>"


def parse_records(df: DataFrame, text: Column) -> DataFrame:
    """Parse ``text`` where it is a JSON object; :class:`Record` reads the result."""
    candidate = F.when(text.startswith("{"), text)
    return bind(
        df, **{_VALUES: read_map(candidate, "variant"), _RAW: read_map(candidate, "string")}
    )


class Record:
    """Column builders over a frame made by :func:`parse_records`."""

    def __init__(self) -> None:
        self.values = F.col(_VALUES)
        self.raw = F.col(_RAW)

    def field(self, name: str) -> Column:
        return F.try_element_at(self.values, F.lit(name))

    def string(self, name: str) -> Column:
        """The field when it is a string, else NULL."""
        return string_of(self.field(name))

    def has_any(self, names: Sequence[str]) -> Column:
        keys = F.map_keys(self.values)
        return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, names))), F.lit(False))

    def message(self) -> Column:
        """First of message, msg and log that is a string."""
        return F.coalesce(self.string("message"), self.string("msg"), self.string("log"))

    def unreadable_level(self, name: str) -> Column:
        """The field holds something that is neither text nor empty, such as a number.

        Such a record is not taken apart but kept as plain text.
        """
        v = self.field(name)
        kind = kind_of(v)
        text = v.cast("string")
        empty = (text == "false") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
        bad = (
            F.when(kind.isin("STRING", "VOID"), False)
            .when(kind.isin(*NESTED), True)
            .otherwise(~empty)
        )
        return F.coalesce(bad, F.lit(False))

    def level_known(self, name: str) -> Column:
        return normalize_level(self.string(name)).isNotNull()

    def level(self, message: Column, *names: str) -> Column:
        known = [normalize_level(self.string(n)) for n in names]
        return F.coalesce(*known, infer_level(message))

    def tags(self) -> Column:
        """String entries of ``tags``; NULL when there are none."""
        raw = F.try_element_at(self.raw, F.lit("tags"))
        kind = kind_of(self.field("tags"))
        typed = F.from_json(raw, "map<string,variant>", STRICT)
        texts = F.map_filter(
            F.transform_values(typed, lambda k, v: string_of(v)), lambda k, v: v.isNotNull()
        )
        listed = F.filter(
            F.transform(
                read_items(raw),
                lambda x, i: F.struct(
                    i.cast("string").alias("key"),
                    F.when(x["kind"] == "STRING", x["text"]).alias("value"),
                ),
            ),
            lambda e: e["value"].isNotNull(),
        )
        found = F.when(kind == "OBJECT", texts).when(kind == "ARRAY", F.map_from_entries(listed))
        return F.when(F.size(found) > 0, found)

    def source_fields(self) -> dict[str, Column]:
        raw = F.try_element_at(self.raw, F.lit("source"))
        v = F.when(kind_of(self.field("source")) == "OBJECT", raw)
        parsed = F.from_json(v, "file variant, line variant, backend_id variant", STRICT)
        return {
            "file": string_of(parsed["file"]),
            "line": F.try_variant_get(parsed["line"], "$", "int"),
            "backend_id": string_of(parsed["backend_id"]),
        }

    def has_data(self) -> Column:
        return F.coalesce(kind_of(self.field("data")).isin(*NESTED), F.lit(False))

    def data_json(self) -> Column:
        """``data`` as compact JSON text when it is an object or array, else NULL."""
        return F.when(self.has_data(), compact(F.try_element_at(self.raw, F.lit("data"))))

    def extra_entries(self) -> Column:
        """All entries that are no event field, in their order."""
        return F.filter(
            _entries(self.values, self.raw), lambda e: ~e["key"].isin(*EVENT_FIELDS)
        )

    def flat_extra(self) -> Column:
        """The extra entries as JSON text where none of them is nested, else NULL.

        Printing a map keeps the order of its keys but not of those inside its values.
        """
        extra = F.map_filter(self.values, lambda k, v: ~k.isin(*EVENT_FIELDS))
        nested = F.exists(
            F.map_values(self.raw), lambda t: F.coalesce(t.rlike(r"^[{\[]"), F.lit(False))
        )
        return F.when(~nested, F.to_json(extra))

    def data_has(self, names: Sequence[str]) -> Column:
        """An object in ``data`` holds one of the names."""
        keys = F.json_object_keys(F.try_element_at(self.raw, F.lit("data")))
        return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, names))), F.lit(False))

    def data_entries(self) -> Column:
        """Entries of ``data``; of an array, its elements by position."""
        raw = F.try_element_at(self.raw, F.lit("data"))
        kind = kind_of(self.field("data"))
        members = _entries(
            F.from_json(raw, "map<string,variant>", STRICT),
            F.from_json(raw, "map<string,string>", STRICT),
        )
        elements = F.transform(
            F.from_json(raw, "array<variant>", STRICT),
            lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("v")),
        )
        texts = F.from_json(raw, "array<string>", STRICT)
        listed = F.zip_with(
            elements,
            texts,
            lambda e, r: F.struct(e["key"].alias("key"), value_text(e["v"], r).alias("text")),
        )
        return F.when(kind == "OBJECT", members).when(kind == "ARRAY", listed)

    def data_is_array(self) -> Column:
        return F.coalesce(kind_of(self.field("data")) == "ARRAY", F.lit(False))


def _entries(values: Column, raw: Column) -> Column:
    pairs = F.zip_with(
        F.map_entries(values),
        F.map_values(raw),
        lambda e, r: F.struct(
            e["key"].alias("key"), value_text(e["value"], r).alias("text")
        ),
    )
    return pairs


def entry_list(*members: tuple[str, Column]) -> Column:
    """``array<struct<key, text>>`` from names and value texts."""
    return F.array(
        *[F.struct(F.lit(k).alias("key"), t.alias("text")) for k, t in members]
    ).cast(_ENTRY)


def append_text(base: Column, more: Column) -> Column:
    """Two JSON objects without a common key as one."""
    joined = F.concat(F.left(base, F.length(base) - 1), F.lit(","), F.substr(more, F.lit(2)))
    return F.when(more == "{}", base).otherwise(joined)


def overlay(base: Column, over: Column, names: Sequence[str], over_first: Column) -> Column:
    """Entries of ``base`` with values replaced by ``over``, then what ``over`` adds.

    With ``over_first`` (numbered entries of an array) the additions come first.
    """
    def replaced(e: Column) -> Column:
        same = F.filter(over, lambda o: o["key"] == e["key"])
        return F.struct(
            e["key"].alias("key"),
            F.coalesce(F.get(same, F.size(same) - 1)["text"], e["text"]).alias("text"),
        )

    kept = F.transform(base, replaced)
    added = F.filter(over, lambda o: ~o["key"].isin(*names))
    joined = F.when(over_first, F.concat(added, kept)).otherwise(F.concat(kept, added))
    return F.filter(joined, lambda e: e["text"].isNotNull())
