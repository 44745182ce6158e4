"""JSON text as Spark columns.

Spark's JSON functions stop reading at the end of the first value, so ``{"a":1} junk``
counts as ``{"a":1}``. Log files do hold such lines (two writers interleaving), and they are
malformed. The strict readers below therefore put the text in front of a known end marker
inside one array and check that exactly the text and the marker came back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

NESTED = ("OBJECT", "ARRAY")

_END = "emberlog-end-of-value"


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A plain projection may be repeated by the optimizer when a later filter is pushed
    through it, which would parse each document twice. A generator is not duplicated.
    """
    names = list(columns)
    packed = F.array(F.struct(*[columns[n].alias(n) for n in names]))
    return df.select("*", F.explode_outer(packed).alias("_bound")).select(
        *df.columns, *[F.col("_bound").getField(n).alias(n) for n in names]
    )


def read_object(text: Column, fields: str) -> Column:
    """The JSON object in ``text`` as a struct, NULL unless it is one whole object.

    ``fields`` is a DDL column list; declare fields STRING or VARIANT so that a field of an
    unexpected type does not reject the row.
    """
    framed = F.concat(F.lit("["), text, F.lit(f',{{"{_END}":true}}]'))
    items = F.from_json(framed, f"array<struct<{fields}, `{_END}`: boolean>>", STRICT)
    return F.get(
        F.transform(
            F.array(items),
            lambda a: F.when(
                (F.size(a) == 2) & F.coalesce(F.get(a, 1).getField(_END), F.lit(False)),
                F.get(a, 0),
            ),
        ),
        0,
    )


def read_map(text: Column, value_type: str) -> Column:
    """Like :func:`read_object`, with all entries as ``map<string, value_type>``."""
    framed = F.concat(F.lit("["), text, F.lit(f',{{"{_END}":true}}]'))
    items = F.from_json(framed, f"array<map<string,{value_type}>>", STRICT)
    return F.get(
        F.transform(
            F.array(items),
            lambda a: F.when(
                (F.size(a) == 2) & F.map_contains_key(F.get(a, 1), F.lit(_END)), F.get(a, 0)
            ),
        ),
        0,
    )


def is_json(text: Column) -> Column:
    """True when ``text`` is exactly one JSON value of any kind."""
    framed = F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))
    items = F.from_json(framed, "array<string>", STRICT)
    return F.coalesce(
        F.get(
            F.transform(
                F.array(items),
                lambda a: (F.size(a) == 2) & (F.get(a, 1) == F.lit(_END)),
            ),
            0,
        ),
        F.lit(False),
    )


def read_items(text: Column) -> Column:
    """Elements of a JSON array as ``array<struct<kind, text>>``.

    ``kind`` is as in :func:`kind_of`; ``text`` is the element as compact JSON in its own key
    order, except that a string element is given bare.
    """
    typed = F.from_json(text, "array<variant>", STRICT)
    raw = F.from_json(text, "array<string>", STRICT)

    def item(v: Column, r: Column) -> Column:
        return F.struct(
            kind_of(v).alias("kind"),
            F.when(kind_of(v).isin(*NESTED), compact(r))
            .otherwise(F.coalesce(r, F.lit("null")))
            .alias("text"),
        )

    return F.zip_with(typed, raw, item)


def kind_of(v: Column) -> Column:
    """Type of a VARIANT: OBJECT, ARRAY, STRING, VOID (JSON null) or a scalar type's name.

    One evaluation of the type is all it takes, also inside lambdas, where Spark does not
    share common subexpressions.
    """
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def string_of(v: Column) -> Column:
    """The text of a VARIANT holding a string; NULL for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def quote(text: Column) -> Column:
    """``text`` as a JSON string literal."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


def compact(text: Column) -> Column:
    """JSON text without blanks between tokens, keys in their own order."""
    return F.get_json_object(text, "$")


def value_text(v: Column, raw: Column) -> Column:
    """One value as compact JSON text, from its typed and its raw reading."""
    kind = kind_of(v)
    return (
        F.when(kind.isin(*NESTED), compact(raw))
        .when(kind == "STRING", F.to_json(v))
        .otherwise(F.coalesce(raw, F.lit("null")))
    )


def object_text(*members: tuple[str, Column]) -> Column:
    """A JSON object from ``(name, value text)`` pairs; members with a NULL text are left out."""
    parts = [F.concat(F.lit(_name(name) + ":"), text) for name, text in members]
    if not parts:
        return F.lit("{}")
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def entries_text(entries: Column) -> Column:
    """A JSON object from an ``array<struct<key, text>>``."""
    return F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(entries, lambda e: F.concat(quote(e["key"]), F.lit(":"), e["text"])), ","
        ),
        F.lit("}"),
    )


def _name(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)
