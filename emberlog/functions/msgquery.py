"""Boolean message search: the text of a request becomes one Spark predicate.

The search language has the operators and the precedence of SQL (NOT, then AND, then OR),
so each word is turned into a ``contains`` call, a missing AND is filled in, and Spark reads
the result as an ordinary SQL expression. Nothing is evaluated in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.model import WHITESPACE


class InvalidQuery(ValueError):
    """The search text cannot be read. The text starts with ``Invalid query:``."""

    def __init__(self, reason: str):
        super().__init__(f"Invalid query: {reason}")


_SPACE = re.escape(WHITESPACE)
_TOKEN = re.compile(
    rf"""(?P<space>[{_SPACE}]+)
    | (?P<lparen>\() | (?P<rparen>\))
    | "(?P<phrase>(?:\\.|[^"\\])*)(?P<close>"?)
    | (?P<not>[!-])
    | (?P<word>[^{_SPACE}()]+)""",
    re.VERBOSE | re.DOTALL,
)
_KEYWORDS = {"AND": "and", "OR": "or", "NOT": "not"}


def _words(text: str):
    """Yield ``(kind, value, position)``."""
    pos = 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        start, pos = pos, m.end()
        kind = m.lastgroup
        if kind == "space":
            continue
        if m["phrase"] is not None:
            # A closing quote is missing. The reading accepted elsewhere is kept: the text
            # may end in the opening quote itself or in an escaped quote.
            if not m["close"] and (pos < len(text) or text[-1] != '"'):
                raise InvalidQuery(f"Unterminated quote at position {start}")
            yield "phrase", re.sub(r"\\(.)", r"\1", m["phrase"], flags=re.DOTALL), start
            if not m["close"]:
                return
        elif kind == "word":
            keyword = _KEYWORDS.get(m["word"].upper())
            yield (keyword, None, start) if keyword else ("word", m["word"], start)
        else:
            yield kind, None, start


def to_sql(query: str, subject: str) -> str:
    """SQL text of a search over the lower-cased string expression ``subject``."""
    tokens = list(_words(query.strip(WHITESPACE)))
    if not tokens:
        raise InvalidQuery("Empty query")
    sql: list[str] = []
    depth = 0
    complete = False  # the text so far is a whole operand
    for kind, value, at in tokens:
        if complete and kind in ("word", "phrase", "lparen", "not"):
            sql.append("AND")
            complete = False
        if complete:
            if kind == "rparen":
                if depth == 0:
                    raise InvalidQuery(f'Unexpected token "rparen" at position {at}')
                depth -= 1
                sql.append(")")
            else:
                sql.append(kind.upper())
                complete = False
        elif kind in ("word", "phrase"):
            # Hex spelling: no quoting rules, whatever the parser settings are.
            needle = f"CAST(X'{value.encode('utf-8').hex()}' AS STRING)"
            sql.append(f"contains({subject}, lower({needle}))")
            complete = True
        elif kind == "lparen":
            depth += 1
            sql.append("(")
        elif kind == "not":
            sql.append("NOT")
        else:
            raise InvalidQuery(f'Expected term at position {at}, found "{kind}"')
    if not complete:
        raise InvalidQuery("Unexpected end of query")
    if depth:
        raise InvalidQuery('Expected ")" at position 0')
    return " ".join(sql)


def message_query(query: str, column: str = "message") -> Column:
    """Predicate of a search over a message column; a NULL message counts as empty text."""
    name = ".".join(f"`{part}`" for part in column.split("."))
    return F.expr(to_sql(query, f"lower(coalesce({name}, ''))"))


def required_terms(query: str) -> list[str]:
    """Words and phrases that every found message holds; none are told for searches with OR or groups."""
    tokens = list(_words(query.strip(WHITESPACE)))
    if any(kind in ("or", "lparen", "rparen") for kind, _, _ in tokens):
        return []
    kinds = [None, *(kind for kind, _, _ in tokens)]
    return [
        value for before, (kind, value, _) in zip(kinds, tokens)
        if kind in ("word", "phrase") and before != "not" and value
    ]
