"""Replacing secrets in messages, tags and nested data.

All text is matched by Spark's own regular expressions. The one Python step takes nested ``data``
apart into its frame and its strings and knows no patterns.
"""

from __future__ import annotations

import json
import re
import sys
import warnings
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext, cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.model import WHITESPACE

# Executors get the code of the Python step with each task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REDACTED = "[REDACTED]"

# Keys and patterns redacted when nothing else is configured.
DEFAULT_KEYS = ("authorization", "api_key", "token", "secret", "password")
DEFAULT_PATTERNS = (r"sk-[A-Za-z0-9]{20,}", r"Bearer\s+[A-Za-z0-9._-]+")

# Java wants a bound for a repetition inside a look-behind. This one is beyond any text that is
# matched: a longer text is replaced as a whole where a pattern has such a repetition.
_FAR = 100_000_000


@dataclass(frozen=True)
class RedactionPolicy:
    """What to redact: values of listed keys, and text matching the patterns, in order.

    Patterns ignore case. Those that Java cannot compile do not take part; they are listed by
    :meth:`unusable_patterns`, and using the policy warns of them.
    """

    keys: tuple[str, ...] = DEFAULT_KEYS
    patterns: tuple[str, ...] = DEFAULT_PATTERNS
    enabled: bool = True

    def key_set(self) -> list[str]:
        names = (k.strip(WHITESPACE).lower() for k in self.keys)
        return list(dict.fromkeys(n for n in names if n))

    def usable_patterns(self) -> list[str]:
        return [p for p in self.patterns if _compiles(p)]

    def unusable_patterns(self) -> list[str]:
        return [p for p in self.patterns if not _compiles(p)]


_TOKEN = re.compile(r"\\[pP]\{[^}]*\}|\\k<[^>]*>|\\.|\(\?<[=!]|\{\d+(?:,\d*)?\}|.", re.DOTALL)
_OPEN = re.compile(r"[*+]|\{\d+,\}")
_REPEAT = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")


def _tokens(pattern: str) -> list[tuple[str, int]]:
    """Tokens of a pattern of ECMAScript as Java spells them, with their depth in groups; a class of
    characters is one token.

    White space is the full set, ``$`` is the very end, ``[`` inside a class and braces that
    repeat nothing are literal.
    """
    out, depth, class_ = [], 0, None
    for token in _TOKEN.findall(pattern):
        if class_ is not None:
            class_ += {r"\s": WHITESPACE, "[": r"\["}.get(token, token)
            if token == "]":
                out.append((class_, depth))
                class_ = None
        elif token == "[":
            class_ = token
        else:
            depth -= token == ")"
            out.append(({r"\s": f"[{WHITESPACE}]", "$": r"\z", "{": r"\{"}.get(token, token), depth))
            depth += token.startswith("(")
    return out if class_ is None else [*out, (class_, depth)]


def _parts(tokens: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
    """The alternatives of a run of tokens."""
    top = min((d for _, d in tokens), default=0)
    parts: list[list[tuple[str, int]]] = [[]]
    for token in tokens:
        if token == ("|", top):
            parts.append([])
        else:
            parts[-1].append(token)
    return parts


def _behind(tokens: list[tuple[str, int]]) -> tuple[list, list]:
    """A look-behind at the start of an alternative, and what follows it."""
    if not tokens or not tokens[0][0].startswith("(?<"):
        return [], tokens
    end = next((i for i, t in enumerate(tokens) if i and t == (")", tokens[0][1])), len(tokens) - 1)
    return tokens[: end + 1], tokens[end + 1 :]


def _java(pattern: str) -> str:
    """A pattern of ECMAScript for Java.

    Open repetitions inside a look-behind get a bound. Java tries such a look-behind from every
    place back to the start of the text, so one that begins an alternative waits until what
    follows it has matched: that is asked first, ahead.
    """
    tokens = _tokens(pattern)
    out, inside = [], []
    for token, depth in tokens:
        inside = [d for d in inside if depth > d]
        if inside and _OPEN.fullmatch(token):
            least = {"*": "0", "+": "1"}.get(token) or token[1:-2]
            token = f"{{{least},{_FAR}}}"
        if token.startswith("(?<"):
            inside.append(depth)
        out.append((token, depth))

    def text(part) -> str:
        return "".join(t for t, _ in part)

    # Asked twice, groups would have other numbers, or the same names.
    if re.search(r"\\[1-9k]|\(\?<[A-Za-z]", pattern):
        return f"(?i){text(out)}"

    def reordered(part) -> str:
        behind, rest = _behind(part)
        if not rest or str(_FAR) not in text(behind) or _REPEAT.fullmatch(rest[0][0]):
            return text(part)
        return f"(?={text(rest)}){text(part)}"

    return "(?i)" + "|".join(map(reordered, _parts(out)))


def _literal(pattern: str) -> str:
    """The longest text, in lower case, that stands in or before all matches of a pattern; may be
    empty."""
    tokens = _tokens(pattern)
    if len(_parts(tokens)) > 1:
        return ""
    behind, rest = _behind(tokens)
    inner = behind[1:-1] if behind and behind[0][0] == "(?<=" and not (rest and _REPEAT.fullmatch(rest[0][0])) else []
    best = ""
    for run in ([] if len(_parts(inner)) > 1 else inner), rest:
        top, now = min((d for _, d in run), default=0), ""
        for (token, depth), (after, _) in zip(run, [*run[1:], ("", 0)]):
            char = token[1:] if len(token) == 2 and token[0] == "\\" and not token[1].isalnum() else token
            plain = len(char) == 1 and char.isascii() and depth == top and (token != char or char not in "\\.^$|()[]*+?")
            may_miss = after in ("*", "?") or after.startswith("{0")
            now = now + char if plain and not may_miss else ""
            best = max(best, now, key=len)
            if _REPEAT.fullmatch(after):
                now = ""
    return best.lower()


def _compiles(pattern: str) -> bool:
    try:
        SparkContext.getOrCreate()._jvm.java.util.regex.Pattern.compile(_java(pattern))
    except (Py4JJavaError, PySparkException):
        return False
    return True


def _warn(policy: RedactionPolicy) -> None:
    unusable = policy.unusable_patterns()
    if unusable:
        warnings.warn(f"redaction patterns without effect: {unusable}", stacklevel=3)


def redact_text(text: Column, policy: RedactionPolicy) -> Column:
    _warn(policy)
    return _clean(text, policy.usable_patterns())


def _clean(text: Column, patterns: list[str]) -> Column:
    """The text with all matches replaced, pattern after pattern. A search for a text that every
    match needs is far cheaper than a pattern, and goes first."""

    def one(pattern: str):
        spelled, needed = _java(pattern), _literal(pattern)

        def clean(t: Column) -> Column:
            out = F.regexp_replace(t, F.lit(spelled), F.lit(REDACTED))
            if str(_FAR) in spelled:
                out = F.when(F.length(t) > _FAR, F.lit(REDACTED)).otherwise(out)
            return F.when(F.contains(F.lower(t), F.lit(needed)), out).otherwise(t) if needed else out

        return clean

    for pattern in patterns:
        # Bound to a name, so that what comes before stands in the plan once.
        text = F.transform(F.array(text), one(pattern))[0]
    return text


def redact_tags(tags: Column, policy: RedactionPolicy) -> Column:
    keys, patterns = policy.key_set(), policy.usable_patterns()
    _warn(policy)

    def value(k: Column, v: Column) -> Column:
        clean = _clean(v, patterns)
        return F.when(F.lower(k).isin(keys), F.lit(REDACTED)).otherwise(clean) if keys else clean

    return F.transform_values(tags, value)


def redact_data(data: Column, policy: RedactionPolicy) -> Column:
    """Redact a JSON text at any depth.

    A listed key has its whole value replaced, whatever its type; strings elsewhere are
    matched against the patterns; keys, numbers and other values stay. Text that is no JSON
    is matched as a whole. Depth is unbounded, which no built-in function walks: the Python
    step returns the text between the strings and the strings, which Spark cleans and puts
    back. What it cannot take apart for any other reason is replaced as a whole. Rows that
    cannot hold anything to redact are recognised by built-in functions and reach Python as
    NULL, which costs nothing to send.
    """
    keys, patterns = policy.key_set(), policy.usable_patterns()
    _warn(policy)
    if not keys and not patterns:
        return data
    apart = _splitter(keys)(F.when(_suspicious(data, keys, patterns), data))

    def quoted(leaf: Column) -> Column:
        text = F.to_json(F.array(_clean(leaf, patterns)))
        return F.coalesce(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))

    def whole(parts: Column) -> Column:
        frame, leaves = parts[0], parts[1]
        joined = F.array_join(
            F.zip_with(frame, leaves, lambda f, x: F.concat(f, F.when(x.isNull(), "").otherwise(quoted(x)))), ""
        )
        return F.when(F.size(frame) == 0, _clean(leaves[0], patterns)).otherwise(joined)

    # Bound once, so that the Python step stands in the plan once.
    clean = F.transform(F.array(apart), lambda p: F.when(p.isNotNull(), whole(p)))[0]
    return F.coalesce(clean, data)


def _suspicious(data: Column, keys: list[str], patterns: list[str]) -> Column:
    """Rows that may hold something to redact (may say yes too often, never no wrongly)."""
    # Escapes hide characters from a search over the raw text.
    found = F.contains(data, F.lit("\\"))
    if keys:
        listed = "|".join(re.escape(k) for k in keys)
        found = found | data.rlike(f'(?iu)"({listed})"')
    for pattern in patterns:
        # Anchors and look-around see the neighbours of a match, which differ in raw text; a text
        # that stands in or before every match does not.
        if re.search(r"[\^$]|\\[bBAZzG]|\(\?", pattern):
            needed = _literal(pattern)
            found = found | (F.contains(F.lower(data), F.lit(needed)) if needed else data.isNotNull())
        else:
            found = found | data.rlike(_java(pattern))
    return found


class _Number(str):
    """A JSON number kept as it was written."""


_JSON_TOKEN = re.compile(
    r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)'
    r"|(true|false|null|NaN|-?Infinity)|([{}\[\],:]))",
    re.ASCII,
)
_VALUE, _VALUE_OR_END, _KEY, _KEY_OR_END, _COLON, _NEXT = range(6)


def _read(text: str):
    """A JSON text as Python values, of equal keys the last; ValueError if it is none.

    Nesting is kept on a list, so depth is bounded by memory only.
    """
    open_, keys, result, due, at = [], [], [], _VALUE, 0

    def put(value):
        nonlocal due
        if not open_:
            result.append(value)
        elif isinstance(open_[-1], list):
            open_[-1].append(value)
        else:
            open_[-1][keys.pop()] = value
        due = _NEXT

    while not result or open_:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            raise ValueError("no JSON")
        at = m.end()
        string, number, word, mark = m.groups()
        if string is not None and due in (_KEY, _KEY_OR_END):
            keys.append(_text(string))
            due = _COLON
        elif mark == ":" and due == _COLON:
            due = _VALUE
        elif mark == "," and due == _NEXT:
            due = _VALUE if isinstance(open_[-1], list) else _KEY
        elif mark in ("}", "]") and due in (_NEXT, _VALUE_OR_END, _KEY_OR_END) and (
            isinstance(open_[-1], list) == (mark == "]")
        ):
            put(open_.pop())
        elif due in (_VALUE, _VALUE_OR_END) and mark in ("{", "["):
            open_.append({} if mark == "{" else [])
            due = _KEY_OR_END if mark == "{" else _VALUE_OR_END
        elif due in (_VALUE, _VALUE_OR_END) and mark is None:
            put(_text(string) if string is not None else _Number(number if number is not None else word))
        else:
            raise ValueError("no JSON")
    if text[at:].strip(" \t\n\r"):
        raise ValueError("no JSON")
    return result[0]


def _text(string: str) -> str:
    """The value of a JSON string; half a surrogate pair, which no column holds, is replaced."""
    value = json.loads(string)
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _apart(value, keys: frozenset[str]) -> list[list[str]]:
    """[frame, strings]: the compact text of a value is frame[0] string[0] frame[1] ..."""
    frame, strings, run = [], [], []
    todo = [(False, value)]  # (is it text of the frame, item)
    while todo:
        fixed, item = todo.pop()
        if fixed or isinstance(item, _Number):
            run.append(item)
        elif isinstance(item, str):
            frame.append("".join(run))
            strings.append(item)
            run.clear()
        else:
            is_dict = isinstance(item, dict)
            run.append("{" if is_dict else "[")
            parts = []
            for i, x in enumerate(item):
                comma = "," if i else ""
                if not is_dict:
                    parts += [(True, comma), (False, x)]
                    continue
                parts.append((True, f"{comma}{json.dumps(x, ensure_ascii=False)}:"))
                hide = x.lower() in keys
                parts.append((True, f'"{REDACTED}"') if hide else (False, item[x]))
            todo.append((True, "}" if is_dict else "]"))
            todo += reversed(parts)
    return [[*frame, "".join(run)], strings]


class _Repeated(Exception):
    """An object has a key twice."""


# Openings of nested objects by keys without an escape, and closings of objects, as runs.
_OPENINGS = re.compile(r'(?:\{"[^"\\\x00-\x1f]*+":)++')
_CLOSINGS = re.compile(r"\}++")
_LIST = object()


def _streamed(text: str, keys: frozenset[str]) -> list[list[str]]:
    """What :func:`_apart` gives for a JSON text, read once from left to right. Of each open object
    only the keys are held; nesting that goes straight down or up is taken as one run."""
    frame, strings, run = [], [], []
    open_: list = []  # _LIST, or of an object its keys: None, one, or a set of several
    due, at, hidden = _VALUE, 0, 0  # hidden: number of open values around one that is replaced

    def new_key(key: str) -> None:
        seen = open_[-1]
        if seen is None:
            open_[-1] = key
        elif isinstance(seen, str) and seen != key:
            open_[-1] = {seen, key}
        elif isinstance(seen, set) and key not in seen:
            seen.add(key)
        else:
            raise _Repeated

    while due != _NEXT or open_:
        if due in (_VALUE, _VALUE_OR_END) and (m := _OPENINGS.match(text, at)):
            names = m[0][2:-2].split('":{"')
            if not hidden:
                names = names[: next((i for i, x in enumerate(names) if x.lower() in keys), len(names))]
            if names:
                piece = '{"' + '":{"'.join(names) + '":'
                open_ += names
                at += len(piece)
                due = _VALUE
                if not hidden:
                    run.append(piece)
                continue
        if due == _NEXT and (m := _CLOSINGS.match(text, at)):
            n = len(m[0])
            if n > len(open_) or _LIST in open_[-n:]:
                n = next((i for i, x in enumerate(reversed(open_)) if x is _LIST), len(open_))
            if not n:
                raise ValueError("no JSON")
            inside = max(0, min(n, len(open_) - hidden)) if hidden else 0
            del open_[-n:]
            at += n
            hidden = 0 if len(open_) <= hidden else hidden
            run.append("}" * (n - inside))
            continue
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            raise ValueError("no JSON")
        at = m.end()
        string, number, word, mark = m.groups()
        out = ""
        if string is not None and due in (_KEY, _KEY_OR_END):
            key = _text(string)
            new_key(key)
            out, due = json.dumps(key, ensure_ascii=False), _COLON
            hide = not hidden and key.lower() in keys
        elif mark == ":" and due == _COLON:
            out, due = ":", _VALUE
            if hide:
                run.append(f':"{REDACTED}"')
                hidden = len(open_)
        elif mark == "," and due == _NEXT:
            hidden = 0 if len(open_) <= hidden else hidden
            out, due = ",", _VALUE if open_[-1] is _LIST else _KEY
        elif mark in ("}", "]") and due in (_NEXT, _VALUE_OR_END, _KEY_OR_END) and (open_[-1] is _LIST) == (mark == "]"):
            # The closing of what holds the replaced value ends the hiding.
            hidden = 0 if due == _NEXT and len(open_) <= hidden else hidden
            open_.pop()
            out, due = mark, _NEXT
        elif due in (_VALUE, _VALUE_OR_END) and mark in ("{", "["):
            open_.append(None if mark == "{" else _LIST)
            out, due = mark, _KEY_OR_END if mark == "{" else _VALUE_OR_END
        elif due in (_VALUE, _VALUE_OR_END) and mark is None:
            due = _NEXT
            if string is not None:
                value = _text(string)
                if not hidden:
                    frame.append("".join(run))
                    strings.append(value)
                    run.clear()
            else:
                out = number if number is not None else word
        else:
            raise ValueError("no JSON")
        if out and not hidden:
            run.append(out)
    if text[at:].strip(" \t\n\r"):
        raise ValueError("no JSON")
    return [[*frame, "".join(run)], strings]


def _splitter(keys: list[str]):
    listed = frozenset(keys)

    def one(text):
        if text is None:
            return None
        try:
            return _streamed(text, listed)
        except _Repeated:
            pass
        except ValueError:
            # No JSON, so there are no keys to go by.
            return [[], [text]]
        except (RecursionError, MemoryError):
            return [[f'"{REDACTED}"'], []]
        try:
            return _apart(_read(text), listed)
        except ValueError:
            return [[], [text]]
        except (RecursionError, MemoryError):
            return [[f'"{REDACTED}"'], []]

    @F.arrow_udf("array<array<string>>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.list_(pa.list_(pa.string())))

    return split
