"""Main text of web pages by minimum-cut labelling.

A page is read as a row of text blocks. A table of costs, ``COSTS``, says for each block how dear it
is to call it content and how dear to call it boilerplate: the capacities of its edges to the two
terminals. Neighbouring blocks, and blocks whose paths in the document have much in common, are
joined by edges that cost something when cut. The minimum cut, found by maximum flow, is the
labelling of least total cost; a short paragraph between long ones stays content, a long notice in a
menu stays boilerplate. Text in scripts, styles, forms, comments and the like never becomes a block.

A name counts by its share of a class or id: ``cookie-notice`` and ``site-footer`` are boilerplate for sure,
which no edge overrules, so that an advert between paragraphs goes; ``search-results-study`` only speaks
against content, and an article or its neighbours outweigh it. What a layout is said to be ``with`` is
not what it is.

Each page is a row of its own and nothing is shuffled; blocks and edges grow with the page, and an
edge joins a block to the two before it only.

Character references are decoded, white space within a block becomes one space, blocks are joined by
an empty line in the order of the page. Tags that are not closed end where their parent or the page
ends. NULL and empty pages, and pages without content, give an empty text. Repeated rows agree.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import small_batches, table

# Fixed values of HTML: elements without an end tag, elements that start a block, elements whose
# text is no text of the page, and elements that are closed by others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption head title".split()
)
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
HIDDEN = frozenset(
    "head script style noscript template textarea select option button form input iframe object "
    "svg canvas audio video map label datalist dialog noembed noframes title fieldset".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_SCOPES = frozenset(("ul", "ol", "dl", "table", "menu", "select"))

# Words in a class or id that speak against content, and for it.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner sponsor sponsored promo "
    "promotion nav navigation navbar menu menubar sidebar side aside footer header masthead "
    "breadcrumb breadcrumbs cookie cookies consent notice notices gdpr popup modal overlay alert "
    "newsletter subscribe subscription signup login comment comments reply replies respond "
    "discussion disqus related recommended social share sharing sharebar tags tagcloud widget "
    "pagination pager copyright legal disclaimer toolbar skip search".split()
)
GOOD_NAMES = frozenset("article content main post story entry text body prose".split())
# Words of a name that say where or what shape, not what; and words that speak of another element.
LAYOUT_NAMES = frozenset(
    "site page main global top bottom left right box block item items list container wrapper wrap inner outer "
    "area section panel col row bar link links btn button".split()
)
ABOUT_OTHERS = frozenset("with has have no without hide show".split())
BAD_TAGS = frozenset("nav header footer aside menu form address dialog".split())
BAD_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert form menu menubar "
    "alertdialog toolbar".split()
)

#: Costs of a label, in whole units: (for content, for boilerplate) per trait of a block.
COSTS = {
    "bad": (400, 0),  # in an element that is named or known for boilerplate
    "doubtful": (24, 0),  # in an element whose name has a word of boilerplate among others
    "article": (0, 60),  # in an article or the main element
    "named_content": (0, 20),
    "linked": (40, 0),  # most of its text is in links
    "long": (0, 12),
    "short": (4, 0),
    "heading": (0, 4),
    "plain": (6, 6),
}
NEXT_TO = 6  # cutting two neighbours apart
SAME_PARENT = 14  # and if they have the same parent, in addition
CLOSE_PATH = 4  # or if their paths differ in one step


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  # numbers of the elements around it
    bad: bool
    doubtful: bool
    article: bool
    named: bool
    linked: float
    heading: bool


_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")


class _Element(NamedTuple):
    tag: str
    number: int
    hidden: bool
    bad: bool
    doubtful: bool
    article: bool
    named: bool
    link: bool


def _against(value: str) -> tuple[bool, bool]:
    """Whether a class or id names boilerplate for sure, and whether it may."""
    sure = maybe = False
    for name in value.split():
        words = _NAME.findall(name)
        if words and words[0] in ABOUT_OTHERS:
            continue
        bad = sum(w in BAD_NAMES for w in words)
        others = sum(w not in BAD_NAMES and w not in LAYOUT_NAMES for w in words)
        sure = sure or bad > 0 and bad >= others
        maybe = maybe or bad > 0
    return sure, maybe


def _traits(tag: str, attrs: str, number: int, up: _Element) -> _Element:
    bad, named, hidden, doubtful, named_bad = tag in BAD_TAGS, False, tag in HIDDEN, False, False
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                sure, maybe = _against(value)
                named_bad, doubtful = named_bad or sure, doubtful or maybe
                named = named or not GOOD_NAMES.isdisjoint(_NAME.findall(value))
            elif name == "role":
                bad = bad or value in BAD_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
            elif name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
    # A header inside of an article holds its title, unless it is named otherwise.
    if tag == "header" and up.article and not up.bad:
        bad = False
    # Outermost elements of the text are what they are; an article within an article may be a comment.
    if tag in ("body", "html", "main") or tag == "article" and not up.article and named:
        bad = named_bad = doubtful = False
    return _Element(
        tag, number, up.hidden or hidden, up.bad or bad or named_bad, up.doubtful or doubtful,
        up.article or tag in ("article", "main"),
        up.named or named, up.link or tag == "a",
    )


def blocks(page: str) -> list[Block]:
    """The visible blocks of a page, in order."""
    stack = [_Element("", 0, False, False, False, False, False, False)]
    out: list[Block] = []
    parts: list[str] = []
    linked, number, at, owner = 0, 0, 0, stack[0]

    def end_block():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            path = tuple(e.number for e in stack if e.tag in BLOCK)
            out.append(Block(
                text, path, owner.bad, owner.doubtful, owner.article, owner.named, linked / len(text),
                any(e.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for e in stack),
            ))
        parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked, owner
        top = stack[-1]
        if raw and not top.hidden:
            text = html.unescape(raw)
            if not parts or not owner.bad:
                owner = top
            parts.append(text)
            if top.link:
                linked += len(text.strip())

    def close(tag: str, scope: frozenset = frozenset()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                if any(e.tag in BLOCK for e in stack[i:]):
                    end_block()
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag == "p" or tag == "br":
                end_block() if tag == "p" else parts.append(" ")
            close(tag)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            end_block()
            # A paragraph ends where another block starts; text styles do not cross blocks.
            while stack[-1].tag not in BLOCK and stack[-1].tag and stack[-1].tag != "a" and not stack[-1].hidden:
                stack.pop()
            if stack[-1].tag == "p":
                stack.pop()
        for other in _CLOSES.get(tag, ()):
            close(other, _SCOPES)
        if tag in VOID:
            continue
        number += 1
        element = _traits(tag, m[3], number, stack[-1])
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body, at = (page[at:], len(page)) if end is None else (page[at : end.start()], end.end())
            continue
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.append(element)
    end_block()
    return out


def capacities(block: Block) -> tuple[int, int]:
    """What it costs to call a block content, and to call it boilerplate."""
    words = block.text.count(" ") + 1
    traits = ["plain"]
    traits += ["bad"] * block.bad
    traits += ["doubtful"] * (block.doubtful and not block.bad)
    traits += ["article"] * (block.article and not block.bad)
    traits += ["named_content"] * (block.named and not block.bad)
    traits += ["linked"] * (block.linked > 0.6 and not block.article)
    traits += ["long"] * (words >= 25 and not block.bad) + ["short"] * (words < 4 and not block.article)
    traits += ["heading"] * block.heading
    return sum(COSTS[t][0] for t in traits), sum(COSTS[t][1] for t in traits)


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (i, j, cost of a cut between them). Blocks of unlike standing are not joined: a
    notice in an article is not content because paragraphs surround it."""
    out = []
    for j in range(1, len(found)):
        for i in (j - 1, j - 2):
            if i < 0:
                continue
            a, b = found[i], found[j]
            cost = NEXT_TO if i == j - 1 else 0
            if a.path[:-1] == b.path[:-1]:
                cost += SAME_PARENT
            elif a.path[:-2] == b.path[:-2]:
                cost += CLOSE_PATH
            if a.bad != b.bad:
                cost //= 4
            if cost:
                out.append((i, j, cost))
    return out


def content_side(costs: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The minimum cut: which nodes stay on the side of the content terminal.

    Node i is cut from the content terminal at the cost of calling it boilerplate, and from the
    other at the cost of calling it content. Maximum flow by shortest augmenting paths.
    """
    excess = [b - c for c, b in costs]  # what is left of the terminal edges after direct flow
    room: list[dict[int, int]] = [{} for _ in costs]
    for i, j, c in edges:
        room[i][j] = room[i].get(j, 0) + c
        room[j][i] = room[j].get(i, 0) + c
    sources = [i for i, e in enumerate(excess) if e > 0]
    while True:
        before = {i: -1 for i in sources if excess[i] > 0}
        todo, end = deque(before), -1
        while todo and end < 0:
            i = todo.popleft()
            for j, c in room[i].items():
                if c > 0 and j not in before:
                    before[j] = i
                    if excess[j] < 0:
                        end = j
                        break
                    todo.append(j)
        if end < 0:
            return [i in before for i in range(len(costs))]
        path, i = [], end
        while before[i] >= 0:
            path.append((before[i], i))
            i = before[i]
        flow = min(-excess[end], excess[i], *(room[a][b] for a, b in path))
        excess[i] -= flow
        excess[end] += flow
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = content_side([capacities(b) for b in found], smoothness(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        texts = pa.array([main_text(p) for p in batch.column(last).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:last], texts], [*batch.schema.names[:last], "text"]
        )


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text`` of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(*keep, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_extract, f"{schema}, text string")


@query("op2_html_text")
def _op2(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
