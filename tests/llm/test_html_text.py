import itertools
import random

from pyspark.sql import functions as F

from emberlog.llm.html_text import blocks, capacities, content_side, extract, main_text


def cost(keep, costs, edges):
    return (sum(c if k else b for k, (c, b) in zip(keep, costs))
            + sum(w for i, j, w in edges if keep[i] != keep[j]))


def test_cut_is_minimal():
    for seed in range(200):
        rng = random.Random(seed)
        n = rng.randint(1, 9)
        costs = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        least = min(cost(k, costs, edges) for k in itertools.product((False, True), repeat=n))
        assert cost(content_side(costs, edges), costs, edges) == least


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style>
<script>var x = "</p><p>not text</p>";</script></head><body class="page">
<header class="masthead"><a href="/">Home</a><p>The site of all things, with a motto of some length.</p></header>
<nav><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul></nav>
<div class="cookie-notice"><p>We and our partners store cookies on your device, and there are very many of
them, as this long sentence about cookies on your device will make clear to you.</p></div>
<main><article><header><h1>Caf&eacute; &amp; th&#233; &lt;b&gt;</h1></header>
<p>First&nbsp;paragraph with <b>bold</b>,
   a <a href="/x">link</a> and more words.<br>A second line.
<p>Short.
<div class="ad">Buy now! It is cheap, and it is good, and it is here for you to buy today.</div>
<ul><li>one<li>two</ul><blockquote>Quoted words.</blockquote><!-- hidden <p>x</p> -->
<form><p>Name</p><input name=a><button>Send</button></form>
<table><tr><td>cell 1<td>cell 2</table>
<p>Last paragraph.</p></article>
<section id="comments"><h2>Comments</h2><p>First! A reader of this page wrote a rather long comment here.</p></section></main>
<aside><p>Related: some other story that is told elsewhere at great length and in detail.</p></aside>
<footer>&copy; 2024</footer></body></html>"""


def test_an_article_among_boilerplate():
    assert main_text(PAGE).split("\n\n") == [
        "Café & thé <b>", "First paragraph with bold, a link and more words. A second line.", "Short.", "one", "two",
        "Quoted words.", "cell 1", "cell 2", "Last paragraph.",
    ]


def test_pages_without_an_article_element():
    body = "".join(f"<p>Paragraph {i} has quite a few words in it, enough to be read as text of the page "
                   f"by anyone who looks at it, and then some more words.</p>" for i in range(4))
    page = (f"<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div id=story>{body}<p>Tiny one.</p>{body}</div>"
            "<div class='sidebar'><p>See other things of interest to readers of this page and of others too.</p></div>")
    out = main_text(page).split("\n\n")
    assert len(out) == 9 and out[4] == "Tiny one."


def test_awkward_pages(spark):
    long = "<article>" + "<p>word " * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain < text & more"), (4, "u", "<p>a<p>b</article></p>"),
            (5, "u", "<article><p>x</p>"), (5, "u", "<article><p>x</p>"), (6, "u", "<script>never closed <p>x"),
            (7, "u", long), (8, "u", "<" * 50_000), (9, "u", "<a " * 3000), (None, "u", "<article>é&#x1F600;&bogus;</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = extract(df)
    assert out.columns == ["page_id", "url", "text"]
    got = {}
    for r in out.collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert sum(map(len, got.values())) == len(rows)
    assert got[1] == got[2] == got[6] == [""]
    assert got[5] == ["x", "x"]
    assert got[7] == ["\n\n".join(["word"] * 20_000)]
    assert got[None] == ["é😀&bogus;"]
    assert extract(df.limit(0)).count() == 0


def test_links_are_counted():
    (nav, text) = blocks("<p><a href=x>All of it</a></p><p>Some <a href=x>of</a> it</p>")
    assert nav.linked == 1.0 and text.linked < 0.5


LONG = ("This paragraph has quite a few words in it, enough to be read as text of the page by anyone at all who "
        "comes by and looks at it for a while.")
LAYOUTS = (
    # (page, blocks of its text)
    (f'<div class="layout with-sidebar"><article><p>{LONG}</article></div>', [LONG]),
    (f'<article><section class="search-results-study"><p>{LONG}<p>Short.</section></article>', [LONG, "Short."]),
    (f'<article><p>{LONG}<div class="cookie-notice">{LONG}</div><p>End.</article>', [LONG, "End."]),
    (f'<article><p>{LONG}<article class="comment"><p>{LONG}</article></article>', [LONG]),
    (f'<article class="post no-comments"><p>{LONG}</article><article class="ad"><p>{LONG}</article>', [LONG]),
    (f'<div id="site-footer"><p>{LONG}</div><main><p>{LONG}<p>x</main>', [LONG, "x"]),
    (f'<body class="search"><div role="navigation">{LONG}</div><article><h1>T</h1><p>{LONG}</article>', ["T", LONG]),
    (f'<div id=c1><p>{LONG}<p>Tiny one.<p>{LONG}</div>', [LONG, "Tiny one.", LONG]),
    (f'<div id=c1><p>{LONG}<p class="tags-of-old-towns">{LONG}<p>{LONG}</div>', [LONG] * 3),
)


def test_layouts():
    for page, want in LAYOUTS:
        assert main_text(page).split("\n\n") == want, page


def test_edges_decide_where_blocks_alone_are_wrong():
    changed = 0
    for page, want in LAYOUTS:
        found = blocks(page)
        alone = content_side([capacities(b) for b in found], [])
        changed += [b.text for b, k in zip(found, alone) if k] != want
    assert changed == 2
