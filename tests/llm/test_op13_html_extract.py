"""Main text of pages with known articles, and of all shipped pages against a plain reading."""

import re
import time
from html import unescape

import pytest

from textloom.llm import op13_html_extract as op

P1 = "The harbour was quiet, the boats were tied up, and nobody spoke for a long while that evening."
P2 = "Later, when the lamps were lit, the keeper came down, counted the ropes, and went home again."
P3 = "A third paragraph, shorter, ends it."
MENU = '<nav><a href="/">Home</a> <a href="/a">About us</a></nav>'
FOOT = "<footer>&copy; 2020 Some Company, all rights reserved, every word of it</footer>"

PAGES = {
    "article": (f"<body>{MENU}<article><h1>T &amp; U</h1><p>{P1}<p>{P2}</article>{FOOT}", f"T & U {P1} {P2}"),
    "div by scores": (
        f'<div id="top"><ul><li><a href="x">One</a><li><a href="y">Two</a></ul></div><div><div><p>{P1}</p><p>{P2}</p>'
        f'<p>{P3}</p></div></div><div><a href="q">More news, and more, and more</a></div>',
        f"{P1} {P2} {P3}",
    ),
    "sections": (
        f'<div class="page"><div class="sidebar"><p>{P1}</p></div><section><p>{P1}</p><p>{P2}</p></section>'
        f'<section><p>{P2}</p></section><div class="ads"><p>Buy, buy, buy, buy, now!</p></div></div>',
        f"{P1} {P2} {P2}",
    ),
    "inside the article": (
        f'<main><article class="post has-sidebar"><header><h1>Title</h1><p class="byline">By A. B.</p></header><p>{P1}</p>'
        f'<div class="ad-slot">Advert, advert</div><aside>Aside</aside><form><label>Mail</label><input></form>'
        f'<blockquote>Quoted <i>wo</i>rds</blockquote><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul>'
        f'<p>{P2}</p><div class="share-buttons"><a href="t">Share</a></div></article><section id="comments">'
        f"<article class='comment'><p>{P1 * 5}</p></article></section></main>",
        f"Title By A. B. {P1} Quoted words a b c x y {P2}",
    ),
    "notices": (
        f'<div id="cookie-banner"><p>We use cookies, you know, and more, and more.</p></div><div role="dialog">{P1}</div>'
        f'<div hidden>{P1}</div><div style="display: none">{P1}</div><div class="content"><p>{P2}</p></div>'
        f'<div class="newsletterSignup"><p>{P1}</p></div><noscript>{P1}</noscript><template><p>{P1}</p></template>',
        P2,
    ),
    "broken": (
        f"<title>x</title><body><div class=main><p><b>{P1}<br><p>{P2}</div></i><p>a < b <3 </ > x<!-- no --><!--> y",
        f"{P1} {P2} a < b <3 x y",
    ),
    "form around all": (f"<form id=f>{MENU}<h1>Head</h1><div><p>{P1}</p><p>{P2}</p></div></form>", None),
    "references": ("<article>&lt;b&gt; caf&eacute;&nbsp;&#8364; &amp &am</article>", "<b> café € & &am"),
    "scripts": (f'<script>var a = "<article><p>{P1}</p></article>";</script><style>p{{}}</style><p>{P3}', P3),
    "attributes": (f"<div class='a>b' title=\"</div>\" data-x=<p>><p>{P1}</div>", f"> {P1}"),
    "white space": ("<article><p> a\n\t b c d </p>\n<p></p><p>e</p></article>", "a b c d e"),
    "plain": ("just words", "just words"),
    "menu only": (f"<body>{MENU}{FOOT}</body>", ""),
    "unclosed": ("<article><p>a<!-- b", "a"),
    "unclosed tag": ("<article><p>a</p><p class='x", "a"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    got = op.main_text(html)
    if want is None:
        assert P1 in got and P2 in got and "About us" not in got
    else:
        assert got == want


@pytest.mark.parametrize(
    "html",
    [
        "<b>" * 200_000 + "x",
        "<div>" * 150_000 + "x" + "</b>" * 150_000,
        "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000,
        "<p" + " a='" * 200_000,
        "<!-- -" * 200_000,
        "<ul><li>" * 60_000 + "word",
        "<header>" * 100_000 + "word",
        '<a b="' * 200_000,
        "<script>" * 200_000,
        "<" * 500_000,
    ],
)
def test_hard_pages_take_linear_time(html):
    start = time.perf_counter()
    op.main_text(html)
    assert time.perf_counter() - start < 20


def test_long_page_is_read_whole():
    words = " ".join(f"w{i}" for i in range(300_000))
    assert op.main_text(f"{MENU}<article><p>{words}</p></article>{FOOT}") == words


def test_table(spark):
    rows = [(1, "u", "<p>a", "z"), (1, "u", "<p>a", "z"), (None, None, None, None), (2, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, op.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert op.extract(pages.limit(0)).collect() == []


def test_shipped_pages(spark, sf):
    blocks = re.compile(r"</?(?:p|h1|br|article|ul|li|div)[^>]*>")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in op.extract(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        marked = re.sub(r"<[^>]*>", lambda m: "\0" if blocks.match(m[0]) else "", inner)
        parts = (" ".join(unescape(b).split()) for b in marked.split("\0"))
        want = " ".join(p for p in parts if p)
        assert got[page.page_id] == (want, len(want))
