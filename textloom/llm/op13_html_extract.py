"""Main text of web pages by tree scoring.

A page is read into a tree of elements. Parts that are never an article go at once: scripts, styles,
forms, menus, footers, sidebars, what is hidden, and what its class, id or role calls an advert, a
notice, comments or the like. Every paragraph (a block with words of its own) earns points for its
length and its commas. It passes them to its ancestors, the more distant the fewer, and an ancestor's
points are discounted by its link density, the share of its text that is links. The container with the
most points is the article; siblings that score well against it, or are plain paragraphs of running
text, belong to it too.

The text is that of the container: blocks in page order, white space inside a block as one space,
blocks joined by one space. Nothing of it is cut off, and pages are read whole. A page is read by one
scan that never looks back, so long, deep and broken pages take time in proportion to their length.
Rows are independent: no shuffle.

Defined results: null and empty pages, and pages without text, give the empty string; ids may be null
or repeat, rows come back as often as they are there; an empty table gives an empty result; further
columns do not matter. White space is what Unicode calls so (no-break spaces too).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Possessive throughout: each character is looked at once, whatever the page holds. An end tag, a start
# tag, or what browsers take for a comment.
TOKEN = re.compile(
    r"<[!?][^>]*+>?+|</(?:>|[^a-zA-Z>][^>]*+>?+)"
    r"|<(?P<end>/?+)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+|=)*+)"
    r"(?:>|\Z)"
)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s>]++)))?+")

# Elements, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre"
    " search section summary table tbody td tfoot th thead tr ul caption option optgroup select".split()
)
# What an opening tag closes by itself, and the elements that such a closing does not reach over.
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup".split())
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
BARRIER = "table ul ol dl td th div section article main body html blockquote select".split()

# Never part of an article.
DROPPED = frozenset(
    "script style template textarea title head iframe object embed noembed noframes noscript svg canvas"
    " audio video map form button input select fieldset label nav footer aside menu dialog search".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar"
    " toolbar tablist".split()
)
# Names in classes and ids. A name says something by itself, or by its parts (``site-nav``, ``adBox``).
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements comment comments cookie cookies nav navbar"
    " navigation menu footer sidebar banner newsletter breadcrumb breadcrumbs share sharing social"
    " related promo popup modal hidden disqus site-header page-header main-header top-header"
    " global-header header".split()
)
WHOLE = frozenset(
    "side foot alert alerts register legal disclaimer popular print tags feed feeds rss reply replies"
    " review reviews metadata rail".split()
)
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors"
    " sponsorship promo promos promotion promotions promoted banner banners cookie cookies consent gdpr"
    " notice notices newsletter newsletters subscribe subscription signup login paywall popup popups"
    " modal modals overlay toast nav navi navbar navigation menu menus breadcrumb breadcrumbs pagination"
    " pager sidebar sidebars widget widgets footer footers masthead topbar toolbar comment comments"
    " commentlist disqus respond share sharing social related recommended recommendation"
    " recommendations teaser teasers trending outbrain taboola copyright tagcloud skip".split()
)
LIKELY = frozenset("article articlebody body content entry main page post story text blog hentry".split())
# Names that only say what else is on the page.
ABOUT = frozenset("has with no without is".split())
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
ARTICLE = frozenset(["article", "main"])
PARAGRAPH = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())

ARTICLE_POINTS = 25.0
LIKELY_POINTS = 10.0
LINK_LIMIT = 0.5
# How many ancestors share a paragraph's points; the share falls with the distance.
REACH = 5


def named(names: str) -> tuple[bool, bool]:
    """What classes and ids say: part of the article, not part of it."""
    likely = unlikely = strong = False
    for name in names.split():
        name = HUMP.sub("-", name).lower().replace("_", "-").strip("-")
        parts = name.split("-")
        if parts[0] in ABOUT:
            continue
        if name in STRONG:
            strong = True
        elif name in WHOLE or not PARTS.isdisjoint(parts):
            unlikely = True
        elif not LIKELY.isdisjoint(parts):
            likely = True
    return likely, strong or (unlikely and not likely)


class Element:
    """An element with its children (elements and texts) in order."""

    __slots__ = ("tag", "parent", "children", "likely", "gone", "article", "inside", "link", "points", "chars", "linked")

    def __init__(self, tag: str, parent: Element | None, attrs: dict[str, str]):
        self.tag, self.parent, self.children = tag, parent, []
        role = attrs.get("role", "").lower()
        self.article = tag in ARTICLE or role in ARTICLE or attrs.get("itemprop") == "articleBody"
        # A page's own header goes; the header of an article is part of it.
        self.inside = parent is not None and (parent.inside or parent.article)
        self.likely, unlikely = named(f"{attrs.get('class', '')} {attrs.get('id', '')}")
        if tag == "header" and self.inside:
            unlikely = False
        self.gone = tag not in ("html", "body") and (
            unlikely
            or tag in DROPPED
            or role in ROLES
            or (tag == "header" and not self.inside)
            or "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
            or bool(HIDDEN.search(attrs.get("style", "").lower()))
        )
        self.link = tag == "a" and "href" in attrs
        self.points, self.chars, self.linked = 0.0, 0, 0


class Open:
    """The elements that are open, innermost last, and where those of a kind stand."""

    def __init__(self, root: Element):
        self.elements = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.elements))
        if element.tag in BLOCK:
            self.blocks.append(len(self.elements))
        self.elements.append(element)

    def close(self, upto: int) -> None:
        while len(self.elements) > upto:
            tag = self.elements.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close_inside(self, tags, barrier) -> None:
        """Closes the innermost of ``tags``, unless a barrier stands inside it."""
        at = self.last(tags)
        if at > 0 and at > self.last(barrier):
            self.close(at)


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def parse(html: str) -> Element:
    """Tree of a page. Unclosed and misnested tags are closed as browsers close them, by and large."""
    root = Element("html", None, {})
    open_ = Open(root)
    at = 0

    def said(text: str) -> None:
        if text:
            open_.elements[-1].children.append(unescape(text))

    while at < len(html):
        lt = html.find("<", at)
        said(html[at : lt if lt >= 0 else len(html)])
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            short = re.compile(r"-?>").match(html, lt + 4)
            end = short.end() if short else html.find("-->", lt + 4) + 3
            at = end if end > 2 else len(html)
            continue
        token = TOKEN.match(html, lt)
        at = token.end() if token else lt + 1
        if token is None:  # a lone sign
            said("<")
            continue
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            said(" ")
        elif token["end"]:
            place = open_.last((tag,))
            # An inline end does not close the block it stands in.
            if place > 0 and (tag in BLOCK or place > open_.blocks[-1]):
                open_.close(place)
        elif tag in ("html", "body"):
            if tag == "body" and not open_.places.get("body"):
                open_.close(1)  # a head that was not closed
                open_.push(element := Element(tag, root, {}))
                root.children.append(element)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
        else:
            if tag in ENDS_P:
                open_.close_inside(("p",), BARRIER)
            if tag in CLOSES:
                barrier = [t for t in BARRIER if t not in CLOSES[tag]]
                # A row closes its cell, then the row.
                for _ in range(2 if tag == "tr" else 1):
                    open_.close_inside(CLOSES[tag], barrier)
            if tag == "hr":
                said(" ")
            attrs = attributes(token["attrs"]) if token["attrs"] else {}
            parent = open_.elements[-1]
            element = Element(tag, parent, attrs)
            parent.children.append(element)
            if tag in ("article", "main", "h1"):
                # A form around the whole page is no form.
                for place in open_.places.get("form", [])[:1]:
                    open_.elements[place].gone = False
            if tag not in VOID:
                open_.push(element)
    return root


def _in_order(root: Element) -> list[Element]:
    """Elements that are not gone, parents first."""
    listed = [root]
    for element in listed:
        listed.extend(c for c in element.children if isinstance(c, Element) and not c.gone)
    return listed


def _measure(listed: list[Element]) -> None:
    """Characters and linked characters of every element, points of every container."""
    for element in reversed(listed):
        own = " ".join("".join(c for c in element.children if isinstance(c, str)).split())
        element.chars += len(own)
        if element.link:
            element.linked = element.chars
        up = element.parent
        if up is not None:
            up.chars += element.chars
            up.linked += element.linked
        if own and (element.tag in PARAGRAPH or element.tag in BLOCK):
            # The words of inline children count: they are in chars by now.
            inline = sum(
                c.chars - c.linked
                for c in element.children
                if isinstance(c, Element) and c.tag not in BLOCK and not c.gone
            )
            points = 1 + own.count(",") + (len(own) + inline) / 100
            share, level = up if element.tag in PARAGRAPH else element, 1
            while share is not None and level <= REACH:
                share.points += points / level
                share, level = share.parent, level + 1


def _density(element: Element) -> float:
    return element.linked / element.chars if element.chars else 0.0


def _score(element: Element) -> float:
    points = element.points * (1 - _density(element))
    if element.article:
        points += ARTICLE_POINTS
    return points + (LIKELY_POINTS if element.likely and element.chars else 0.0)


def _chosen(listed: list[Element]) -> list[Element]:
    """The best container, and the siblings that belong to it, in page order."""
    best = max(listed, key=_score)
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    if up is not None:  # all of the article that the container stands in
        return [up]
    up = best.parent
    if up is None or best.article:
        return [best]
    least = max(5.0, _score(best) * 0.2)
    out = []
    for child in up.children:
        if child is best:
            out.append(child)
        elif isinstance(child, Element) and not child.gone and _density(child) < LINK_LIMIT:
            running = child.tag in PARAGRAPH and child.chars > 0 and _density(child) < 0.25
            if running or _score(child) >= least:
                out.append(child)
    return out


def _blocks(chosen: list[Element]) -> Iterator[str]:
    """Texts of blocks in page order."""
    pieces: list[str] = []
    todo: list[Element | str | None] = list(reversed(chosen))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            pieces.append(node)
            continue
        if node is None or node.tag in BLOCK:
            yield "".join(pieces)
            pieces = []
        if node is None or node.gone:
            continue
        # Lists and tables of nothing but links are menus, wherever they stand.
        if node.tag in ("ul", "ol", "dl", "table") and node.chars and _density(node) > 0.8:
            continue
        if node.tag in BLOCK:
            todo.append(None)
        todo.extend(reversed(node.children))
    yield "".join(pieces)


def main_text(html: str | None) -> str:
    """The article of a page; the empty string if there is none."""
    if not html:
        return ""
    listed = _in_order(parse(html))
    _measure(listed)
    cleaned = (" ".join(block.split()) for block in _blocks(_chosen(listed)))
    return " ".join(block for block in cleaned if block)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
