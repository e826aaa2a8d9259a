"""Main text of web pages by composite text density.

Each page becomes a tree of nodes. A node's density is its characters per tag, adjusted
for links: with C characters, T tags, LC characters inside links, LT links, and the
body's share of link characters as base,

    density = C/T * log_b(C*T / (LC*LT)),   b = ln(C/notLC*LC + LCb/Cb*C + e)

A node's score is the sum of its children's densities. The least density on the path from
the node with the largest score to ``body`` is the threshold: of every container reached
from ``body`` (whose own density counts, too) through nodes at least that dense, the subtree with the largest score is
kept, in page order. If the largest score lies in an article or main element, that element
is kept alone and whole. A list of links less dense than the threshold, directly in what is
kept, is left out.

Before that, nodes that never hold article text go: fixed tags (scripts, forms, menus, headers and footers outside an article, ...) and
elements whose class, id or role names such a part. Where the name may as well be a topic
(``related-work``, ``entry-header``), in an article or main element and for headings, links
must hold most of the element's characters, or a form control come on every
``FORM_CHARS`` of them; ids of headings say nothing.

Defined results: a null or empty page gives an empty text; broken or unclosed markup is
closed at the end of the page; character references are decoded; white space in a block
becomes one space; blocks are joined by one space in page order. Pages are taken one by
one in the tasks that read them, so ties, repeated rows and hot hosts need no care.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.llm.text import slices

# HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("table ul ol dl div article section aside main body html td th nav blockquote form header footer button select fieldset dialog menu object applet canvas audio video".split())
IN_HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes script style template".split())
DROPPED = frozenset("head nav aside form button select option input datalist fieldset dialog menu footer canvas object applet audio video".split()) | RAW
PARTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|advertising|adbox|banner|sponsor|sponsored|promo|promotion|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|"
    r"header|masthead|footer|cookie|cookies|consent|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|"
    r"comment|comments|respond|disqus|discussion|widget|toolbar|pagination|pager|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
# Of these words, the ones that also stand in names of article text; ids are often made from titles.
TOPICS = "header discussion related legal search social notice notices".split()
ID_TOPICS = [*TOPICS, *"advertising promotion navigation consent cookie cookies copyright disclaimer share sharing recommended login menu banner overlay modal sponsor".split()]
_WORDS = PARTS.pattern.split("(?:", 2)[2].split(")")[0].split("|")
_SURE = {name: re.compile(PARTS.pattern.replace("|".join(_WORDS), "|".join(w for w in _WORDS if w not in topics)), re.I) for name, topics in (("class", TOPICS), ("id", ID_TOPICS))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("input select textarea button".split())
FORM_CHARS = 80
KEPT, DOUBTFUL, PART = range(3)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMING = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WHITE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "items", "chars", "tags", "link_chars", "links", "density", "score", "parent", "best", "part", "in_article", "in_main", "doubt", "controls")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.part, self.controls = tag, parent, KEPT, 0
        self.in_article = tag == "article" or (parent is not None and parent.in_article)
        self.in_main = tag in ("article", "main") or (parent is not None and parent.in_main)
        self.doubt = parent.doubt if parent is not None else None  # the doubtful element it is in
        self.items: list[_Node | str] = []


def _part(tag: str, attributes: str, parent: _Node) -> int:
    """Whether an element is a part of the page that is not the article, by its tag and names."""
    if tag in DROPPED or (tag == "header" and not parent.in_article):
        return PART
    found = KEPT
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    for m in _NAMING.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id") and PARTS.search(value):
            if tag in HEADINGS:
                found = DOUBTFUL if name == "class" else found
            elif not (parent.in_main or tag in ("section", "p")) or _SURE[name].search(value):
                return PART
            else:
                found = DOUBTFUL
        if name == "role" and value.lower() in ROLES:
            return PART
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return PART
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return PART
    return found


def _tree(page: str) -> _Node:
    """The page's nodes. Parts that never hold article text are opened and closed like all
    others, but hang in no other node's items, so nothing measures or reads them."""
    root = node = _Node("html", None)
    at, low = 0, None
    for m in iter(_TOKEN.scanner(page).search, None):
        if m.start() < at:
            continue
        if m.start() > at:
            if node.tag == "head" and not page[at : m.start()].isspace():
                node = node.parent
            node.items.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            up = node
            while up is not root and up.tag != tag:
                # The end of an inline element leaves a part that began inside it open.
                up = root if tag in INLINE and up.part and up.tag not in INLINE else up.parent
            if up is not root:
                node = up.parent
            elif tag == "html":
                node = root
            elif tag == "p":
                node.items.append(_Node("br", node))
            continue
        if tag in CONTROLS and node.doubt is not None and "hidden" not in attributes.lower():
            node.doubt.controls += 1
        if tag in RAW and not attributes.rstrip().endswith("/"):
            # Raw text goes up to its own end tag, whatever stands in it.
            low = low or page.lower()
            end = low.find(f"</{tag}", at)
            if end >= 0:
                at = low.find(">", end) + 1 or len(page)
            elif tag in ("script", "style", "textarea", "title"):
                at = len(page)
            continue
        if node.tag == "head" and tag not in IN_HEAD:
            node = node.parent
        if tag in CLOSES_P or tag in CLOSED_BY:
            ends = CLOSED_BY.get(tag) or {"p"}
            up = node
            while up is not root and up.tag not in ends and up.tag not in SCOPE:
                up = up.parent
            while up is not root and up.tag in ends:
                node = up.parent
                up = node
        if tag in VOID:
            node.items.append(_Node(tag, node))
        elif tag != "html":
            child = _Node(tag, node)
            child.part = _part(tag, attributes, node)
            if child.part == DOUBTFUL:
                child.doubt = child
            if child.part != PART:
                node.items.append(child)
            node = child
    if at < len(page):
        if node.tag == "head" and not page[at:].isspace():
            node = node.parent
        node.items.append(page[at:])
    return root


def _measure(root: _Node) -> None:
    """Characters, tags and links of every node, children first, without recursion.
    Doubtful parts of links or form controls are taken out."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.items if isinstance(c, _Node)]
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.links = 0
        parts = False
        for c in n.items:
            if isinstance(c, str):
                n.chars += len(c) - c.count(" ")
            elif c.part == PART:
                parts = True
            else:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.links += c.links
        if n.tag == "a":
            n.link_chars, n.links = n.chars, n.links + 1
        if parts:
            n.items = [c for c in n.items if isinstance(c, str) or c.part != PART]
        if n.part == DOUBTFUL and (n.link_chars * 2 > n.chars or n.chars < FORM_CHARS * n.controls):
            n.part = PART
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in reversed(order):
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, max(n.links, 1)
        if c:
            plain = max(c - lc, 1)
            base = log(c / plain * lc + share * c + e)
            value = c / t * (c * t) / (max(lc, 1) * lt)
            n.density = c / t * (log(max(value, 1.0)) / log(max(base, 1.0 + 1e-9)) if base > 1.0 else log(max(value, 1.0)))
        else:
            n.density = 0.0
        below = [x for x in n.items if isinstance(x, _Node)]
        n.score = sum(x.density for x in below)
        # The largest sum of child densities in the subtree; ties go to the first in the page.
        n.best = max([n, *[x.best for x in below]], key=lambda x: x.score)


def _kept(root: _Node, threshold: float) -> list[_Node]:
    """The best subtree of every container reached through dense ones, in page order, none inside another."""
    marked, stack = set(), [root]
    while stack:
        n = stack.pop()
        if n is root or n.density >= threshold:
            marked.add(n.best)
            stack += [c for c in n.items if isinstance(c, _Node)]
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n in marked:
            out.append(n)
        else:
            stack += [c for c in reversed(n.items) if isinstance(c, _Node)]
    return out


def _blocks(node: _Node, threshold: float) -> list[str]:
    """Text blocks of a subtree, in page order. A child that is a block of links only,
    or a container less dense than the threshold, is left out."""
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        block = _WHITE.sub(" ", unescape("".join(text)).replace("\x00", "�")).strip()
        text.clear()
        if block:
            out.append(block)

    stack: list[tuple[_Node, int]] = [(node, 0)]
    while stack:
        n, i = stack.pop()
        while i < len(n.items):
            c = n.items[i]
            i += 1
            if isinstance(c, str):
                text.append(c)
            elif c.tag == "br":
                text.append("\n")
            elif n is node and _is_sparse(c, threshold):
                flush()
            else:
                stack.append((n, i))
                if c.tag not in INLINE:
                    flush()
                n, i = c, 0
        if n.tag not in INLINE:
            flush()
    flush()
    return out


def _is_sparse(n: _Node, threshold: float) -> bool:
    """A container of links: less dense than anything on the path to the body, and mostly links."""
    return n.tag in ("div", "section", "ul", "ol", "table", "dl") and n.density < threshold and n.links > 1 and n.link_chars * 2 > n.chars


def main_text(page: str | None) -> str:
    """The article's text; empty for a null or empty page."""
    if not page:
        return ""
    root = _tree(page)
    _measure(root)
    best = root.best
    # Its last ancestor that is an article or main element, and is no mere list of teasers, keeps the whole article together.
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    threshold, up = best.density, best
    while up is not None and up.tag != "body":
        threshold = min(threshold, up.density)
        up = up.parent
    kept = [best] if best.tag in ("article", "main") else _kept(root, min(threshold, up.density) if up is not None else threshold)
    return " ".join(block for n in kept for block in _blocks(n, threshold))


def extract_text(df: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df``, ``text`` and ``n_chars``; one narrow pass, no shuffle."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True))
    out = rows.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "text", "n_chars")
