"""The main text of web pages by scoring the tree of the page.

Paragraphs earn points for their length and their commas and pass them to their ancestors, ever
less with the distance; what a container has earned is discounted by the share of its text that is
links. The best container is kept with those siblings that read like text, without the menus,
forms, notices, adverts and comments inside them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import whole_text

# Kinds of elements.
RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|object|canvas|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td tfoot th thead tr ul br".split()
)
CLOSED_BY = {
    "p": BLOCKS - {"br"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
}
CLOSES = {t: [x for x, by in CLOSED_BY.items() if t in by] for t in frozenset().union(*CLOSED_BY.values())}
FENCES = frozenset("table ul ol dl menu body article section main div td th blockquote".split())
JUNK_TAGS = frozenset("nav footer aside form button select menu dialog head label input".split())
JUNK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer foot cookie cookies "
    "consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended comment comments reply replies disqus "
    "widget pager pagination toolbar masthead topbar skip disclaimer".split()
)
#: what a name of junk words can hold besides (``cookie-notice``, ``ad-slot-3``, ``share-buttons``)
JUNK_PARTS = frozenset(
    "area bar block body bottom box button buttons container content header inner item items left link links "
    "list main page panel posts primary right section site slot top unit wrap wrapper [0-9]+".split()
)
IN_TEXT = frozenset(("button", "label"))  # words of a sentence, where they stand in a paragraph
MAIN_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset("article main section div td body blockquote figure center".split())

#: names of reader comments, in a class or an id (``comments``, ``commentlist``, ``user-comments``)
COMMENT_NAME = re.compile(
    r"(?:[a-z0-9]+[-_])*comments?(?:[-_]?(?:list|area|section|thread|box|feed|block|wrap|wrapper|container|[0-9]+))?"
)

_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
_QUOTE = re.compile(r""">|=\s*["']""")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ATTRIBUTES = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_JUNK_NAME = re.compile(rf"(?:(?:{'|'.join(sorted(JUNK_PARTS))})[-_]+)*(?:{'|'.join(sorted(JUNK_WORDS))})(?:[-_]+(?:{'|'.join(sorted(JUNK_WORDS | JUNK_PARTS))}))*")


class Node:
    __slots__ = ("children", "chars", "commas", "junk", "link_chars", "named", "order", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, order: int, junk: bool, named: bool = False) -> None:
        self.tag, self.parent, self.order, self.junk, self.named = tag, parent, order, junk, named
        self.children: list[Node | str] = []
        self.chars = self.commas = self.link_chars = 0
        self.score = 0.0


def _kind(tag: str, attrs: str, inside_main: bool, in_text: bool) -> tuple[bool, bool]:
    """Whether an element is junk by its tag or hidden, and whether its names are names of junk."""
    if tag in JUNK_TAGS and not in_text or tag == "header" and not inside_main:
        return True, False
    if not attrs or tag in ("html", "body"):
        return False, False
    junk = named = False
    for m in _ATTRIBUTES.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            junk |= value != "false"
        elif name == "aria-hidden":
            junk |= value.strip() == "true"
        elif name == "style":
            junk |= bool(_NO_DISPLAY.search(value))
        elif name in ("class", "role") and tag not in MAIN_TAGS and tag not in HEADINGS:
            named |= any(_JUNK_NAME.fullmatch(x) or COMMENT_NAME.fullmatch(x) for x in value.split())
        elif name == "id" and tag not in MAIN_TAGS and tag not in HEADINGS:
            named |= COMMENT_NAME.fullmatch(value.strip()) is not None
    return junk, named


def _spare_wrappers(nodes: list[Node]) -> None:
    """Elements named like junk are junk, but for those that hold the article.

    On a page without an article element that is whatever holds most of the paragraphs.
    """
    points, mains = [0.0] * len(nodes), [False] * len(nodes)
    dead = [False] * len(nodes)
    for n in nodes[1:]:
        dead[n.order] = n.junk or dead[n.parent.order]
    inside = [False] * len(nodes)
    for n in nodes[1:]:  # a paragraph in a link list or a form earns nothing
        inside[n.order] = n.tag in ("p", "pre") or inside[n.parent.order]
    for n in reversed(nodes):
        if dead[n.order]:
            continue
        if inside[n.order]:
            points[n.order] += sum(len(c.strip()) for c in n.children if isinstance(c, str))
        if n.parent is not None:
            points[n.parent.order] += points[n.order]
            mains[n.parent.order] |= mains[n.order] or n.tag in MAIN_TAGS
    for n in nodes[1:]:
        if n.named and not mains[n.order] and (mains[0] or 2 * points[n.order] <= points[0]):
            n.junk = True


def _tag_end(page: str, at: int) -> int:
    """Behind the ``>`` of a tag; one inside a quoted value doesn't count. -1 if there is none."""
    while m := _QUOTE.search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(m[0][-1], m.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """``(start, end, tag, closing, attributes)`` of all markup in one pass; no tag for what is skipped whole.

    Where quotes never let a tag end, no quote of the page counts from there on, so that no
    part of a broken page is read again and again. Markup without any end goes as far as the page.
    """
    at, quotes = 0, True
    while m := _OPEN.search(page, at):
        start, tag = m.start(), m["tag"]
        if tag is None:
            mark = "-->" if m["comment"] else ">"
            close = page.find(mark, m.end())
            at = len(page) if close < 0 else close + len(mark)
            yield start, at, None, False, ""
            continue
        at = _tag_end(page, m.end()) if quotes else -1
        if at < 0:
            quotes = False
            at = page.find(">", m.end()) + 1 or len(page)
        tag, closing = tag.lower(), m["end"] == "/"
        attrs = page[m.end() : at - 1] if page[at - 1] == ">" else page[m.end() : at]
        if tag in _RAW_ENDS and not closing:
            if not (tag in ("svg", "math") and attrs.endswith("/")):
                close = _RAW_ENDS[tag].search(page, at)
                at = close.end() if close else len(page)
            yield start, at, None, False, ""
        else:
            yield start, at, tag, closing, attrs


def parse(page: str) -> list[Node]:
    """All elements in page order; the first is the root. Broken markup is closed as browsers do."""
    root = Node("html", None, 0, False)
    nodes, open_ = [root], [root]
    mains = at = 0
    counts: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for in vain

    blocks: list[int] = []  # places of the open block elements

    def close(k: int) -> None:
        nonlocal mains
        while blocks and blocks[-1] >= k:
            blocks.pop()
        for n in open_[k:]:
            counts[n.tag] -= 1
            mains -= n.tag in MAIN_TAGS
        del open_[k:]

    for start, end, tag, closing, attrs in tokens(page):
        if start > at:
            open_[-1].children.append(entities.unescape(page[at:start]))
        at = end
        if tag is None:
            continue
        if closing:
            for k in range(len(open_) - 1 if counts[tag] else 0, 0, -1):
                if open_[k].tag == tag:
                    close(k)
                    break
                if open_[k].tag in MAIN_TAGS and tag not in MAIN_TAGS and tag not in ("body", "html"):
                    break  # a stray end tag doesn't close the article
            continue
        if tag == "html":
            continue
        closable = any(counts[x] for x in CLOSES.get(tag, ()))
        for k in range(len(open_) - 1 if closable else 0, 0, -1):  # elements that this one closes
            if tag in CLOSED_BY.get(open_[k].tag, ()):
                close(k)
                break
            if open_[k].tag in FENCES:
                break
        parent = open_[-1]
        in_paragraph = bool(blocks) and open_[blocks[-1]].tag == "p" and not counts["form"]
        node = Node(tag, parent, len(nodes), *_kind(tag, attrs, mains > 0, tag in IN_TEXT and in_paragraph))
        parent.children.append(node)
        nodes.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            if tag in BLOCKS:
                blocks.append(len(open_))
            open_.append(node)
            counts[tag] += 1
            mains += tag in MAIN_TAGS
    if at < len(page):
        open_[-1].children.append(entities.unescape(page[at:]))
    _spare_wrappers(nodes)
    return nodes


def _has_paragraph(top: Node, dead: list[bool]) -> bool:
    """Whether a paragraph with text stands somewhere below the element."""
    stack = [top]
    while stack:
        n = stack.pop()
        if n.tag == "p" and n.chars:
            return True
        stack.extend(c for c in n.children if not isinstance(c, str) and not dead[c.order])
    return False


def best_container(nodes: list[Node]) -> tuple[Node, list[Node]]:
    """The container with the highest score, and its siblings that are kept with it."""
    dead = [False] * len(nodes)
    for n in nodes[1:]:  # parents come before children
        dead[n.order] = n.junk or dead[n.parent.order]
    for n in reversed(nodes):
        if dead[n.order]:
            continue
        own = [c for c in n.children if isinstance(c, str)]
        n.chars += sum(len(" ".join(c.split())) for c in own)
        n.commas += sum(c.count(",") for c in own)
        if n.tag == "a":
            n.link_chars = n.chars
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.commas += n.commas
            n.parent.link_chars += n.link_chars
    for n in nodes:
        if dead[n.order] or n.tag not in ("p", "pre", "td", "li", "blockquote", "div", "article", "main", "section"):
            continue
        if n.tag == "p" or n.tag == "pre":
            chars, commas = n.chars, n.commas
        else:  # text directly inside, or in inline elements
            inline = [c for c in n.children if isinstance(c, str) or c.tag not in BLOCKS and not dead[c.order]]
            chars = sum(len(" ".join(c.split())) if isinstance(c, str) else c.chars for c in inline)
            commas = sum(c.count(",") if isinstance(c, str) else c.commas for c in inline)
        if not chars:
            continue
        points, share, up = 1 + commas + min(chars / 100, 3), 1.0, n if n.tag in CONTAINERS else n.parent
        while up is not None and share > 0.05:
            up.score += points * share
            share, up = share / 2, up.parent
    alive = [n for n in nodes if not dead[n.order] and n.chars and (n.tag in CONTAINERS or n is nodes[0])]
    if not alive:
        return nodes[0], []

    def value(n: Node) -> float:
        bonus = 25 if n.tag in MAIN_TAGS else 0
        return (n.score + bonus) * (1 - n.link_chars / n.chars)

    best = max(alive, key=lambda n: (value(n), -n.order))
    up = best.parent
    while up is not None:  # a part of an article stands for the article
        if up.tag in MAIN_TAGS:
            best = up
        up = up.parent
    least, kept = max(10.0, 0.2 * value(best)), []
    if best.parent is not None and best.tag not in MAIN_TAGS:
        for c in best.parent.children:
            if isinstance(c, str) or c is best or dead[c.order] or not c.chars:
                continue
            links = c.link_chars / c.chars
            text = c.tag in ("p", "pre", "h1", "h2", "h3", "blockquote", "ul", "ol", "table")
            if c.tag in CONTAINERS and (value(c) >= least or links < 0.25 and _has_paragraph(c, dead)) or text and links < 0.25:
                kept.append(c)
    return best, sorted(kept, key=lambda n: n.order)


def blocks_of(top: Node) -> list[str]:
    """The text blocks below an element in page order, without junk elements."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(parts).split()):
            blocks.append(text)
        parts.clear()

    stack: list[Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.junk or x is top:
            block = x.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return blocks


def main_text(page: str) -> str:
    """The text of the page's article: its blocks, joined by one space."""
    if not page:
        return ""
    best, siblings = best_container(parse(page))
    tops = sorted([best, *siblings], key=lambda n: n.order)
    return " ".join(b for top in tops for b in blocks_of(top))


def extract_main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All rows and columns and ``text``: the main text, empty if the page has none or is null.

    A column named like ``text`` is replaced. Repeated rows stay; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text)

    return df.withColumn(text, extract(whole_text(html)))
