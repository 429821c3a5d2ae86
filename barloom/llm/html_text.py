"""Main text of web pages.

The standard library's streaming parser turns a page into lines: the text
between two block-level tags, with the number of tags met inside it.  A line's
text-to-tag ratio is its length by that number.  The ratios are smoothed along
the page with a Gaussian; markup that names itself as something else (adverts,
comments, sharing, side columns ...) lowers them, the more so outside article
and main elements.  The threshold is a share of the mean ratio of the page's
text; lines above it form the content cluster.  Elements that never hold
article text (navigation, forms, scripts ...) are left out before.

The content region is the deepest element that holds the cluster and the main
heading; where article or main elements hold any of the cluster, it is those.
Lines of the region are kept, short ones too, but for lines in markup of that
kind that the threshold leaves outside the cluster.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
ASIDE = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu "
    "title datalist audio video map".split())
#: Elements that say that they hold the page's content.
NAMED = frozenset(("article", "main"))
#: Words of class, id and role that mark other content (fixed values): by themselves or as a part of a name.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter pagination popup promo "
    "promoted replies respond sidebar signup sponsor sponsored subscribe toolbar widget".split())
#: Words that do so only if nothing else in the name says otherwise.
HINTS = frozenset("notice notices related reply search share sharing social".split())
#: Words of page layout: a hint that text stands beside the article.
LAYOUT = frozenset("aux col column extra left rail right side".split())
#: Words that say nothing.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons container content form group holder inner item items link links list "
    "main outer page panel post section site slot text thread top unit wrap wrapper".split())
#: What remains of a ratio: inside article or main, outside.
MARKED, HINTED, PLACED = (0.05, 0.02), (0.5, 0.05), (0.5, 0.2)
#: The threshold, as a share of the page's mean ratio.
CUT = 0.25
_TOKEN = re.compile(r"[a-z0-9]+")
_OPEN = re.compile(r"</?[a-zA-Z!]")


class _Lines(HTMLParser):
    """Lines of a page and the tree of its elements, numbered as they open; every step takes constant time."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # open elements: tag, number
        self.at: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
        self.blocks: list[int] = []  # of block-level ones
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.end: list[int] = []  # number behind the last element inside
        self.aside: list[bool] = []  # never article text
        self.share: list[float] = []  # what markup leaves of ratios inside
        self.linked: list[bool] = []  # a link or inside one
        self.headed: list[bool] = []  # an h1 or inside one
        self.outer: list[int] = []  # outermost article or main element around
        self.lines: list[tuple[str, int, int]] = []  # text, tags, element (-1: none)
        self.links: list[bool] = []  # whether a line is mostly links
        self.parts: list[str] = []
        self.tags = self.in_links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1][1] if self.stack else -1))
            self.links.append(2 * self.in_links > len(text))
        self.parts, self.tags, self.in_links = [], 0, 0

    def inside(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)

    def marks(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, float]:
        """Whether an element is set aside, and what its markup leaves of its lines' ratios."""
        if tag in ASIDE or any(k == "hidden" for k, _ in attrs):
            return True, 1.0
        named = self.inside("article", "main")
        if tag == "header":  # a page's header; an article's own keeps its heading
            return not named, 1.0
        if tag in ("main", "body", "html"):
            return False, 1.0
        within, left = 0 if named else 1, 1.0
        for k, v in attrs:
            if v and k in (("class",) if tag == "article" else ("class", "id", "role")):
                for name in v.lower().split():
                    words = set(_TOKEN.findall(name))
                    if words & MARKS:
                        left = min(left, MARKED[within])
                    elif words & HINTS and words <= HINTS | LAYOUT | NEUTRAL:
                        left = min(left, HINTED[within])
                    elif words & LAYOUT and words <= LAYOUT | NEUTRAL:
                        left = min(left, PLACED[within])
        return False, left

    def cut(self, i: int) -> None:
        """Close the open elements from place i on."""
        for t, e in reversed(self.stack[i:]):
            self.at[t].pop()
            self.end[e] = len(self.tag)
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS or tag in ASIDE
        if block:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS and self.blocks:  # a block ends an open paragraph, and an item an open item
            ends = ("p", tag) if tag in ("li", "tr", "td", "th", "dt", "dd", "option") else ("p",)
            if self.stack[self.blocks[-1]][0] in ends:
                self.cut(self.blocks[-1])
        up = self.stack[-1][1] if self.stack else -1
        has = up >= 0
        aside, share = self.marks(tag, attrs)
        e = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.end.append(-1)
        self.aside.append(aside or has and self.aside[up])
        self.share.append(min(share, self.share[up]) if has else share)
        self.linked.append(tag == "a" and any(k == "href" for k, _ in attrs) or has and self.linked[up])
        self.headed.append(tag == "h1" or has and self.headed[up])
        self.outer.append(self.outer[up] if has and self.outer[up] >= 0 else e if tag in NAMED else -1)
        self.at.setdefault(tag, []).append(len(self.stack))
        if block:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, e))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in ASIDE:
            self.flush()
        self.tags += 1
        if not self.at.get(tag):
            return  # a stray end tag
        i = self.at[tag][-1]
        if tag not in BLOCKS and any(self.at[t][-1] > i for t in ("article", "main", "body", "table") if self.at.get(t)):
            return  # an inline end tag does not reach beyond these
        self.cut(i)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "li"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.stack and self.linked[self.stack[-1][1]]:
            self.in_links += len(" ".join(data.split()))

    def finish(self) -> None:
        self.close()
        self.flush()
        self.cut(0)

    def around(self, elements: list[int], fit: Callable[[str], bool]) -> int:
        """The deepest fitting element that holds all these (-1: the page): what holds the first and the last holds all."""
        x, last = min(elements), max(elements)
        while x >= 0 and (self.end[x] <= last or not fit(self.tag[x])):
            x = self.parent[x]
        return x


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; weights beyond the ends are left out and the rest scaled up."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = lambda v: np.convolve(v, kernel)[r:r + len(values)]
    return full(values) / full(np.ones(len(values)))


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Lines of the content region, one blank line between two; empty if there is none.  ``sigma`` 0 does not smooth."""
    if not html:
        return ""
    last = html.rfind("<")
    if last > html.rfind(">") and _OPEN.match(html, last):
        html = html[:last]  # a tag that the end of the page cuts off
    page = _Lines()
    page.feed(html)
    page.finish()
    rows = [(text, tags, e, link) for (text, tags, e), link in zip(page.lines, page.links, strict=True) if e < 0 or not page.aside[e]]
    if not rows:
        return ""
    size = np.array([len(text) for text, *_ in rows], float)
    ratio = size / np.array([max(1, tags) for _, tags, *_ in rows])
    share = np.array([1.0 if e < 0 else page.share[e] for _, _, e, _ in rows])
    even = (smooth(ratio, sigma) if sigma > 0 else ratio) * share
    cluster = even >= CUT * (even @ size) / size.sum()
    core = [e for (_, _, e, link), c in zip(rows, cluster.tolist(), strict=True) if c and (not link or e >= 0 and page.headed[e])]
    if not core:
        core = [e for (_, _, e, _), c in zip(rows, cluster.tolist(), strict=True) if c]
    if min(core) < 0:
        regions = [-1]  # text of the page itself
    elif any(page.outer[e] >= 0 for e in core):
        held: dict[int, list[int]] = {}
        for e in core:
            if page.outer[e] >= 0:
                held.setdefault(page.outer[e], []).append(e)
        regions = [page.around(es, NAMED.__contains__) for es in held.values()]
    else:
        heads = [e for _, _, e, _ in rows if e >= 0 and page.headed[e]]
        regions = [page.around(core + heads, lambda t: t in BLOCKS and t not in ("p", "li", "td", "tr", "h1", "h2"))]
    inside = lambda e: any(r < 0 or r <= e < page.end[r] for r in regions)
    return "\n\n".join(text for (text, _, e, _), c, s in zip(rows, cluster.tolist(), share.tolist(), strict=True) if inside(e) and (c or s == 1.0))


def extract(html: str | Column = "html") -> Column:
    """Main text of every whole page; null and pages without text give an empty string."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(h) for h in s], dtype=object)

    return extracted(F.col(html) if isinstance(html, str) else html)
