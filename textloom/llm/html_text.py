"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's streaming parser turns a page into lines (text between block boundaries, white space collapsed)
with the number of tags in each. A line's text-to-tag ratio, smoothed along the page by a Gaussian, falls into one of two
clusters around the means of a one-dimensional two-means split: content or boilerplate. Lines of article and main elements
count ``PRIOR`` times their ratio. The content region is the smallest element that holds all content lines, where an
article or main element counts as one line: all of it is content if it has a content line; where none has, all are if their
text, weighed ``WEIGHT`` times, makes half of the page's content. All of the region's lines are kept, short ones too, but
for its blocks without a content line before the first or after the last content: these are boilerplate.

Navigation, footers, headers of the page, asides, scripts, styles, controls and what isn't shown are left out wherever they
stand. So are forms and elements with a class, id or role that names an advert, notice, menu, sidebar or comments, unless
they hold half of the text of the page's article and main elements, or half of its content, weighed alike (comments: unless
they hold all content). A name says so if all of its words are known, one of ``HINTS`` and else only of ``LAYOUT``:
``cookie-notice`` and ``ad_slot2`` do, ``ad-hoc``, ``share-price`` and ``has-sidebar`` don't.

Null and empty pages give an empty text. Broken markup is read as far as it goes: end tags that may be left away are
implied as in the HTML standard, an end tag closes what it finds open, an unclosed element ends with the page. Other
columns don't matter; rows may repeat.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stats import map_text

SIGMA, PRIOR, WEIGHT, FEED = 1.0, 2.0, 10, 1 << 20
SKIPPED = frozenset("nav aside footer script style noscript template iframe object svg canvas select textarea button dialog menu head audio video map datalist".split())
REGIONS = frozenset(("article", "main"))
HOLDERS = frozenset("html body div section article main header table td form".split())
#: Start tags that end an open paragraph (HTML standard).
CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCKS = HOLDERS | SKIPPED | CLOSERS | frozenset("li dt dd tr th thead tbody tfoot caption br title legend option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CELLS, _PARTS = ("td", "th"), ("td", "th", "tr", "thead", "tbody", "tfoot", "caption")
#: What a start tag ends, and the elements beyond which it ends nothing.
IMPLIED = {
    "li": (("li",), frozenset("ul ol menu".split())),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "option": (("option",), frozenset(("select", "datalist"))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (_PARTS[:3] + ("caption",), frozenset(("table",))),
    "thead": (_PARTS, frozenset(("table",))),
    "tbody": (_PARTS, frozenset(("table",))),
    "tfoot": (_PARTS, frozenset(("table",))),
    "body": (("head",), frozenset()),
}
_TABLE, _TABLE_PARTS = frozenset("table template html".split()), frozenset(("table", *_PARTS))
_SCOPE = frozenset("table td th caption button object template html".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
HINTS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert banner "
    "sidebar menu nav navbar navigation topnav breadcrumb breadcrumbs footer masthead related recommended share sharing social newsletter "
    "subscribe subscription popup modal overlay toolbar widget pagination skip complementary contentinfo search login signup".split()
)
#: Names of the page's header, which an article may have inside.
PAGE_ONLY = frozenset(("header",))
LAYOUT = frozenset(
    "box bar block container wrapper wrap area section list links link item items slot unit inner outer panel row col column left right top bottom site page global primary secondary main content "
    "form button buttons icon icons message msg frame thread js lazy sticky fixed mobile desktop wide small large responsive dfp gpt google posts articles stories wp id".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")


def _unseen(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden":
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _hinted(attrs: list[tuple[str, str | None]], inside: bool) -> frozenset[str]:
    """The words of an element's names that say it is boilerplate."""
    known = HINTS if inside else HINTS | PAGE_ONLY
    out: frozenset[str] = frozenset()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                words = frozenset(w.lower() for w in _WORD.findall(one)) if one.lower() not in known else frozenset((one.lower(),))
                if words <= known | LAYOUT:
                    out |= words & known
    return out


class Lines(HTMLParser):
    """Collects lines as lists of (text, or None for a tag; element); an element is a number whose parents are known."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, element, left out
        self.open: Counter[str] = Counter()
        self.parent, self.region = [-1], [0]  # region: the outermost article or main around, or 0
        self.hinted, self.comments = [False], [False]
        self.lines: list[list[tuple[str | None, int]]] = []
        self.pieces: list[tuple[str | None, int]] = []

    def _flush(self) -> None:
        if self.pieces:
            self.lines.append(self.pieces)
            self.pieces = []

    def _close(self, tags: tuple[str, ...], scope: frozenset[str]) -> bool:
        """Ends the innermost open one of the elements and all within it, if nothing of the scope stands between."""
        if not any(self.open[t] for t in tags):
            return False
        stack = self.stack
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][0]
            if name in tags:
                for gone, _, _ in stack[i:]:
                    self.open[gone] -= 1
                del stack[i:]
                return True
            if name in scope:
                return False
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in CLOSERS:
                self._close(("head",), frozenset())
                self._close(("p",), _SCOPE)
            if tag in IMPLIED:
                while self._close(*IMPLIED[tag]):
                    pass
        _, element, out = self.stack[-1]
        if not out:
            self.pieces.append((None, element))
        if tag in VOID:
            return
        region = self.region[element]
        named = bool(attrs) and tag not in ("html", "body") and tag not in REGIONS
        hide = out or tag in SKIPPED or (tag == "header" and not region) or named and _unseen(attrs)
        words = _hinted(attrs, bool(region)) if named and not hide else frozenset()
        hinted = bool(words) or tag == "form"
        if (tag in HOLDERS or hinted) and not out:
            me, comments = len(self.parent), self.comments[element] or not COMMENTS.isdisjoint(words)
            self.parent.append(element)
            self.region.append(region or (me if tag in REGIONS and not comments else 0))
            self.hinted.append(hinted)
            self.comments.append(comments)
            element = me
        self.stack.append((tag, element, hide))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # only void elements end with their start tag, whatever the slash says

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        _, element, out = self.stack[-1]
        if not out:
            self.pieces.append((None, element))
        self._close((tag,), _TABLE - {tag} if tag in _TABLE_PARTS else _SCOPE - {tag} if tag in BLOCKS else BLOCKS)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.pieces.append((data, self.stack[-1][1]))

    def shown(self, hidden: list[bool]) -> list[tuple[str, int, int]]:
        """(text, tags, element) of each line with text, without the hidden elements."""
        out, tags = [], 0
        for pieces in self.lines:
            tags += sum(x is None and not hidden[e] for x, e in pieces)
            words = [(x, e) for x, e in pieces if x is not None and not hidden[e]]
            if words:
                text = " ".join("".join(x for x, _ in words).split())
                if text:
                    out.append((text, tags, next(e for x, e in words if x.strip())))
                tags = 0
        return out


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: smoothed ratios in the upper of two clusters."""
    if len(ratios) < 2:
        return np.ones(len(ratios), bool)
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    smooth = np.convolve(ratios, kernel, "full")[3 : 3 + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel, "full")[3 : 3 + len(ratios)]
    cut = smooth.mean()
    for _ in range(50):
        low, high = smooth[smooth <= cut], smooth[smooth > cut]
        if not len(high) or not len(low):
            break
        new = (low.mean() + high.mean()) / 2
        if new == cut:
            break
        cut = new
    return smooth > cut if (smooth > cut).any() else np.ones(len(ratios), bool)


def _up(weight: list[int], parent: list[int]) -> list[int]:
    """Sums over each element and all that it holds; children come after their parents."""
    for e in range(len(weight) - 1, 0, -1):
        weight[parent[e]] += weight[e]
    return weight


def _judged(lines: list[tuple[str, int, int]], region: list[int]) -> list[bool]:
    return content_lines(np.array([(PRIOR if region[e] else 1.0) * len(t) / (1 + n) for t, n, e in lines])).tolist()


def _hide(parser: Lines) -> list[bool]:
    """Which elements lie in hinted ones that hold less than half of the page's regions' text and of its content."""
    parent, region, n = parser.parent, parser.region, len(parser.parent)
    if not any(parser.hinted):
        return [False] * n
    lines = parser.shown([False] * n)
    content, regions = [0] * n, [0] * n
    for (text, _, e), good in zip(lines, _judged(lines, region)):
        if good or region[e]:
            content[e] += len(text) * (WEIGHT if region[e] else 1)
        if region[e]:
            regions[parent[region[e]]] += len(text)
    content, regions = _up(content, parent), _up(regions, parent)
    hidden = [False] * n
    for e in range(1, n):
        if parser.comments[e]:
            small = content[e] < max(1, content[0])
        else:
            small = 2 * content[e] < max(1, content[0]) and not (regions[e] and 2 * regions[e] >= regions[0])
        hidden[e] = hidden[parent[e]] or parser.hinted[e] and small
    return hidden


def extract(html: str) -> str:
    parser = Lines()
    for at in range(0, len(html), FEED):
        parser.feed(html[at : at + FEED])
    parser.close()
    parser._flush()
    lines = parser.shown(_hide(parser))
    if not lines:
        return ""
    parent, region, n = parser.parent, parser.region, len(parser.parent)
    good = _judged(lines, region)
    # regions with a content line are content as a whole; where none has one, all are if by weight they hold half of it
    inside = WEIGHT * sum(len(t) for t, _, e in lines if region[e])
    every = inside >= sum(len(t) for (t, _, e), use in zip(lines, good) if use and not region[e])
    whole = {region[e] for (_, _, e), use in zip(lines, good) if region[e] and use} or {region[e] for _, _, e in lines if region[e] and every}
    good = [use or region[e] in whole for (_, _, e), use in zip(lines, good)]
    # the lowest element that holds all content lines, and whether an element holds any
    held = [0] * n
    for (_, _, e), use in zip(lines, good):
        held[region[e] if region[e] in whole else e] += use
    held = _up(held, parent)
    top = max(e for e in range(n) if held[e] == held[0])
    under = [e == top for e in range(n)]
    block = [0] * n  # the outermost element below the top that holds no content line
    for e in range(top + 1, n):
        under[e] = under[parent[e]]
        block[e] = block[parent[e]] or (e if under[e] and not held[e] and region[e] not in whole else 0)
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
    return " ".join(t for i, (t, _, e) in enumerate(lines) if under[e] and (not block[e] or first < i < last))


def main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the main text of each page."""

    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array([extract(x or "") for x in column.to_pylist()], pa.string())]

    return map_text(pages, html, keep or ["page_id", "url"], make, "text string")
