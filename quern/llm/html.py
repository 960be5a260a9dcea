"""Main-text extraction by tag-path ratios (operator 4).

A page is read as blocks of text, each with the path of tags (with first class names) from the root to it. For each distinct
path the lengths of its blocks' texts and their punctuation marks are summed and divided by the number of its blocks. Both ratios
are smoothed over the paths in page order with a Gaussian kernel, plain and smoothed values are fused by their product, and
the paths whose fused value reaches a share of the standard deviation over the page hold the content. So a short paragraph
stays with the long ones of its path, and a menu entry falls with its kind.

What a tag, role, class name or id says of a part (menu, footer, sidebar, notice, advert, form, reader comments) leaves nothing out
by itself: it lowers the fused value of the paths below it, by LOW for class names and forms and by LOWEST for elements that say it
outright. All paths below one wrapper are lowered alike, so a page inside a form or in a "with-sidebar" wrapper keeps its text. Only scripts,
styles, controls and hidden elements are never read. A page on which no path's value reaches LEAST has no main text.

The innermost element around all content blocks, or its article, is the container: its other blocks (headings, lists,
tables, quotes) come with the content unless they are mostly links or stand in a part that was lowered inside it. Where that is
the page's body, only headings right before content blocks do.

Time is linear in the page's length, however deep it is nested: blocks refer to their element and path by number.

Defined cases: a null or empty html and a page without text give the empty string; cut-off tags, unclosed elements,
unknown declarations and entities are read as browsers do, near enough; a truncated page keeps what it has. Pages are read whole,
whatever their length. Each row is judged alone: repeated rows give equal rows, null page_ids and urls pass through, other columns of pages are
ignored, and an empty table gives an empty result. Paths of equal value are all in or all out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, slices, strings

# Elements of HTML by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "canvas", "iframe", "object", "audio", "video", "map", "select", "textarea", "button", "datalist"}
APART = {"nav", "footer", "aside", "menu", "dialog"}
FORMS = {"form", "fieldset"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "html", "td", "th", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SHAPES = {"svg", "path", "circle", "rect", "use", "line", "polygon"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
HOLDERS = {"article", "main"}
# Words in class names and ids that speak against article text.
MARKS = {
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "sidebar",
    "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "comment", "comments", "replies", "form", "login", "subscribe", "newsletter", "search", "share", "sharing", "social", "related", "pagination", "copyright", "disclaimer",
}
# First words of class names that only say what else the page has.
BESIDE = {"has", "with", "no", "without", "is", "js"}
PUNCTUATION = re.compile(r"[.,;:!?…。,、!?;:]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[^a-z]+")

#: Factors of paths below an element that a class name, id or form speaks against, or that is a menu, footer, sidebar or page header by its tag or role.
LOW, LOWEST = 0.005, 0.0005
#: The fused value that the best path of a page with main text has at least.
LEAST = 0.25


class Open(NamedTuple):
    """An open element: its number, its path's number, the lowering so far, and where the nearest scope and block element stand among the open ones."""

    tag: str
    number: int
    path: int
    factor: float
    silent: bool
    held: bool  # in an article or main element
    scope: int
    block: int


class Block(NamedTuple):
    text: str
    tag: str
    path: int
    element: int
    factor: float
    links: int


class Reader(HTMLParser):
    """Reads blocks with their tag paths; inline elements belong to no path."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.where: dict[str, list[int]] = defaultdict(list)  # tag -> places among the open elements
        self.paths: dict[tuple, int] = {}
        self.blocks: list[Block] = []
        self.parents, self.last, self.tags, self.factors = [-1], [0], [""], [1.0]  # of elements by number; 0 is the page
        self.parts: list[str] = []
        self.links = 0

    # markup that never ends takes the rest of the page, as in browsers, and so is read once
    def unended(self, i: int, end: str = ">") -> bool:
        return self.rawdata.find(end, i) < 0

    def parse_starttag(self, i):
        return len(self.rawdata) if self.unended(i) else super().parse_starttag(i)

    def parse_endtag(self, i):
        return len(self.rawdata) if self.unended(i) else super().parse_endtag(i)

    def parse_pi(self, i):
        return len(self.rawdata) if self.unended(i) else super().parse_pi(i)

    def parse_comment(self, i, report=1):
        return len(self.rawdata) if self.unended(i, "-->") else super().parse_comment(i, report)

    def parse_html_declaration(self, i):
        return len(self.rawdata) if self.unended(i) else super().parse_html_declaration(i)

    def parse_marked_section(self, i, report=1):
        """Sections with unknown names are comments to browsers."""
        return self.parse_bogus_comment(i)

    def top(self) -> Open:
        return self.open[-1] if self.open else Open("", 0, -1, 1.0, False, False, -1, -1)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.top()
            at = self.open[at.block] if at.block >= 0 else Open("", 0, -1, 1.0, False, False, -1, -1)
            self.blocks.append(Block(text, at.tag, at.path, at.number, at.factor, self.links))
        self.parts, self.links = [], 0

    @staticmethod
    def factor_of(tag: str, attrs: dict[str, str | None], held: bool) -> float:
        """What an element's tag, role, class names and id say of the text in it."""
        if tag in APART or tag == "header" and not held or (attrs.get("role") or "").lower() in ROLES:
            return LOWEST
        if tag in FORMS:
            return LOW
        if tag in ("html", "body", "article", "main") or not ("class" in attrs or "id" in attrs):
            return 1.0
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
            words = WORDS.split(name)
            # has-sidebar and the like describe what stands beside; an article's own header has its title
            if words[0] not in BESIDE and any(w in MARKS and not (held and w == "header") for w in words):
                return LOW
        return 1.0

    def pop_to(self, k: int, block: bool) -> None:
        if block:
            self.flush()
        for x in reversed(self.open[k:]):
            self.where[x.tag].pop()
            self.last[x.number] = len(self.parents) - 1
        del self.open[k:]

    def close_implied(self, tag: str) -> None:
        targets = {"p"} if tag in CLOSES_P else CLOSES.get(tag, ())
        k = max((self.where[t][-1] for t in targets if self.where[t]), default=-1)
        if k >= 0 and k >= self.top().scope:
            self.pop_to(k, True)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        inline = tag in INLINE
        if not inline:
            self.flush()
            self.close_implied(tag)
        at, known, n = self.top(), dict(attrs), len(self.open)
        silent = at.silent or tag in SILENT or "hidden" in known or known.get("aria-hidden") == "true" or bool(HIDDEN.search(known.get("style") or ""))
        own = self.factor_of(tag, known, at.held)
        factor, path, number = min(at.factor, own), at.path, at.number
        if not inline:
            name = (at.path, tag, ((known.get("class") or "").split() or [""])[0], own)
            path = self.paths.setdefault(name, len(self.paths))
            number = len(self.parents)
            self.parents.append(at.number), self.last.append(number), self.tags.append(tag), self.factors.append(factor)
        else:
            # an inline advert or label is a path of its own only if something speaks against it; its text stays in the block
            silent = silent or own < 1.0
            factor = at.factor
        self.where[tag].append(n)
        self.open.append(Open(tag, number, path, factor, silent, at.held or tag in HOLDERS, n if tag in SCOPES else at.scope, at.block if inline else n))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SHAPES:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        places = self.where[tag]
        if tag in INLINE:
            if places and places[-1] > self.top().block:
                self.pop_to(places[-1], False)
        elif places:
            self.pop_to(places[-1], True)
        elif tag == "p":
            self.flush()

    def handle_data(self, data):
        if not self.top().silent:
            self.parts.append(data)
            if self.where["a"]:
                self.links += len(data.strip())


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def content_paths(blocks: list[Block], sigma: float, share: float) -> set[int]:
    """The paths whose fused, smoothed text and punctuation ratios, lowered by what speaks against them, reach the threshold."""
    stats: dict[int, list[float]] = {}
    for b in blocks:
        s = stats.setdefault(b.path, [0, 0, 0, 0, b.factor])
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
        s[3] += b.links
    chars, marks, nodes, links, factor = np.array(list(stats.values()), float).T
    text = (chars - np.minimum(links, chars)) / nodes
    dots = (marks + 1) / nodes
    # plain and smoothed values count alike, so that a strong path does not lift its neighbours above itself
    fused = np.sqrt(text * smooth(text, sigma)) * np.sqrt(dots * smooth(dots, sigma)) * factor
    best = fused.max()
    if best < LEAST:
        return set()
    limit = min(share * fused.std(), best)
    return {p for p, f, n, c in zip(stats, fused, links, chars, strict=True) if f > 0 and f >= limit and n < 0.5 * c}


def main_blocks(reader: Reader, paths: set[int]) -> list[str]:
    """The texts of the content paths' blocks and of those that come with them, in page order."""
    blocks = reader.blocks
    chosen = [b.element for b in blocks if b.path in paths]
    if not chosen:
        return []
    # elements are numbered as they open, so one holds another if the other's number is within its own and its last one's
    inner, furthest = chosen[0], max(chosen)
    while reader.last[inner] < furthest:
        inner = reader.parents[inner]
    holder = inner
    while holder > 0 and reader.tags[holder] not in HOLDERS:
        holder = reader.parents[holder]
    inner = holder or inner
    inside = reader.tags[inner] not in ("", "html", "body")
    out: list[str] = []
    heads: list[str] = []
    for b in blocks:
        good = b.path in paths
        linked = b.links >= 0.5 * len(b.text)
        if not good and inside:
            good = inner <= b.element <= reader.last[inner] and b.factor >= reader.factors[inner] and not linked
        if good:
            out += [*heads, b.text]
            heads = []
        elif not inside and b.tag in HEADINGS and b.factor >= reader.factors[chosen[0]] and not linked:
            heads.append(b.text)
        else:
            heads = []
    return out


def extract(html: str, sigma: float = 1.0, share: float = 0.5) -> str:
    """The main text of a page: its blocks in page order, joined by empty lines."""
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    reader.pop_to(0, False)
    return "\n\n".join(main_blocks(reader, content_paths(reader.blocks, sigma, share))) if reader.blocks else ""


SCHEMA = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(h, sigma, share) for h in strings(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow(plain, run, SCHEMA)
