"""Main text of HTML pages by a minimum cut over their blocks."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from keyrill.llm.shared import columns

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Fixed values of HTML: elements whose content is no text, elements that begin and end blocks, and elements without content.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "math", "canvas", "head", "title"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What a mark on an element costs a block inside it, in log odds. An element made for something else or a name
#: that says comments or adverts leaves little doubt; a name that speaks of layout leaves some.
SURE, LIKELY = 12.0, 7.0
#: What the main element of the page is worth to the blocks inside it, and costs the others.
MAIN = 8.0
OUTSIDE = {"nav", "footer", "aside", "button", "select", "textarea", "dialog", "menu", "search", "fieldset", "label", "legend"}
LAYOUT = {"form", "header"}
INSIDE = {"article", "main"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Words of class names and ids, by what they say of the element.
FOREIGN_NAMES = re.compile(r"(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|comments?|replies|reply|disqus|related|recommend\w*|teaser|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login)$")
LAYOUT_NAMES = re.compile(r"(?:banner|notices?|sidebar|side|menu|navbar|nav|navigation|breadcrumbs?|footer|foot|masthead|topbar|share|sharing|social|widget|toolbar|skip|search|header)$")
INSIDE_NAMES = re.compile(r"(?:article|post|entry|story|content|body|main|text)$")
#: Words that make of a name what an element has, had or lacks, and not what it is.
MODIFIERS = {"with", "no", "not", "has", "have", "without", "on", "off", "open", "closed", "enabled", "disabled", "allow"}
NAME_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


@dataclass
class Block:
    text: str
    parent: int
    linked: int
    tag: str


@dataclass
class Element:
    """cost: what marks of its own take from the odds of main text inside; inside: 3 article, 2 main, 1 a name, 0."""

    tag: str
    number: int
    parent: int = 0
    cost: float = 0.0
    inside: int = 0
    skipped: bool = False
    never: bool = False
    heads: bool = False
    #: characters of running text in all of it, and outside all marked elements in it
    chars: int = 0
    own: int = 0


def name_words(names: str) -> set[str]:
    """The words of class names and ids; names that hold a modifier say nothing."""
    found: set[str] = set()
    for name in names.split():
        words = {w.lower() for w in NAME_WORD.findall(name)}
        if not words & MODIFIERS:
            found |= words
    return found


@dataclass
class Page:
    """Reads a page into blocks, runs of text between block elements, and the elements that hold them."""

    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element("", 0)])
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0

    def close_block(self, top: Element) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, top.number, min(self.linked, len(text)), top.tag))
        self.parts, self.linked = [], 0

    def read(self, source: str) -> Page:
        stack, at = [self.elements[0]], 0
        while at < len(source):
            m = TAG.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text and not stack[-1].skipped:
                text = html.unescape(text)
                self.parts.append(text)
                if self.links:
                    self.linked += len(text.strip())
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag == "a":
                self.links = 0 if m[1] else 1
            if tag in ("br", "wbr", "img", "input") or tag in SKIPPED:
                self.parts.append(" " if tag != "wbr" else "")
            if m[1]:
                self.end(stack, tag)
                continue
            if tag in BLOCKS:
                self.close_block(stack[-1])
                if tag != "hr":
                    self.imply_ends(stack, tag)
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            if tag in BLOCKS or tag in SKIPPED or tag in OUTSIDE:
                if tag in OUTSIDE:
                    self.close_block(stack[-1])
                stack.append(self.begin(stack[-1], tag, m[3]))
        self.close_block(stack[-1])
        return self

    def begin(self, top: Element, tag: str, attributes: str) -> Element:
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        role, words = found.get("role", "").lower(), set()
        if ("class" in found or "id" in found) and tag not in ("body", "html"):
            words = name_words(f"{found.get('class', '')} {found.get('id', '')}")
        named = any(map(INSIDE_NAMES.match, words))
        inside = 3 if tag == "article" else 2 if tag == "main" or role == "main" else int(named)
        cost = 0.0
        if tag in OUTSIDE or role in OUTSIDE_ROLES or any(map(FOREIGN_NAMES.match, words)):
            cost = SURE
        elif tag in LAYOUT or tag not in INSIDE and any(map(LAYOUT_NAMES.match, words)):
            cost = LIKELY
        heads = cost == LIKELY and (tag == "header" or bool(words & {"header", "masthead", "banner"}))
        never = "hidden" in attributes.lower().split() or found.get("aria-hidden") == "true"
        new = Element(tag, len(self.elements), top.number, cost, inside, top.skipped or tag in SKIPPED, top.never or never, heads)
        self.elements.append(new)
        return new

    def imply_ends(self, stack: list[Element], tag: str) -> None:
        """A new block ends an open paragraph; an item ends the item before it."""
        while len(stack) > 1 and (stack[-1].tag == "p" or tag == stack[-1].tag and tag in ("li", "dd", "dt", "tr", "td", "th") or tag == "body" and stack[-1].tag == "head"):
            stack.pop()

    def end(self, stack: list[Element], tag: str) -> None:
        if tag in BLOCKS or tag in OUTSIDE:
            self.close_block(stack[-1])
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return

    def weigh(self) -> None:
        """Sums of text, and headers that are an article's title block and no mark.

        Elements are numbered in the order they begin, so one pass up and one
        down the numbers serve for any depth.
        """
        titled, around = [False] * len(self.elements), [0] * len(self.elements)
        for b in self.blocks:
            e = self.elements[b.parent]
            e.chars += len(b.text) - b.linked
            e.own = e.chars
            titled[b.parent] |= b.tag == "h1"
        for e in reversed(self.elements[1:]):
            titled[e.parent] |= titled[e.number]
        for e in self.elements[1:]:
            around[e.number] = max(around[e.parent], e.inside)
            if e.heads and (around[e.number] >= 2 or around[e.number] and titled[e.number]):
                e.cost = 0.0
        for e in reversed(self.elements[1:]):
            top = self.elements[e.parent]
            top.chars += e.chars
            top.own += 0 if e.cost else e.own

    def main_element(self) -> int:
        """The element that most likely holds the main text; 0 if no element is marked or outweighs the rest.

        An element's weight is its share of the page's running text outside
        marked elements within it, less for each mark on it or around it; a
        mark counts the less, the more of the page's text its element holds.
        An article is taken before a main element and that before a name if it
        holds a good part of the other's weight.
        """
        total, cost = max(1, self.elements[0].chars), [0.0] * len(self.elements)
        best: dict[int, tuple[float, int]] = {}
        for e in self.elements[1:]:
            cost[e.number] = cost[e.parent] + e.cost * (1 - e.chars / total)
            if e.own and not e.never:
                weight = e.own / total * math.exp(-cost[e.number] / 3)
                # of elements with the same text, the innermost named one
                if weight >= best.get(e.inside, (0.0, 0))[0]:
                    best[e.inside] = (weight, e.number)
        for level in (3, 2, 1):
            if level in best and all(best[level][0] >= 0.2 * best[k][0] for k in (1, 2) if k in best and k < level):
                return best[level][1]
        return 0

    def odds(self) -> list[float]:
        """Log odds of a linear classifier that each block is main text."""
        self.weigh()
        main, free, total = self.main_element(), set(), max(1, self.elements[0].chars)
        at = main
        while at:
            free.add(at)
            at = self.elements[at].parent
        # articles of about the same size beside it are parts of the same text
        held = self.elements[main].chars
        also = {e.number for e in self.elements if main and self.elements[main].inside == e.inside == 3 and not e.cost and 2 * e.chars >= held}
        cost, inside = [0.0] * len(self.elements), [False] * len(self.elements)
        for e in self.elements[1:]:
            inside[e.number] = inside[e.parent] or e.number == main or e.number in also
            # without a main element, a layout name that holds most of the page says little
            own = 0.0 if e.number in free else e.cost if main or e.cost == SURE else e.cost * (1 - e.chars / total)
            cost[e.number] = cost[e.parent] + own + (2 * SURE if e.never else 0)
        out = []
        for b in self.blocks:
            words = b.text.count(" ") + 1
            score = 1.2 + 0.04 * min(words, 60) - 4.0 * b.linked / len(b.text) + (0.8 if b.text[-1] in ".!?:;\"'”»" else -0.4) + (0.6 if b.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") else 0)
            out.append(score - cost[b.parent] + (0 if not main else MAIN if inside[b.parent] else -MAIN))
        return out


class Cut:
    """Maximum flow by shortest augmenting levels; keeps its graph in lists."""

    def __init__(self, n: int):
        self.heads: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.heads[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.heads)
        level[s], todo = 0, deque([s])
        while todo:
            x = todo.popleft()
            for e in self.heads[x]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    todo.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while (level := self.levels(s))[t] >= 0:
            nexts, path, x = [0] * len(self.heads), [], s
            while True:
                if x == t:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    first = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    x = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while nexts[x] < len(self.heads[x]):
                    e = self.heads[x][nexts[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                        x = self.to[e]
                        break
                    nexts[x] += 1
                else:
                    if x == s:
                        break
                    x = self.to[path.pop() ^ 1]
                    nexts[x] += 1
        return [v >= 0 for v in level]


def label(page: Page, adjacency: float = 0.5, proximity: float = 1.0) -> list[bool]:
    """Which blocks are main text: the source side of a minimum cut.

    A block's terminal edges cost what the classifier says that either label
    costs; neighbours in the page and successive blocks of one parent pay for
    unlike labels.
    """
    n, last = len(page.blocks), {}
    graph = Cut(n + 2)
    for i, (b, odds) in enumerate(zip(page.blocks, page.odds(), strict=True)):
        odds = max(-30.0, min(30.0, odds))
        graph.edge(n, i, math.log1p(math.exp(odds)), 0)
        graph.edge(i, n + 1, math.log1p(math.exp(-odds)), 0)
        if i:
            graph.edge(i - 1, i, adjacency, adjacency)
        if (before := last.get(b.parent)) is not None:
            graph.edge(before, i, proximity, proximity)
        last[b.parent] = i
    return graph.source_side(n, n + 1)[:n]


def main_text(source: str | None) -> str:
    page = Page().read(source or "")
    return "\n\n".join(b.text for b, kept in zip(page.blocks, label(page), strict=True) if kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row; null html has an empty text."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return columns(pages, page_id=page_id, url=url, html=html_column).mapInArrow(each, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long")
