"""Main text of HTML pages by tag-path ratios.

Every text block belongs to a root-to-leaf tag path. Per path the page's text length, punctuation and link text are
summed: text per block, times one plus punctuation per block, times the share that is no link text. The ratios are laid
along the page's blocks, smoothed with a Gaussian window, fused with the raw ratios (geometric mean), and blocks whose
fused value passes a threshold (a share of the page's deviation) are content nodes. They are the result, with two
additions that path ratios cannot see: within the container of the content (the article or main element with most of
it; without one the deepest element that holds ``HOLDS`` of it) short blocks that stand between content nodes, and
headings right before one, belong to the text unless they are link lists. Content nodes outside the article don't.
What no reader counts as the article goes first: elements that are menus, headers, footers, asides, forms or notices by
their tag, role or class, scripts, styles and reader comments.

Blocks are joined by one line end in page order; character references are decoded, white space inside a block becomes
one space. Defined results: a null or empty html, or a page of boilerplate only, has the empty text; unclosed and
stray tags are repaired the way browsers do it for p, li and table cells; a tag that never ends is text; rows are
independent, so repeated rows give repeated results; other columns are ignored; an empty table gives an empty table.
A page takes time in proportion to its length: the scanner never goes back, open elements are found by tag,
paths are numbers, and sums go up the tree once.
"""

from __future__ import annotations

import bisect
import functools
import html as html_lib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, small_batches

NAMED = re.compile(r"/?[a-zA-Z][^\s/<>]*")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|aria-hidden|hidden|style)(?![\w-])(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[,.;:!?，。；：！？、]")
NAME = re.compile(r"[a-z]+")
WIDTH, SHARE, HOLDS = 1.0, 0.5, 0.7

#: Fixed values of HTML, and the names that boilerplate goes by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form script style noscript template svg button select option textarea iframe object canvas dialog menu label input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog note toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs masthead footer sidebar notice cookie cookies consent gdpr alert popup modal overlay newsletter "
    "subscribe subscription comment comments disqus respond replies related recommended recommendations share sharing social "
    "toolbar pagination pager login signup search widget copyright disclaimer skip header topbar".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies disqus ad ads advert related teaser promo".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Element:
    __slots__ = ("tag", "parent", "dropped", "path", "number", "mass")

    def __init__(self, tag: str, parent: Element | None, dropped: bool, path: int, number: int):
        self.tag, self.parent, self.path, self.number, self.mass = tag, parent, path, number, 0
        self.dropped = dropped or bool(parent and parent.dropped)


class Block:
    __slots__ = ("element", "text", "links")

    def __init__(self, element: Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        names = set(NAME.findall(value))
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            return True
        if key == "role" and names & DROPPED_ROLES:
            return True
        if key in ("class", "id") and names & (COMMENT_NAMES if tag == "article" else DROPPED_NAMES):
            return True
    return False


def tag_ends(page: str):
    """A function that finds where a tag ends whose attributes begin at a place, -1 if its quotes leave it open. Read from
    the right: a > ends the tag, a quote leads to what follows its partner."""
    marks = [(m.start(), m[0]) for m in re.finditer("[>\"']", page)]
    ends, partner = [-1] * (len(marks) + 1), {}
    for i in range(len(marks) - 1, -1, -1):
        place, c = marks[i]
        if c == ">":
            ends[i] = place
        else:
            ends[i] = ends[partner[c] + 1] if c in partner else -1
            partner[c] = i
    places = [p for p, _ in marks]
    return lambda at: ends[bisect.bisect_left(places, at)]


def tags_of(page: str):
    """(start, end, name with / if closing, attributes) of every tag; a name of None is a comment or declaration. send()
    moves the place on. A tag that never ends is text."""
    at, n, end_of = 0, len(page), None
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = (yield start, n if end < 0 else end + 3, None, "") or (n if end < 0 else end + 3)
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            if end < 0:
                return
            at = (yield start, end + 1, None, "") or end + 1
            continue
        if not (name := NAMED.match(page, start + 1)):
            at = start + 1
            continue
        if end_of is None and (inside := INSIDE.match(page, name.end())):
            end = inside.end() - 1
        else:  # scan on would begin again and again
            end_of = end_of or tag_ends(page)
            end = end_of(name.end())
        if end < 0:
            at = start + 1
            continue
        at = (yield start, end + 1, name[0].lower(), page[name.end() : end]) or end + 1


@functools.cache
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


class Page:
    """The open elements of a page while it is read, and its blocks."""

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.elements: list[Element] = []
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
        self.blocks_open: list[int] = []  # places of open block elements
        self.inline: list[dict[str, int]] = []  # open inline elements by tag, since each open block element
        self.anchors = 0
        self.buffer: list[str] = []
        self.links = 0
        self.blocks: list[Block] = []
        self.push("html", "")

    def push(self, tag: str, attributes: str) -> None:
        parent = self.stack[-1] if self.stack else None
        dropped = bool(parent) and (parent.dropped or is_boilerplate(tag, attributes, bool(self.places["article"] or self.places["main"])))
        path = self.paths.setdefault((parent.path if parent else -1, tag), len(self.paths))
        e = Element(tag, parent, dropped, path, len(self.elements))
        self.places[tag].append(len(self.stack))
        if tag in BLOCK:
            self.blocks_open.append(len(self.stack))
            self.inline.append(defaultdict(int))
        else:
            self.inline[-1][tag] += 1
            self.anchors += tag == "a"
        self.stack.append(e)
        self.elements.append(e)

    def pop_to(self, k: int) -> None:
        """Close the element at place k and all in it."""
        if self.blocks_open[-1] >= k:
            self.flush()
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks_open.pop()
                self.anchors -= self.inline.pop()["a"]
            else:
                self.inline[-1][tag] -= 1
                self.anchors -= tag == "a"

    def nearest(self, tags) -> int:
        """Place of the innermost open element with one of these tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def text(self, s: str) -> None:
        if s and not self.stack[-1].dropped:
            self.buffer.append(s)
            if self.anchors:
                self.links += len(s)

    def flush(self) -> None:
        if self.buffer:
            s = "".join(self.buffer)
            s = SPACE.sub(" ", html_lib.unescape(s) if "&" in s else s).strip()
            if s:
                self.blocks.append(Block(self.stack[self.blocks_open[-1]], s, min(self.links, len(s))))
            self.buffer.clear()
            self.links = 0

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            k = self.places[tag][-1] if self.places[tag] else 0
        else:  # an inline end inside a block it did not open in is a stray one
            k = self.places[tag][-1] if self.inline[-1].get(tag) else 0
        if k:
            self.pop_to(k)
        elif tag == "p" and not self.stack[-1].dropped:
            self.flush()
        elif tag == "br":
            self.text(" ")

    def open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            k = self.blocks_open[-1]
            if k and self.stack[k].tag == "p":
                self.pop_to(k)
            self.flush()
        if tag in SIBLINGS:
            k = self.nearest(SIBLINGS[tag])
            if k > self.nearest(FENCES[tag]):
                self.pop_to(k)
        self.push(tag, attributes)


def blocks_of(page: str) -> tuple[list[Element], list[Block]]:
    """The elements, and every block of text that is not boilerplate in page order."""
    read, at, n, endless = Page(), 0, len(page), set()
    tags = tags_of(page)
    found = next(tags, None)
    while found:
        start, end, name, attributes = found
        read.text(page[at:start])
        at, move = end, None
        if name and name[0] == "/":
            read.close(name[1:])
        elif name == "br":
            read.text(" ")
        elif name == "hr":
            read.flush()
        elif name in RAW:
            over = None if name in endless else closing(name).search(page, at)
            if over:
                at = move = over.end()
            elif name in ("title", "textarea", "script", "style"):
                at = move = n
            else:
                endless.add(name)
        elif name and name != "html" and name not in VOID:
            read.open(name, attributes)
        try:
            found = tags.send(move)
        except StopIteration:
            found = None
    read.text(page[at:])
    read.flush()
    return read.elements, read.blocks


def fused_ratios(blocks: list[Block], width: float = WIDTH) -> np.ndarray:
    """The smoothed and fused ratio of every block's path."""
    path = np.unique([b.element.path for b in blocks], return_inverse=True)[1]
    total = lambda x: np.bincount(path, weights=np.fromiter(x, float, len(blocks)))
    size, links, marks, count = total(len(b.text) for b in blocks), total(b.links for b in blocks), total(len(PUNCTUATION.findall(b.text)) for b in blocks), np.bincount(path)
    raw = ((size / count) * (1 + marks / count) * (1 - links / size))[path]
    reach = math.ceil(width)
    window = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * width * width))
    smooth = np.convolve(np.pad(raw, reach, mode="edge"), window / window.sum(), "valid")
    return np.sqrt(raw * smooth)


def content_nodes(blocks: list[Block], width: float = WIDTH, share: float = SHARE) -> list[int]:
    """Indices of the blocks whose fused ratio passes the threshold."""
    fused = fused_ratios(blocks, width)
    return np.flatnonzero((fused >= share * fused.std()) & (fused > 0)).tolist()


def outermost_articles(elements: list[Element]) -> list[int]:
    """For every element the number of the outermost article or main around it, -1 without one."""
    of: list[int] = []
    for e in elements:
        above = of[e.parent.number] if e.parent else -1
        of.append(above if above >= 0 else e.number if e.tag in ("article", "main") else -1)
    return of


def container_of(elements: list[Element], blocks: list[Block], chosen: list[int]) -> int:
    """The deepest element that holds HOLDS of the content."""
    for i in chosen:
        blocks[i].element.mass += len(blocks[i].text)
    for e in reversed(elements[1:]):
        e.parent.mass += e.mass
    best, enough = 0, HOLDS * elements[0].mass
    for e in elements[1:]:  # parents come first
        if e.mass >= enough and e.parent.number == best and e.tag not in HEADINGS and e.tag != "p":
            best = e.number
    return best


def main_text(page: str | None) -> str:
    elements, blocks = blocks_of(page or "")
    if not blocks:
        return ""
    chosen = content_nodes(blocks)
    article = outermost_articles(elements)
    mass: dict[int, int] = defaultdict(int)
    for i in chosen:
        mass[article[blocks[i].element.number]] += len(blocks[i].text)
    mass.pop(-1, None)
    if mass:
        best = max(mass, key=mass.__getitem__)
        inside = [article[b.element.number] == best for b in blocks]
        chosen = [i for i in chosen if inside[i]]
    else:
        holds = [False] * len(elements)
        holds[container_of(elements, blocks, chosen)] = True
        for e in elements[1:]:
            holds[e.number] |= holds[e.parent.number]
        inside = [holds[b.element.number] for b in blocks]
    keep = [False] * len(blocks)
    for i in chosen:
        keep[i] = True
    own = [i for i in chosen if inside[i]]
    prose = lambda i: inside[i] and 2 * blocks[i].links <= len(blocks[i].text)
    if own:
        for i in range(own[0], own[-1]):
            keep[i] = keep[i] or prose(i)
        for i in range(len(blocks) - 2, -1, -1):  # headings before a block that stays
            keep[i] = keep[i] or keep[i + 1] and blocks[i].element.tag in HEADINGS and prose(i)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        for batch in batches:
            for piece in small_batches([batch], "html", 8 << 20):
                texts = [main_text(x) for x in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    bounded(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
