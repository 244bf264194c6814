"""Main text of web pages by text-to-tag ratios.

The standard library's parser gives events; each block of a page (paragraph, heading, list item, ...) is a line
with its text, the number of tags in it and the elements around it. A line's ratio is its text outside links for
each tag; lines in menus, headers, footers, sidebars, notices, adverts, forms and comments have none. Ratios are
smoothed with a Gaussian over neighbouring lines, and a threshold (their standard deviation) parts content lines from
the others. The content region is the innermost element that is marked as main content and holds at least half of
the content lines' text, or else the innermost element that holds nearly all of it. Of a marked region all lines
are kept but those of what is listed above; of another one, what lies between its first and last content lines,
with headings before it and short lines after it that aren't mostly links.

Defined results: a null or empty page, and one without text outside the parts named above, has an empty text.
Broken markup is read as far as the parser reads it: unclosed elements end with what is around them. Repeated rows
are extracted each. Line breaks inside a block are white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template title svg iframe object canvas audio video map applet noframes datalist head".split())
#: Elements around what isn't the article.
ASIDE = frozenset("nav header footer aside form menu dialog button select textarea fieldset label option".split())
#: Roles of such elements.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in the class or id of such elements.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription "
    "subnav teaser toc toolbar topbar widget widgets".split()
)
#: Words beside which such a word says nothing about the element.
NEGATED = frozenset("has have no with without not".split())
#: Elements and names of main content.
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
MAIN_NAMES = frozenset("article articlebody content post entry story body text maintext".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr caption ul".split()
)
#: Elements that regions are made of.
REGIONS = frozenset("html body div section article main td center table tbody tr".split())
#: Open elements that a starting one ends, and those that they aren't looked for beyond.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist"))}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements within each other; what is in deeper ones counts for the last of these.
DEPTH = 512
#: Lines that a Gaussian reaches on either side, and its width; shares of content that a region holds.
REACH, WIDTH, HALF, NEARLY_ALL = 2, 1.0, 0.5, 0.95


def names_of(attributes: dict[str, str | None]) -> list[list[str]]:
    """Words of each name in the class and id of an element."""
    return [[w.lower() for w in _WORD.findall(name)] for key in ("class", "id") for name in (attributes.get(key) or "").split()]


class Element:
    """An open or closed element; ``aside`` if it stands around what isn't the article, ``holds`` if main content is in it."""

    __slots__ = ("tag", "above", "aside", "named", "silent", "main", "holds")

    def __init__(self, tag: str, attributes: dict[str, str | None], above: Element | None):
        self.tag, self.above, self.holds = tag, above, False
        names = names_of(attributes) if attributes else []
        role = (attributes.get("role") or "").lower()
        self.silent = tag in SILENT
        called = any(NAMES.intersection(n) and not NEGATED.intersection(n) for n in names)
        self.named = called and tag not in ("html", "body", "main")
        self.aside = tag in ASIDE or role in ROLES
        self.main = not self.named and (tag in MAIN_TAGS or role in MAIN_ROLES or attributes.get("itemprop") == "articleBody" or tag in REGIONS and tag not in ("html", "body") and any(MAIN_NAMES.intersection(n) for n in names))

    @property
    def apart(self) -> bool:
        """Whether its lines aren't the article's; an element around the article isn't."""
        return (self.aside or self.named) and not self.holds


class Line:
    """A block's text, its characters in links, its tags, and where it stands."""

    __slots__ = ("text", "linked", "tags", "at", "heading", "item")

    def __init__(self, text: str, linked: int, tags: int, at: Element, heading: bool, item: Element | None):
        self.text, self.linked, self.tags, self.at, self.heading, self.item = text, linked, tags, at, heading, item


class Lines(HTMLParser):
    """Lines of a page, from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open = [self.root]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = self.tags = self.links = self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            self.parts.append(" ")
            if tag == "hr":
                self._end_line()
            return
        if tag in BLOCKS:
            self._end_line()
            if tag in ENDS:
                self._close(*ENDS[tag])
            else:
                self._close(("p",), ("div", "section", "article", "main", "td", "th", "li", "blockquote", "body", "button"))
        element = Element(tag, dict(attrs), self.open[-1])
        if len(self.open) >= DEPTH and not element.silent:
            return
        self.open.append(element)
        self.silent += element.silent
        self.links += tag == "a"
        if tag in MAIN_TAGS and not element.named or element.main and attrs and dict(attrs).get("itemprop") == "articleBody":
            for around in self.open[1:-1]:
                around.holds = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            self._close((tag,), ())
        else:
            # one inside a block ends within it
            self._close((tag,), tuple(BLOCKS))

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def _close(self, tags: tuple[str, ...], beyond: tuple[str, ...]) -> None:
        """Ends the nearest open element of one of the tags, and what is open in it."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                for element in self.open[k:]:
                    self.silent -= element.silent
                    self.links -= element.tag == "a"
                del self.open[k:]
                return
            if tag in beyond:
                return

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            block = next((e for e in reversed(self.open) if e.tag in BLOCKS), self.root)
            item = next((e.above for e in reversed(self.open) if e.tag == "li"), None)
            heading = any(e.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for e in self.open)
            self.lines.append(Line(text, self.linked, self.tags, self.open[-1] if block is self.root else block, heading, item))
            self.tags = 0
        self.parts, self.linked = [], 0

    def parse_html_declaration(self, i: int) -> int:
        # a marked section is a comment to HTML; the parser knows some and fails on the others
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def close(self) -> None:
        """What is left is text, or a tag or comment that never ends, which is none; the parser would try each of its characters anew."""
        rest, self.rawdata = self.rawdata, ""
        if not rest.startswith("<") and self.cdata_elem is None:
            self.handle_data(unescape(rest))
        self._end_line()


def around(element: Element | None) -> Iterator[Element]:
    """An element and all those it is in."""
    while element is not None:
        yield element
        element = element.above


def apart(line: Line) -> bool:
    """Whether a line stands in a menu, header, footer, notice and the like. Of the article's own header its headings are kept."""
    for element in around(line.at):
        if element.apart:
            if element.tag == "header" and line.heading and not element.named and any(e.main and e.tag in MAIN_TAGS for e in around(element.above)):
                continue
            return True
    return False


def smoothed(ratios: np.ndarray) -> np.ndarray:
    weights = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / WIDTH) ** 2)
    return np.convolve(np.pad(ratios, REACH), weights / weights.sum(), "valid")


def content_lines(lines: list[Line]) -> np.ndarray:
    """Which lines belong to the cluster of high ratios of text to tags."""
    ratios = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    flat = smoothed(ratios)
    found = (flat >= flat.std()) & (ratios > 0)
    return found if found.any() else ratios > 0


def linked_lists(lines: list[Line]) -> set[int]:
    """Lines of lists whose items are all links: menus."""
    lists: dict[int, list[int]] = {}
    for k, line in enumerate(lines):
        if line.item is not None:
            lists.setdefault(id(line.item), []).append(k)
    return {k for rows in lists.values() if len(rows) > 1 and all(lines[k].linked >= 0.9 * len(lines[k].text.replace(" ", "")) for k in rows) for k in rows}


def region(lines: list[Line], content: np.ndarray) -> Element | None:
    """The innermost element that is marked as main content and holds half of the content lines' text, or else holds nearly all of it."""
    mass: dict[int, int] = {}
    depth: dict[int, tuple[int, Element]] = {}
    for line in (x for x, c in zip(lines, content, strict=True) if c):
        chain = [e for e in around(line.at)]
        for k, element in enumerate(reversed(chain)):
            mass[id(element)] = mass.get(id(element), 0) + len(line.text)
            depth[id(element)] = (k, element)
    whole = sum(len(x.text) for x, c in zip(lines, content, strict=True) if c)
    marked = [(k, e) for k, e in depth.values() if e.main and mass[id(e)] >= HALF * whole]
    # an article or main element comes before one with such a name
    for kind in (lambda e: e.tag in MAIN_TAGS, lambda e: True):
        if found := [x for x in marked if kind(x[1])]:
            return max(found, key=lambda x: x[0])[1]
    others = [(k, e) for k, e in depth.values() if (e.tag in REGIONS or e.tag == "") and mass[id(e)] >= NEARLY_ALL * whole]
    return max(others, key=lambda x: x[0])[1] if others else None


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    lines = [x for x in page.lines if not apart(x)]
    menus = linked_lists(lines)
    lines = [x for k, x in enumerate(lines) if k not in menus]
    if not lines:
        return ""
    content = content_lines(lines)
    if not content.any():
        return ""
    home = region(lines, content)
    inside = [k for k, x in enumerate(lines) if home is None or any(e is home for e in around(x.at))]
    if home is None or not home.main:
        mine = [k for k in inside if content[k]]
        first, last = mine[0], mine[-1]
        while first - 1 in inside and lines[first - 1].heading:
            first -= 1
        while last + 1 in inside and lines[last + 1].at.tag in ("p", "blockquote", "pre", "li") and 2 * lines[last + 1].linked < len(lines[last + 1].text):
            last += 1
        inside = [k for k in inside if first <= k <= last and (content[k] or 2 * lines[k].linked < len(lines[k].text))]
    return "\n".join(lines[k].text for k in inside)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page (``page_id, url, html``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
