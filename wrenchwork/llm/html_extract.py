"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. They are laid out as lines, one per
block of text, each with its characters and the tags met on the way. The ratio of text to tags
is smoothed over neighbouring lines with a Gaussian, as a logarithm; lines are clustered into content and the
rest at a threshold found by two means. The content region is the article that holds most of
the text of the content lines, or else the innermost section that holds all of them, with the
headings before it. All its lines are given: a short paragraph stays, whatever its ratio. Parts that say what they are by tag, role or
class (menus, footers, adverts, comments and so on) are no content, and a page of nothing else has no
text. Sidebars, headers and forms stay where they turn out to hold the page's article. A name that only
may mean furniture is a hint: its lines stay if the clusters count them as content, and so it is with
lists that are nothing but links. The time is linear in the page, however deep its tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import fresh, wider

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "script style noscript template head title svg math canvas object iframe select textarea datalist".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("html body main article section div td table tbody tr center".split())
# Characters per tag from which on a line is no list of links, whatever the others have.
TEXT_RATIO = 20.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split()
)
# An open paragraph ends where one of these begins.
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
# Words of class names and ids that name page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs pagination pager sidebar side "
    "aside rail widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended comment comments commentlist commentform commentbox commentarea disqus replies "
    "reply respond search form skip copyright".split()
)
# Of these, the ones that mean it whatever else the name says.
STRONG_NAMES = FURNITURE_NAMES - frozenset(
    "banner menu side aside rail header foot alert modal overlay social reply respond search form skip".split()
)
# Also as the beginning or end of a longer word.
GLUED_NAMES = ("comments", "footer", "sidebar", "cookie", "newsletter", "breadcrumb", "disqus")
# Parts of these names may hold the whole page.
HOLDING_NAMES = frozenset(
    "sidebar side aside rail header masthead topbar nav navbar menu search form social widget widgets modal overlay".split()
)
# A name with one of these says what is beside it, missing or allowed.
BESIDE = frozenset("has no with without open closed free".split())
LAYOUT_PARTS = frozenset("layout wrapper wrap grid theme template".split())
# Names of these headers are of a text, and of these of the site.
TEXT_PARTS = frozenset("article entry post story content section chapter page".split())
SITE_PARTS = frozenset("site main top global blog web".split())
# What a form holds if it is put around a whole page.
PAGE_TAGS = frozenset("nav header footer main article h1".split())
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"[\x09-\x0D\x20]+")


# What an element is: nothing special, perhaps furniture, furniture unless it holds the article, furniture.
PLAIN, HINT, SOFT, GONE = range(4)


def _named(word: str, in_article: bool, block: bool) -> int:
    """What a class name or id says of its element."""
    parts = {p.lower() for p in _NAME_PARTS.findall(word)}
    found = parts & FURNITURE_NAMES
    glued = {g for g in GLUED_NAMES for p in parts - found if p.startswith(g) or p.endswith(g)}
    if not (found or glued) or parts & BESIDE:
        return PLAIN
    if found == {"header"} and not glued and (in_article or parts & TEXT_PARTS):
        return PLAIN
    holding = found <= HOLDING_NAMES and glued <= HOLDING_NAMES
    if found == parts or word.lower() in FURNITURE_NAMES:
        return SOFT if holding else GONE
    if not block:
        return PLAIN
    if holding and parts & LAYOUT_PARTS:
        return HINT
    if len(parts) <= 4 and (glued or found & STRONG_NAMES or ("header" in found and parts & SITE_PARTS)):
        return SOFT if holding else GONE
    return HINT if len(parts) <= 3 else PLAIN


def _furniture(tag: str, attributes: list[tuple[str, str | None]], in_article: bool, names: bool) -> int:
    """What an element says of itself by its tag, role and other attributes, and by ``names``."""
    if tag in FURNITURE_TAGS - {"form"} or (tag == "header" and not in_article):
        return GONE
    most = SOFT if tag == "form" else PLAIN
    for name, value in attributes:
        if name == "hidden":
            return GONE
        if not value:
            continue
        if name == "role" and value.lower() in FURNITURE_ROLES:
            most = max(most, SOFT if value.lower() == "form" else GONE)
        if name == "aria-hidden" and value.lower() == "true":
            return GONE
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return GONE
        if names and name in ("class", "id"):
            said = max((_named(word, in_article, tag in BLOCKS) for word in value.split()), default=PLAIN)
            # An article is one, unless its name plainly says otherwise.
            most = max(most, said if tag != "article" or said >= SOFT else PLAIN)
    return most


class _Open(NamedTuple):
    """An open element, with what it has from those around it."""

    tag: str
    unseen: bool
    gone: bool
    mark: int  # number of the nearest element that is a hint, soft or a list
    section: int  # number of the nearest section
    in_article: bool
    heading: str  # outermost heading
    blocks: int  # how many blocks are open


class _Line(NamedTuple):
    text: str
    tags: int  # met since the line before
    linked: int  # characters inside links
    mark: int
    section: int
    heading: str


_ROOT = _Open("", False, False, 0, 0, False, "", 0)


class _Layout(HTMLParser):
    """Lines of a page, its sections and its marked elements, both numbered in page order.

    Every open element carries what it has from those around it, and for every tag the places
    where it is open are kept, so that no event looks through the open elements.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.kinds = ["root"]  # tag of each section
        self.up = [0]  # section around each
        self.last = [0]  # last section inside each
        self.outer = [0]  # outermost article or main part around each
        self.marks = [PLAIN]  # what each marked element is; lists of links are hints as well
        self.mark_up = [0]
        self.mark_list = [False]
        self.forms = [False]
        self.page_tags = [0]  # articles, main parts and first headings directly in each marked element
        self.whole = [False]  # whether a form holds the tags of a page
        self.open = [_ROOT]
        self.places: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.links = 0
        self.linked = 0
        self.tags = 0

    def end_line(self) -> None:
        if not self.parts:
            return
        text = _SPACE.sub(" ", "".join(self.parts)).strip(" ")
        self.parts.clear()
        if text:
            around = self.open[-1]
            self.lines.append(_Line(text, self.tags, self.linked, around.mark, around.section, around.heading))
            self.tags = 0
        self.linked = 0

    def _place(self, tag: str) -> int:
        """Where the innermost open element of that tag is, 0 if none is."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _end(self, place: int) -> None:
        """Close the element there and all inside it."""
        while len(self.open) > place:
            ended = self.open.pop()
            self.places[ended.tag].pop()
            if ended.tag == "a":
                self.links -= 1
            if ended.section != self.open[-1].section:
                self.last[ended.section] = len(self.kinds) - 1

    def _mark(self, kind: int, tag: str, around: int) -> int:
        self.marks.append(kind)
        self.mark_up.append(around)
        self.mark_list.append(kind == HINT and tag in ("ul", "ol"))
        self.forms.append(tag == "form")
        self.page_tags.append(0)
        self.whole.append(False)
        return len(self.marks) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in BLOCKS:
            self.end_line()
            if tag in ENDS_PARAGRAPH:
                self._close("p", within=BLOCKS - {"p"})
            if tag == "li":
                self._close("li", within=frozenset(("ul", "ol", "menu")))
        if tag in VOID:
            return
        around = self.open[-1]
        # Programs in a text have spans named after their parts of speech, comments among them.
        names = tag not in ("html", "body", "main") and not (
            tag == "span" and (self._place("pre") or self._place("code"))
        )
        kind = GONE if around.gone else _furniture(tag, attrs, around.in_article, names)
        if kind >= SOFT and not around.gone:
            self.end_line()
        if tag in PAGE_TAGS and around.mark:
            self.whole[around.mark] = True
        mark, section = around.mark, around.section
        if kind == SOFT or (kind == HINT and tag in BLOCKS):
            mark = self._mark(kind, tag, mark)
        elif tag in ("ul", "ol") and kind == PLAIN:
            mark = self._mark(HINT, tag, mark)
        if tag in ("article", "main", "h1") and kind != GONE:
            self.page_tags[mark] += 1
        if tag in SECTIONS:
            section = len(self.kinds)
            self.kinds.append(tag)
            self.up.append(around.section)
            self.last.append(section)
            self.outer.append(self.outer[around.section] or (section if tag in ("article", "main") else 0))
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(
            _Open(
                tag, around.unseen or tag in UNSEEN, kind == GONE, mark, section,
                around.in_article or tag in ("article", "main"),
                around.heading or (tag if tag in HEADINGS else ""), around.blocks + (tag in BLOCKS),
            )
        )

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections like ``<![foo[ ... ]]>`` are skipped to the next ``>`` as browsers do; the parser would give up."""
        end = self.rawdata.find(">", i)
        return -1 if end < 0 else end + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def _close(self, tag: str, within: frozenset[str]) -> None:
        """End an open element unless one of ``within`` lies in between."""
        place = self._place(tag)
        if place and not any(self._place(other) > place for other in within):
            self.end_line()
            self._end(place)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        place = self._place(tag)
        # A stray end tag closes nothing around an article.
        if tag not in SECTIONS and any(self._place(t) > place for t in ("article", "main", "body")):
            return
        if place:
            inner, around = self.open[-1], self.open[place - 1]
            if inner.blocks > around.blocks or inner.gone or inner.mark != around.mark:
                self.end_line()
            self._end(place)
        elif tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        around = self.open[-1]
        if not (around.unseen or around.gone):
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> None:
        """Take what is left of the page, and leave out furniture that does not hold the article."""
        self.close()
        self.end_line()
        self._end(1)
        self.last[0] = len(self.kinds) - 1
        n = len(self.marks)
        text, tags, whole = [0] * n, list(self.page_tags), list(self.whole)
        for line in self.lines:
            text[line.mark] += len(line.text)
        for m in range(n - 1, 0, -1):
            up = self.mark_up[m]
            text[up] += text[m]
            tags[up] += tags[m]
            whole[up] |= whole[m]
        out = [False] * n
        for m in range(1, n):
            holds = tags[m] == tags[0] and 2 * text[m] >= text[0]
            # A form is furniture by its tag; it holds a page if parts of a page are in it.
            out[m] = out[self.mark_up[m]] or (
                self.marks[m] == SOFT and not (holds and (whole[m] or not self.forms[m]))
            )
        kept, tags_before = [], 0
        for line in self.lines:
            if out[line.mark]:
                tags_before += line.tags
            else:
                kept.append(line._replace(tags=line.tags + tags_before))
                tags_before = 0
        self.lines = kept


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Ratios blurred over neighbouring lines by a Gaussian."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Half way between the means of two clusters on a line (two means, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above):
            return cut
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def region_of(layout: _Layout, sizes: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which lines belong to the main text: those of the content region, and headings before it."""
    kinds, up, last = layout.kinds, layout.up, np.array(layout.last)
    section = np.array([line.section for line in layout.lines])
    outer = np.array(layout.outer)[section]
    held = np.bincount(outer[content], weights=sizes[content], minlength=len(kinds))
    held[0] = 0
    # An only article or main part that holds most of the content is all of it.
    if np.count_nonzero(held) == 1 and held.sum() >= 0.6 * sizes[content].sum():
        return outer == int(held.argmax())
    # Sections are numbered in page order: what holds the first and the last holds all between.
    region, end = int(section[content].min()), int(section[content].max())
    while last[region] < end:
        region = up[region]

    def around(s: int) -> bool:
        return s <= region <= last[s]

    first = int(((section >= region) & (section <= last[region])).argmax())
    # A section with a heading of its own before the region is part of it.
    for i in range(first):
        s = int(section[i])
        if layout.lines[i].heading and around(s) and kinds[s] not in ("root", "html", "body"):
            region = s
            break
    chosen = (section >= region) & (section <= last[region])
    for i in range(int(chosen.argmax())):
        heading = layout.lines[i].heading
        chosen[i] |= heading == "h1" or (heading != "" and around(int(section[i])))
    return chosen


def denied(layout: _Layout, sizes: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Lines that are no content inside an element of which that is true for most of the text.

    Only elements count whose names hint at furniture, and lists of three items or more without
    anything but links.
    """
    n = len(layout.marks)
    text, kept, links, count = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, line in enumerate(layout.lines):
        text[line.mark] += sizes[i]
        kept[line.mark] += sizes[i] * content[i]
        links[line.mark] += min(line.linked, sizes[i])
        count[line.mark] += 1
    for m in range(n - 1, 0, -1):
        for figure in (text, kept, links, count):
            figure[layout.mark_up[m]] += figure[m]
    poor = np.zeros(n, dtype=bool)
    for m in range(1, n):
        of_links = count[m] >= 3 and links[m] >= 0.8 * text[m]
        own = layout.marks[m] == HINT and kept[m] < 0.5 * text[m] and (of_links or not layout.mark_list[m])
        poor[m] = own or poor[layout.mark_up[m]]
    return ~content & poor[[line.mark for line in layout.lines]]


def content_lines(lines: list[_Line]) -> np.ndarray:
    """Which lines are content: two clusters of the smoothed ratios of text to tags."""
    sizes = np.array([len(line.text) for line in lines], dtype=np.float64)
    tags = np.array([line.tags for line in lines], dtype=np.float64)
    # As logarithms: one long line does not lift the links beside it, nor sink a shorter text.
    values = smoothed(np.log1p(sizes / np.maximum(tags, 1.0)))
    return values >= min(threshold(values), np.log1p(TEXT_RATIO), values.max())


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, one per line; empty if there is none."""
    if not html:
        return ""
    layout = _Layout()
    layout.feed(html)
    layout.finish()
    lines = layout.lines
    if not lines:
        return ""
    sizes = np.array([len(line.text) for line in lines], dtype=np.float64)
    content = content_lines(lines)
    chosen = region_of(layout, sizes, content) & ~denied(layout, sizes, content)
    return "\n".join(lines[i].text for i in np.flatnonzero(chosen))


def with_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``main_text`` from their ``html``, whole.

    A null or empty page has an empty text; repeated pages are each read; an empty table gives
    none. Malformed markup is read as far as it goes, it ends no job. Of parts that hold as much
    content the first counts. A name that clashes gets underscores in front.
    """
    (name,) = fresh(pages, "main_text")
    html_at = pages.columns.index("html")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [main_text(h.as_py()) for h in batch.column(html_at)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name]
                )

    return pages.mapInArrow(extract, wider(pages, [name], ["string"]))
