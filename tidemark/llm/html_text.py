"""Main text of web pages by smoothed text-to-tag ratios over standard-library parser events.

The event stream is cut into lines at block elements.  A line's ratio is its
characters over its tags (Weninger and Hsu 2008); a Gaussian smooths the ratios
over neighbouring lines, and lines above the threshold form clusters.  Elements
named as content are regions, and what lies outside all of them is one more.  If a
named region holds most clustered characters, all its lines are the main text,
short ones included, and so are those of other named regions that are clustered
for the larger part, and of regions nested in these; if what is unnamed holds
most, the clusters are, with the plain lines between them and in named regions.

Elements that show nothing or are furniture by tag or role (menus, sidebars,
scripts, styles) hold no lines.  Classes and ids are hints of three kinds.  FIXED
names (adverts, notices, reader comments) mark furniture.  LAYOUT names, forms,
headers and footers do so unless next to nothing is left of the page without
them, as where one wraps everything.  LOOSE names, which articles use as well,
mark it only where the ratios agree: outside the chosen regions, or where less
than half of what they hold is clustered.  Ids of headings and paragraphs are
names of places and mark nothing.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
FURNITURE = frozenset("aside button canvas datalist dialog head iframe math menu nav noscript object script select style svg template textarea title".split())
#: Elements that neither show nor break a line.
UNSEEN = frozenset(("script", "style", "template"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
REGIONS = frozenset(("article", "main"))
#: How sure a name is of furniture.
NONE, LOOSE, LAYOUT, FIXED = 0, 1, 2, 3
#: Words of a class or an id that mark furniture, by how sure they are, and a content region.
_WORDS = {
    FIXED: r"ads?|adverts?|advertisement|adbox|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|popup|newsletter|subscribe|signup|login|announcements?|interstitial|paywall|"
    r"comments?|commentlist|replies|guestbook|disqus|nav|navbar|topnav|subnav|sidenav|navigation|breadcrumbs?|pager|pagination|skip-?link|sr-only",
    LAYOUT: r"banner|modal|overlay|lightbox|sidebar|side-?bar|aside|rail|menu|topbar|toolbar|footer|masthead|site-?header|page-?header|widgets?|hidden|alerts?|toast",
    LOOSE: r"reply|respond|responses|feedback|discussion|share|sharing|social|related|recommended|copyright|legal|disclaimer",
}
MARKED = {sure: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-]|\d)") for sure, words in _WORDS.items()}
#: A layout element is none if what is left without it has less than this share of its characters.
LEFT = 0.05
PLACES = frozenset("a blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
#: Names that tell of furniture elsewhere.
ELSEWHERE = re.compile(r"(?:^|(?<=\s))(?:(?:has|with|no|without)-\S+|\S+-(?:open|closed|enabled|disabled|on|off))(?=\s|$)")
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|article-?body|post-?body|maintext)(?:$|[\s_-])")
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element of these ends at the next one of its set.
SIBLINGS = {t: s for s in (frozenset(("li",)), frozenset(("dt", "dd")), frozenset(("td", "th")), frozenset(("tr",)), frozenset(("option",))) for t in s}
SIGMA = 1.0
_KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()
_CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


@functools.lru_cache(maxsize=4096)
def _marks(names: str) -> tuple[int, bool]:
    """How sure names are of furniture, and whether they are those of content."""
    names = ELSEWHERE.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower())
    return next((sure for sure in (FIXED, LAYOUT, LOOSE) if MARKED[sure].search(names)), NONE), bool(CONTENT.search(names))


class Lines(HTMLParser):
    """Collects the lines of a page: text, tags, characters in links, the region and the mark that each lies in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, furniture, the region and the mark outside
        self.skip = 0
        self.region = self.mark = 0
        self.outside = [0]  # of each region, the one around it
        self.marks = [(0, NONE)]  # of each mark, the one around it and how sure it is
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.buffer: list[str] = []
        self.tags = self.link = self.linked = 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.region, self.mark))
                self.tags = self.linked = 0
            self.buffer = []

    def pop(self, n: int) -> None:
        """Closes the innermost n elements."""
        if any(tag not in UNSEEN and tag not in INLINE for tag, *_ in self.open[len(self.open) - n :]):
            self.flush()
        for tag, furniture, region, mark in reversed(self.open[len(self.open) - n :]):
            self.skip -= furniture
            self.region, self.mark = region, mark
            if tag == "a":
                self.link = 0
        del self.open[len(self.open) - n :]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        furniture = tag in FURNITURE
        content, sure = False, LAYOUT if tag in ("form", "footer") or tag == "header" and not self.region else NONE
        if attrs and tag not in ("body", "html"):
            names = " ".join(v for k, v in attrs if v and (k == "class" or k == "id" and tag not in PLACES))
            if names:
                found, content = _marks(names)
                if not (content and tag in REGIONS):
                    sure = max(sure, found)
            furniture |= any(k == "role" and v and v.lower() in ROLES or k == "hidden" for k, v in attrs)
        if tag in INLINE and sure:  # such a piece of a line is left out of it
            furniture, sure = True, NONE
        if tag in INLINE and not furniture:
            if tag == "a":
                self.link = 1
            return
        if tag == "br" or tag == "hr" or tag == "img":
            if not self.skip:
                self.buffer.append(" ")
        if tag not in INLINE and tag not in UNSEEN:
            self.flush()
        if tag in VOID:
            return
        if self.open:
            if tag in ENDS_P and self.open[-1][0] == "p":
                self.pop(1)
            elif tag in SIBLINGS and self.open[-1][0] in SIBLINGS[tag]:
                self.pop(1)
        self.open.append((tag, furniture, self.region, self.mark))
        self.skip += furniture
        if self.skip:
            return
        if sure:
            self.marks.append((self.mark, sure))
            self.mark = len(self.marks) - 1
        if (tag in REGIONS or content) and (tag == "article" or not self.region):
            self.outside.append(self.region)
            self.region = len(self.outside) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "iframe", "svg"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link = 0
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop(len(self.open) - i)
                return
        if tag not in INLINE and tag not in UNSEEN:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.buffer.append(data)
            if self.link:
                self.linked += len(data)


Line = tuple[str, int, int, int, int]


def clusters(lines: list[Line]) -> np.ndarray:
    """Which lines lie in a cluster of high smoothed ratio."""
    ratio = np.array([(len(line[0]) - line[2]) / max(1, line[1]) for line in lines])
    smooth = np.convolve(np.pad(ratio, 3, mode="edge"), _KERNEL, "valid")
    return smooth >= min(smooth.std(), smooth.mean())


def _within(marks: list[tuple[int, int]], some: set[int]) -> set[int]:
    """The marks that are, or lie in, some of them; those around come first."""
    out = set(some)
    for m, (around, _) in enumerate(marks):
        if m and around in out:
            out.add(m)
    return out


def _plain(lines: list[Line], marks: list[tuple[int, int]]) -> list[Line]:
    """The lines that are in no furniture by fixed or layout names."""
    gone = _within(marks, {m for m, (_, sure) in enumerate(marks) if sure == FIXED})
    lines = [line for line in lines if line[4] not in gone]
    # from the outermost layout element to the innermost: it stays if next to nothing is left without it
    for m, (_, sure) in enumerate(marks):
        if sure == LAYOUT and m not in gone:
            own = _within(marks, {m})
            size = [0, 0]
            for text, _, linked, _, mark in lines:
                size[mark in own] += len(text) - linked
            if size[0] >= LEFT * size[1]:
                gone |= own
                lines = [line for line in lines if line[4] not in own]
    return lines


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by one space; empty if there is none."""
    if not html:
        return ""
    if (at := html.rfind("<")) > html.rfind(">"):
        html = _CUT_TAG.sub("", html) if _CUT_TAG.match(html, at) else html
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = _plain(parser.lines, parser.marks) if len(parser.marks) > 1 else parser.lines
    if not lines:
        return ""
    inside = clusters(lines).tolist()
    regions: dict[int, tuple[int, int]] = {}
    marks: dict[int, tuple[int, int]] = {}
    for (text, _, linked, region, mark), high in zip(lines, inside, strict=True):
        size = len(text) - linked
        a, b = regions.get(region, (0, 0))
        regions[region] = (a + size * high, b + size)
        while mark:  # a mark holds what those in it hold
            a, b = marks.get(mark, (0, 0))
            marks[mark] = (a + size * high, b + size)
            mark = parser.marks[mark][0]
    best = max(regions, key=lambda r: (regions[r][0], r > 0, regions[r][1], -r))
    loose = {m for m in marks if parser.marks[m][1] == LOOSE}
    if best:
        chosen = {r for r, (a, b) in regions.items() if r and 2 * a > b} | {best}
        for r, outside in enumerate(parser.outside):  # those around come first
            if outside in chosen:
                chosen.add(r)
        low = _within(parser.marks, {m for m in loose if 2 * marks[m][0] <= marks[m][1]})
        return " ".join(line[0] for line in lines if line[3] in chosen and line[4] not in low)
    low = _within(parser.marks, loose) if sum(marks[m][0] for m in loose) < regions[0][0] / 2 else set()
    kept = [i for i, (line, high) in enumerate(zip(lines, inside, strict=True)) if high and line[4] not in low]
    first, last = (kept[0], kept[-1]) if kept else (0, len(lines) - 1)
    return " ".join(t for i, (t, _, linked, r, mark) in enumerate(lines) if (r or first <= i <= last) and 2 * linked <= len(t) and mark not in low)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html; other columns are ignored).

    A null or empty html has an empty text.  Markup cut off by the end of the
    page is dropped; what was open there ends there.  A page is one row of a
    task, however long, and rows that repeat, or have no page_id, give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")


__all__ = ["clusters", "extract", "main_text"]
