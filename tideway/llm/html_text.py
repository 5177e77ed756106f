"""Main text of web pages from streaming parser events.

The standard-library parser reports tags and text; they become lines (blocks) with their text, their number of tags and the
element around them. Lines inside menus, adverts and the like count as empty. Elements that only their class words (or a
form tag) mark as boilerplate are so unless they hold most of the dense text of the page: then they are wrappers. The
text-to-tag ratio of the lines is smoothed with a Gaussian and split by a threshold; every element with text above the
threshold (each article or main element if there is one, else what contains them all) is content, and all its lines that
are not boilerplate are returned. Parsing takes time in proportion to the page, however deep or unclosed its markup is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.llm.common import without

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end lines.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose lines are never content.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer head iframe input label map menu nav noscript object script search select "
    "style svg template textarea title video".split()
)
#: Words of class, id and role that mark boilerplate, unless the element holds most of the page's text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert newsletter subscribe subscription popup modal overlay sidebar complementary menu nav navbar "
    "navigation breadcrumb breadcrumbs footer contentinfo comment comments commentlist respond replies disqus "
    "related recommended share sharing social widget toolbar login signin signup pagination pager search form".split()
)
#: Those that mark an article element too; its other class words tell of the page around it.
REPLIES = frozenset("comment comments commentlist respond replies disqus".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MAIN = frozenset(("article", "main"))
#: Start tags that end an open element of the same family (and, for the blocks above, an open paragraph).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl select table body html".split())


@dataclass(slots=True)
class Element:
    tag: str
    #: Number of the block and of the marked element it is in (itself included); 0 is none.
    block: int
    mark: int
    dropped: bool
    header: bool


@dataclass(slots=True)
class Block:
    """A block element: the block around it, and the article or main element it is in or is."""

    parent: int
    main: int


@dataclass(slots=True)
class Mark:
    """An element marked by its words: the marked element around it, what marks it, and what it holds."""

    parent: int
    #: Block and article or main element around it.
    block: int
    main: int
    header: bool
    replies: bool
    has_title: bool = False
    has_main: bool = False
    paragraphs: int = 0


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    block: int
    mark: int
    #: Outside all dropped elements.
    open: bool
    heading: bool
    #: A heading of an article stays when the article's header is boilerplate.
    title: bool
    kept: bool = True

    @property
    def ratio(self) -> float:
        return len(self.text) / max(1, self.tags)


def _words(attrs: list[tuple[str, str | None]]) -> tuple[frozenset[str], bool]:
    """(class words, hidden) by attributes."""
    told = dict(attrs)
    words = re.split(r"[^a-z0-9]+", " ".join(told.get(k) or "" for k in ("class", "id", "role")).lower())
    hidden = "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in (told.get("style") or "").replace(" ", "")
    return frozenset(words), hidden


@dataclass
class Lines(HTMLParser):
    """Turns parser events into lines."""

    lines: list[Line] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=lambda: [Block(0, 0)])
    marks: list[Mark] = field(default_factory=lambda: [Mark(0, 0, 0, False, False)])

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        #: Places of the open elements of each tag, and how many open ones are dropped, headers, headings.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.dropped = self.headers = self.headings = 0
        self.texts: list[str] = []
        self.tags = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.texts).split())
        if text:
            block, mark = (self.open[-1].block, self.open[-1].mark) if self.open else (0, 0)
            title = self.headings > 0 and self.blocks[block].main > 0
            self.lines.append(Line(text, self.tags, block, mark, not self.dropped and (title or not self.headers), self.headings > 0, title))
            self.tags = 0
        self.texts = []

    def _cut(self, at: int) -> None:
        for element in reversed(self.open[at:]):
            self.places[element.tag].pop()
            self.dropped -= element.dropped
            self.headers -= element.header
            self.headings -= element.tag in HEADINGS
        del self.open[at:]

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._flush()
            ended = self._last((*CLOSES.get(tag, ()), "p") if tag not in ("br", "hr") else ())
            if ended >= 0 and ended > self._last(SCOPES) and ended > self._last(MAIN):
                self._cut(ended)
        elif tag in DROPPED:
            self._flush()
        if tag in VOID:
            return
        words, hidden = _words(attrs) if attrs else (frozenset(), False)
        block, mark = (self.open[-1].block, self.open[-1].mark) if self.open else (0, 0)
        around = self.blocks[block].main
        replies = not words.isdisjoint(REPLIES)
        header = "header" in words or "masthead" in words
        marked = replies if tag == "article" else tag == "form" or header or not words.isdisjoint(MARKS)
        marked = marked and tag not in ("html", "body", "main")
        if marked:
            self.marks.append(Mark(mark, block, around, header and tag != "form" and words.isdisjoint(MARKS), replies))
            mark = len(self.marks) - 1
        if tag in BLOCK:
            starts = tag in MAIN and not marked
            self.blocks.append(Block(block, len(self.blocks) if starts else around))
            block = len(self.blocks) - 1
            self.marks[mark].has_title |= tag == "h1"
            self.marks[mark].has_main |= starts
            self.marks[mark].paragraphs += tag == "p"
        element = Element(tag, block, mark, hidden or tag in DROPPED, tag == "header")
        self.places[tag].append(len(self.open))
        self.dropped += element.dropped
        self.headers += element.header
        self.headings += tag in HEADINGS
        self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self._last((tag,))
        if at < 0:
            return
        if tag in DROPPED or self.open[-1].block != (self.open[at - 1].block if at else 0):
            self._flush()
        self._cut(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.texts.append(data)

    def finish(self) -> None:
        self.close()
        self._flush()


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian mean over neighbours up to three sigma away; the ends repeat nothing."""
    reach = max(1, round(3 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def keep_lines(lines: list[Line], blocks: list[Block], marks: list[Mark]) -> None:
    """Set ``kept``: lines outside dropped and marked elements; a marked element that wraps the content counts as unmarked.

    The content is the dense text (ratio of a line at least the mean) of article and main elements, of the page if those
    have none. A wrapper holds more than half of it, and a main element, a top heading or two paragraphs; around replies one
    of the first two is wanted. Inside an article a wrapper holds ten elevenths of its text, headings apart: a shorter part of
    the article is boilerplate beside the rest.
    """
    shown = [x for x in lines if x.open]
    if len(marks) > 1 and shown:
        mean = sum(x.ratio for x in shown) / len(shown)
        dense = [x for x in shown if x.ratio >= mean]
        content = [x for x in dense if blocks[x.block].main] or dense
        total = sum(len(x.text) for x in content)
        of_main, held, inner = Counter(), [0] * len(marks), [0] * len(marks)
        for x in content:
            held[x.mark] += len(x.text)
        for x in shown:
            if not x.heading:
                of_main[blocks[x.block].main] += len(x.text)
                inner[x.mark] += len(x.text)
        # An element comes after the one around it, so sums go up in falling order.
        for at in range(len(marks) - 1, 0, -1):
            mark, around = marks[at], marks[marks[at].parent]
            held[mark.parent] += held[at]
            inner[mark.parent] += inner[at]
            around.has_title |= mark.has_title
            around.has_main |= mark.has_main
            around.paragraphs += mark.paragraphs
        free, free_title = [True] * len(marks), [True] * len(marks)
        for at, mark in enumerate(marks[1:], 1):
            told = mark.has_title or mark.has_main or (mark.paragraphs > 1 and not mark.replies)
            most = 11 * inner[at] >= 10 * of_main[mark.main] > 0 if mark.main else 2 * held[at] > total
            wraps = most and (told or bool(mark.main) and not mark.replies)
            free[at] = free[mark.parent] and wraps
            free_title[at] = free_title[mark.parent] and (wraps or mark.header)
    for x in lines:
        x.kept = x.open and (len(marks) == 1 or (free_title if x.title else free)[x.mark])


def _within(regions: set[int], blocks: list[Block]) -> list[bool]:
    """For every block, whether it is one of the regions or inside one."""
    out = [0 in regions]
    for at, block in enumerate(blocks[1:], 1):
        out.append(at in regions or out[block.parent])
    return out


def content_lines(page: Lines, sigma: float = 1.0) -> list[Line]:
    """Lines of the elements with text in the cluster of high smoothed ratios, less boilerplate."""
    lines, blocks = page.lines, page.blocks
    keep_lines(lines, blocks, page.marks)
    kept = [x for x in lines if x.kept]
    if not kept:
        return []
    ratios = smooth([x.ratio if x.kept else 0.0 for x in lines], sigma)
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    dense = [x for x, r in zip(lines, ratios) if x.kept and r >= threshold] or kept
    mains = {b.main for b in blocks} - {0}
    if mains:
        # Each article speaks for itself, so several are content side by side.
        inside = _within({blocks[x.block].main for x in dense} - {0} or mains, blocks)
        return [x for x in kept if inside[x.block]] or kept
    # Without an article a line speaks for the element right around its own block, unless only its neighbours are dense.
    own = [x for x in dense if x.ratio >= threshold] or dense
    votes = [0] * len(blocks)
    for x in own:
        votes[blocks[x.block].parent] += 1
    below = list(votes)
    for at in range(len(blocks) - 1, 0, -1):
        below[blocks[at].parent] += below[at]
    shared = max(at for at, n in enumerate(below) if n == len(own))
    inside = _within({shared}, blocks)
    if not all(inside[x.block] for x in lines):
        return [x for x in kept if inside[x.block]]
    # What contains them all is the whole page: each of them, and the headings.
    regions = {at for at, n in enumerate(votes) if n} - {shared}
    if not regions:
        return kept
    inside = _within(regions, blocks)
    alone = {id(x) for x in own if blocks[x.block].parent == shared}
    return [x for x in kept if x.heading or id(x) in alone or inside[x.block]]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Main text of one page: its content lines joined by one space; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    try:
        parser.feed(html)
    except AssertionError:  # the parser gives up on unknown marked sections; they are text then
        parser = Lines()
        parser.feed(html.replace("<![", "&lt;!["))
    parser.finish()
    return " ".join(x.text for x in content_lines(parser, sigma))


def extract_text(df: DataFrame, html_col: str = "html", name: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the html by default) plus the main text under ``name``; one row per input row, in place.

    A null page, an empty one and one without content give the empty text. Repeated rows give repeated rows; an empty table
    gives an empty result. A column named like the added one is replaced. Rows never move, so hot sites do not matter.
    """
    own = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower() and (keep is not None or c != html_col)]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(name, T.StringType(), False)])
    source = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{html_col}`").cast("string").alias("_ht_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*own, name])

    return source.mapInArrow(run, schema)
