"""Main text of web pages from parser events: text-to-tag ratio by line, smoothed and clustered.

The parser of the standard library streams a page's events. Text gathers into lines, one for each block element's stretch of
text, and each line counts the tags that its stretch held. A line's ratio is its characters by its tags. Elements lower it: to
nothing within menus, headers, footers, sidebars, notices, adverts, forms and reader comments, and for menus of links outside
the page's articles; to a part outside the page's article and main elements, where it has them, and for a line that is one
link. Controls and scripts within a line are left out of it without cutting it.

Classes and ids say something of containers only, never of headings, paragraphs, list items, cells or what stands in a line. A
container that is named for notices, adverts, menus or remarks alone is left out, unless it is the layout around the text: if it
holds the page's main or article elements, or by far the most of the text, it stays. One whose name says something else too
(related-work, section-header) only has its lines' ratios lowered if it stands in an article.

The ratios are smoothed with a Gaussian and split into two clusters (two means of their logarithms). The lines of the upper
cluster select the content region: the articles and main, if these hold the most of what was selected, or else the innermost block element
that holds two thirds of it. With that region goes text that stands beside it as plain text elements (a title, a byline, a
closing list), and lines of the upper cluster elsewhere that stand together with others of it. Of the region every line is
content whose ratio is not nothing, but those of doubtful containers only in the upper cluster, and lists of links without an
article only between other content.

Defined results: null and empty pages have no text; character references are decoded; white space within a line becomes one
space; lines keep the order of the page; a page whose lines are all in left-out elements has no text; repeated rows give
repeated rows; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimworks.llm import _tables

SIGMA = 1.0
#: What is left of a ratio outside article and main elements, and of that of a line that is one link.
OUTSIDE, LINKED = 0.25, 0.25
#: What is left of a ratio in a container within an article whose name is doubtful.
DOUBTFUL = 0.5
#: Share of the selected text that the region holds at least.
SHARE = 2 / 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_SILENT = frozenset("head title legend nav aside form footer header menu dialog".split())
_MUTE = frozenset("script style noscript template iframe svg math canvas object audio video map button select option textarea label datalist".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar "
    "header masthead topbar footer copyright sidebar sidebars rail widget widgets related recommended recommendations "
    "cookie cookies consent gdpr notice notices notification popup modal overlay alert paywall "
    "comment comments commentlist disqus replies respond responses "
    "share sharing social newsletter subscribe subscription signup login search skip".split()
)
_STATES = frozenset("has no with without".split())
_REMARKS = frozenset("comment comments commentlist disqus replies respond responses".split())
_TEXT = _HEADINGS | frozenset("p li dt dd ul ol dl blockquote pre figure figcaption caption address thead tbody tr th".split())
_UNNAMED = _HEADINGS | frozenset("html body p li dt dd tr td th caption figcaption pre blockquote address".split())
_OWN_CLOSE = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
_STOP_CLOSE = frozenset("ul ol dl table tbody thead tfoot div section article main body blockquote".split())
_SPLIT = re.compile(r"[^a-z0-9]+").split
_SPACE = re.compile(r"\s+").sub


def _words(value: str) -> set[str]:
    """The words of a class or id up to one that says what the element has or lacks: of content-with-sidebar, content."""
    found = set()
    for name in value.lower().split():
        for word in filter(None, _SPLIT(name)):
            if word in _STATES:
                break
            found.add(word)
    return found


def _barred(attributes) -> bool:
    """Whether the element's role or state says that it is no part of the text."""
    return any(key == "role" and value and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true" for key, value in attributes)


def _named(attributes) -> set[str]:
    """The words of the element's class and id, if one of them says that it is no part of the text."""
    words = set().union(*[_words(value) for key, value in attributes if key in ("class", "id") and value])
    return set() if _NAMES.isdisjoint(words) else words


class Lines(HTMLParser):
    """Gathers (text, tags, region, left out, place, named, doubtful) of each line; region: number of the outermost article or
    main, 0 outside; place: number of the block element, 0 for the page, and the line's links if it is nothing else; named: the
    innermost element around it that is left out for its names alone, 0 if none is; doubtful: whether its container's name is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, tuple[int, int], int, bool]] = []
        self.blocks: list[tuple[int, str]] = [(0, "")]  # the block element around it, element
        self.named: list[tuple[int, bool, bool]] = [(0, False, False)]  # the named element around it, whether it may be layout, or remarks
        self.mains: list[int] = []  # the named element around each main
        self._open: list[tuple[str, bool, int, int, int, bool, bool]] = []  # element, left out, region, named, block element, doubtful, mute
        self._at: dict[str, list[int]] = defaultdict(list)  # where each element is open
        self._stops: list[int] = []  # where an element is open that others' ends do not reach across
        self._outs, self._names = Counter(), Counter()  # open elements that are left out, or named
        self._now = (False, 0, 0, 0, False, False)  # left out, region, named, block element, doubtful, mute
        self._regions = 0
        self._text: list[str] = []
        self._line: tuple | None = None  # self._now where the line began
        self._link, self._plain, self._links = False, False, 0  # within a link; whether the line has text outside links; its links
        self._tags = 0

    def _end_line(self) -> None:
        text = _SPACE(" ", "".join(self._text)).strip()
        if text:
            out, region, name, block, doubtful, _ = self._line
            links = 0 if self._plain or self.blocks[block][1] in _HEADINGS else max(1, self._links)
            self.lines.append((text, self._tags, region, out, (block, links), name, doubtful))
            self._tags = 0
        self._text, self._line, self._plain, self._links = [], None, False, 0

    def _push(self, tag: str, now: tuple) -> None:
        if tag in _STOP_CLOSE:
            self._stops.append(len(self._open))
        self._at[tag].append(len(self._open))
        self._outs[tag] += now[0]
        self._names[tag] += now[2] > 0
        self._open.append((tag, *now))
        self._now = now

    def _pop(self, n: int) -> None:
        """Closes the element at a place and all within it."""
        within = self._open[n:]
        if any(x[0] not in _INLINE and not x[6] for x in within):
            self._end_line()
            self._link = False
        for x in reversed(within):
            self._at[x[0]].pop()
            self._outs[x[0]] -= x[1]
            self._names[x[0]] -= x[3] > 0
        while self._stops and self._stops[-1] >= n:
            self._stops.pop()
        del self._open[n:]
        self._now = self._open[-1][1:] if self._open else (False, 0, 0, 0, False, False)

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag in _VOID:
            if tag == "br":
                self._text.append(" ")
            elif tag == "hr":
                self._end_line()
            return
        out, region, name, block, doubtful, mute = self._now
        if tag in _INLINE:
            if tag == "a":
                self._link = True
                self._links += not mute
            if attrs and _barred(attrs):
                self._push(tag, (out, region, name, block, doubtful, True))
            return
        blocks = tag in _TEXT or tag in _STOP_CLOSE
        if tag in _MUTE or mute and not blocks:
            self._push(tag, (True, region, name, block, doubtful, True))
            return
        if not mute:
            self._end_line()
        closes = max((self._at[t][-1] for t in _OWN_CLOSE.get(tag, _OWN_CLOSE["p"]) if self._at[t]), default=-1)
        if closes > (self._stops[-1] if self._stops else -1):
            self._pop(closes)
            out, region, name, block, doubtful, mute = self._now
        if mute and tag not in ("article", "main"):
            self._push(tag, (True, region, name, block, doubtful, True))
            return
        if tag in ("article", "main"):
            around = {"nav", "header", "form", "label", "p", "ul", "li"}  # an element left open, or a form around the page
            if {t for t, n in self._outs.items() if n} <= around:
                out = mute = False
                if {t for t, n in self._names.items() if n} <= around:
                    name = 0
            if not out:
                self._end_line()
                if tag == "main":
                    self.mains.append(name)
                if not region:
                    self._regions += 1
                    region = self._regions
        elif tag in _HEADINGS and out and region and self._open and self._open[-1][0] == "header" and sum(self._outs.values()) == 1:
            out = False  # the title in an article's own header
        elif tag in _SILENT or attrs and tag not in ("html", "body") and _barred(attrs):
            out = True
        elif attrs and not out and tag not in _UNNAMED and (words := _named(attrs)):
            remarks = not _REMARKS.isdisjoint(words)
            if region and not remarks and not words <= _NAMES:
                doubtful = True
            else:
                self.named.append((name, not remarks and not words <= _NAMES, remarks))
                name = len(self.named) - 1
        if tag not in ("html", "body"):
            self.blocks.append((block, tag))
            block = len(self.blocks) - 1
        self._push(tag, (out, region, name, block, doubtful, mute))

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._tags += 1
        self._link = self._link and tag != "a"
        if self._at[tag]:
            self._pop(self._at[tag][-1])
        elif tag == "p":
            self._end_line()

    def handle_data(self, data):
        if self._now[5]:
            return
        if self._line is None and data.strip():
            self._line = self._now
        self._text.append(data)
        if not self._link and not self._plain:
            self._plain = bool(data.strip())

    def finish(self) -> list[tuple[str, int, int, bool, tuple[int, int], bool]]:
        """(text, tags, region, left out, place, doubtful) of each line; place: its block element, and its links if it is nothing else."""
        self.close()
        self._end_line()
        layout = self._layout()
        return [(text, tags, region, out or name not in layout, place, doubtful) for text, tags, region, out, place, name, doubtful in self.lines]

    def totals(self, values: list[tuple[int, float]]) -> list[float]:
        """For each block element the sum of what stands in it; values: (block element, value)."""
        out = [0.0] * len(self.blocks)
        for block, value in values:
            out[block] += value
        for n in range(len(out) - 1, 0, -1):  # numbered as they begin
            out[self.blocks[n][0]] += out[n]
        return out

    def inside(self, block: int) -> list[bool]:
        """For each block element, whether it is this one or in it."""
        out = [False] * len(self.blocks)
        out[block] = True
        for n in range(block + 1, len(out)):
            out[n] = out[self.blocks[n][0]]
        return out

    def holder(self, block: int) -> int:
        """The block element that a piece of text stands in, other than pieces of text."""
        while block and self.blocks[block][1] in _TEXT:
            block = self.blocks[block][0]
        return block

    def core(self, mass: list[tuple[int, float]], share: float) -> int:
        """The innermost block element, other than a piece of text, that holds so much of the mass."""
        held = self.totals(mass)
        best = 0
        for n in range(1, len(held)):
            if held[n] >= share * held[0] and self.blocks[n][0] == best and self.blocks[n][1] not in _TEXT:
                best = n
        return best

    def beside(self, core: int) -> list[bool]:
        """For each block element, whether only text elements lie between it and one that holds the core."""
        out, around = [False] * len(self.blocks), {0}
        n = core
        while n:
            around.add(n)
            n = self.blocks[n][0]
        for n in range(1, len(out)):
            up, tag = self.blocks[n]
            out[n] = tag in _TEXT and n not in around and (up in around or out[up])
        return out

    def _layout(self) -> set[int]:
        """The named elements that hold the page's text, and 0."""
        size, within, regions = [0] * len(self.named), [0] * len(self.named), set()  # characters, of these in articles
        for text, _, region, out, _, name, _ in self.lines:
            if not out:
                size[name] += len(text)
                if region:
                    within[name] += len(text)
                    regions.add(name)
        stay = {0}

        def keep(name: int) -> int:
            """Takes in the element and those around it; the characters that come back."""
            n = 0
            while name not in stay:
                stay.add(name)
                n += size[name]
                name = self.named[name][0]
            return n

        kept = size[0]
        if self.mains and 0 not in self.mains:
            kept += sum([keep(name) for name in self.mains])
        while True:
            found, layout = 0, [True] * len(self.named)
            for name, (around, may, remarks) in enumerate(self.named):
                if name in stay:
                    continue
                layout[name] = may and layout[around]
                held = within[name] and stay.isdisjoint(regions) and (not kept if remarks else within[name] > kept)
                if (held or layout[name] and size[name] > 4 * kept) and (not found or (not remarks, size[name]) > (not self.named[found][2], size[found])):
                    found = name
            if not found:
                return stay
            kept += keep(found)


def parsed(html: str) -> tuple[Lines, list[tuple[str, int, int, bool, tuple[int, int], bool]]]:
    parser = Lines()
    try:
        parser.feed(html)
        return parser, parser.finish()
    except AssertionError:  # a marked section that is none
        parser = Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        return parser, parser.finish()


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach), kernel / kernel.sum(), "valid")


def threshold(smooth: np.ndarray) -> float:
    """Where the two clusters of the values part: two means of the logarithms; half the mean at most, as a page of text alone has no two."""
    x = np.log1p(smooth)
    low, high = x.min(), x.max()
    while True:
        middle = (low + high) / 2
        upper = x >= middle
        if upper.all():
            return float(smooth.min())
        new = x[~upper].mean(), x[upper].mean()
        if new == (low, high):
            return min(float(np.expm1(middle)), float(smooth.mean()) / 2)
        low, high = new


def menus(parser: Lines, lines: list) -> list[bool]:
    """Which lines are links alone, several in the line or in a block of little else."""
    texts = parser.totals([(place[0], len(text)) for text, _, _, _, place, _ in lines])
    linked = parser.totals([(place[0], len(text)) for text, _, _, _, place, _ in lines if place[1]])
    counts = parser.totals([(place[0], 1) for _, _, _, _, place, _ in lines if place[1]])
    listed = [False] * len(texts)
    for n in range(1, len(texts)):
        listed[n] = listed[parser.blocks[n][0]] or counts[n] > 1 and linked[n] > 0.8 * texts[n]
    return [place[1] > 1 or place[1] > 0 and listed[place[0]] for _, _, _, _, place, _ in lines]


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The lines of a page's content regions."""
    parser, lines = parsed(html) if html else (None, [])
    if not lines:
        return ""
    region, out = (np.array([line[i] for line in lines]) for i in (2, 3))
    doubtful = np.array([line[5] for line in lines])
    regions = bool((region[~out] > 0).any())
    ratio = np.array([len(text) / max(1, tags) * (LINKED if place[1] else 1) for text, tags, _, _, place, _ in lines])
    ratio *= np.where(regions & (region == 0), OUTSIDE, 1) * np.where(doubtful, DOUBTFUL, 1) * ~out
    menu = np.array(menus(parser, lines)) & (region == 0)
    listed = ratio > 0
    ratio[menu] = 0
    content = ratio > 0
    if not content.any():
        return ""
    smooth = smoothed(ratio, sigma)
    level = threshold(smooth)
    above = content & (smooth >= level)
    if not above.any():
        above = content
    chosen = [(i, len(lines[i][0]) * (OUTSIDE if regions and not region[i] else 1)) for i in np.flatnonzero(above).tolist()]
    if 2 * sum(mass for i, mass in chosen if region[i]) > sum(mass for _, mass in chosen):
        kept = content & (region > 0)
    else:
        core = parser.core([(lines[i][4][0], mass) for i, mass in chosen], SHARE)
        inside, beside = parser.inside(core), parser.beside(core)
        holders = [parser.holder(line[4][0]) for line in lines]
        several = Counter(holders[i] for i, _ in chosen)
        like = {i for i, _ in chosen if several[holders[i]] > 1}
        within = np.array([inside[line[4][0]] for line in lines])
        kept = content & (within | np.array([beside[line[4][0]] or i in like for i, line in enumerate(lines)]))
        places = np.flatnonzero(kept & within)
        if len(places):  # lists of links between other content
            kept |= menu & listed & within & (np.arange(len(lines)) > places[0]) & (np.arange(len(lines)) < places[-1])
    kept &= ~doubtful | (smooth >= level)
    return "\n".join(line[0] for line, keep in zip(lines, kept.tolist()) if keep)


def extract(pages: DataFrame, *, sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(h, sigma) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_tables.read(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_html_text": op7_html_text}
