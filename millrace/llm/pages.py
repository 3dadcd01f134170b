"""Main text of web pages from a stream of parser events.

Each block of a page is a line. Its ratio of text to tags, smoothed over its neighbours with a Gaussian
and weighed by what the elements around it say of themselves, is clustered by a threshold. The lines
above it decide which region holds the article (the smallest element that has them all) and which
elements in it are furniture (those that none of them is in, if they call themselves so, or are mostly
links and don't stand between lines of the article, or close the page with its copyright). No class and
no attribute drops or keeps a block by itself: they move its ratio. Words inside a line are never taken
out of it, whatever their elements say of themselves; only elements that show no text have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that end a line, that show no text, that have no end tag, within a line, and of headings.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template svg iframe object canvas audio video head title select datalist textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag of the same kind ends, and elements that can hold a whole article.
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
REGIONS = frozenset("html body div section center article main form".split())
#: What elements say of themselves by their tag, their role, and the first or last part of a class or id of at most three parts.
FURNITURE = frozenset("nav header footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar widget widgets footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended recommendations comment comments commentlist disqus replies respond pagination "
    "pager toolbar".split())
#: How a page's last line says whose it is.
COPYRIGHT = re.compile(r"^(©|\(c\)|copyright\b)|\ball rights reserved\W*$", re.IGNORECASE)
#: Headers are named whole: those of an article, such as entry-header, hold its title.
HEADERS = frozenset("header site-header main-header top-header global-header".split())
_PARTS = re.compile(r"[-_]+")
#: A line's ratio is divided by this for each element around it that calls itself furniture, and multiplied by it inside
#: article and main elements, if these hold the second number's share of the clustered text, weighed alike.
WEIGHT, ARTICLE_SHARE = 100.0, 0.5
#: Clusters whose means differ by less than this factor are one.
ONE_CLUSTER = 3.0
#: Reach and standard deviation of the smoothing in lines, and the share of links in the text of an element that is mostly links.
RADIUS, SPREAD, LINKS = 1, 0.7, 0.7


@dataclass
class Line:
    """A block's text, the tags met in it, its characters inside links, its links, and the innermost
    block around it."""

    text: str
    tags: int
    linked: int
    links: int
    owner: int


class PageLines(HTMLParser):
    """Turns a page into lines and a tree of the elements that hold them; element 0 is the page.

    A parent has a smaller number than its children, and each line points to its owner only, so that
    time and memory grow with the page, however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.names, self.parents, self.cues = ["html"], [0], [False]
        self._open: list[tuple[str, int, bool, bool]] = []  # name, its or its block's number, left out, an open p that a block ends
        self._breaking: set[str] = set()  # names of elements that end a line though they are no blocks
        self._count: dict[str, int] = {}
        self._left_out, self._links, self._tags, self._linked, self._anchors = 0, 0, 0, 0, 0
        self._parts: list[str] = []

    @property
    def _owner(self) -> int:
        return self._open[-1][1] if self._open else 0

    def _break(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.lines.append(Line(text, self._tags, min(self._linked, len(text)), self._anchors, self._owner))
            self._tags = 0
        self._parts, self._linked, self._anchors = [], 0, 0

    def _close(self) -> None:
        name, _, out, _ = self._open.pop()
        self._count[name] -= 1
        self._left_out -= out
        self._links -= name == "a"

    def _close_to(self, tag: str) -> None:
        while self._open[-1][0] != tag:
            self._close()
        self._close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._break()
            top = self._open[-1][0] if self._open else ""
            if top in CLOSES_ITSELF and (tag == top or top == "p"):
                self._close()
            elif tag == "p" and self._open and self._open[-1][3]:
                self._close_to("p")
        elif tag == "br":
            self._parts.append(" ")
        self._tags += 1
        if tag in VOID:
            return
        cue = self._calls_itself_furniture(tag, attrs)
        out = tag in SILENT
        number = self._owner
        if tag in BLOCKS or cue and not out:
            if tag not in BLOCKS:
                self._break()
                self._breaking.add(tag)
            self.names.append(tag)
            self.parents.append(number)
            self.cues.append(cue)
            number = len(self.names) - 1
        in_p = tag == "p" or tag not in BLOCKS and bool(self._open) and self._open[-1][3]
        self._open.append((tag, number, out, in_p))
        self._count[tag] = self._count.get(tag, 0) + 1
        self._left_out += out
        self._links += tag == "a"
        self._anchors += tag == "a"

    def _calls_itself_furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "article", "main") or tag in INLINE or tag in SILENT:
            return False
        if any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs):
            return True
        if tag in FURNITURE:
            # an article's own header holds its title
            return not (tag == "header" and (self._count.get("article") or self._count.get("main")))
        for name, value in attrs:
            if name == "role" and (value or "").lower() in ROLES:
                return True
            if name in ("class", "id"):
                for token in (value or "").lower().split():
                    parts = _PARTS.split(token)
                    if token in HEADERS or len(parts) <= 3 and (parts[0] in MARKS or parts[-1] in MARKS):
                        return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in self._breaking:
            self._break()
        self._tags += 1
        if self._count.get(tag):
            self._close_to(tag)

    def handle_data(self, data: str) -> None:
        if not self._left_out:
            self._parts.append(data)
            if self._links:
                self._linked += len(data)

    def read(self, page: str) -> PageLines:
        self.feed(page)
        self.close()
        self._break()
        return self


def smoothed_ratios(lines: list[Line]) -> np.ndarray:
    """Logarithm of each line's text-to-tag ratio, averaged over its neighbours with Gaussian weights, so
    that one very long line doesn't drown those beside it. Text inside links doesn't count."""
    ratio = np.log1p([(len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    weights = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SPREAD) ** 2)
    padded = np.pad(ratio, RADIUS)
    inside = np.convolve(np.pad(np.ones(len(ratio)), RADIUS), weights, "valid")
    return np.convolve(padded, weights, "valid") / inside


def content_lines(lines: list[Line], weights: np.ndarray) -> np.ndarray:
    """Whether each line is in the cluster of high ratios.

    The threshold parts the smoothed ratios, each moved by the logarithm ``weights``, into two clusters, each line nearer its own mean; it starts midway between the extremes. Ratios that
    hardly differ are one cluster.
    """
    values = smoothed_ratios(lines) + weights
    threshold = (values.min() + values.max()) / 2
    for _ in range(50):
        high = values > threshold
        if high.all() or not high.any():
            return np.ones(len(values), bool)
        means = values[high].mean(), values[~high].mean()
        if means[0] - means[1] < np.log(ONE_CLUSTER):
            return np.ones(len(values), bool)
        if sum(means) / 2 == threshold:
            break
        threshold = sum(means) / 2
    return values > threshold


def _totals(parents: list[int], owners: list[int], values: list[int]) -> list[int]:
    """For each element the sum over the lines inside it."""
    out = [0] * len(parents)
    for owner, value in zip(owners, values):
        out[owner] += value
    for e in range(len(parents) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; empty if there is none."""
    if not page:
        return ""
    tree = PageLines().read(page)
    lines, names, parents, n = tree.lines, tree.names, tree.parents, len(tree.names)
    if not lines:
        return ""
    cued, inside = [0] * n, [False] * n
    for e in range(1, n):
        cued[e] = cued[parents[e]] + tree.cues[e]
        inside[e] = inside[parents[e]] or names[e] in ("article", "main")
    owners, sizes = [x.owner for x in lines], [len(x.text) for x in lines]
    weights = -np.log(WEIGHT) * np.array([cued[o] for o in owners])
    for i in range(len(lines) - 1, -1, -1):
        if COPYRIGHT.search(lines[i].text):
            weights[i] -= np.log(WEIGHT)
        elif not cued[owners[i]]:
            break
    high = content_lines(lines, weights)
    article = np.array([inside[o] for o in owners])
    text = np.array(sizes) * high * np.exp(weights)
    if text[article].sum() >= ARTICLE_SHARE * text.sum() and article.any():
        high = content_lines(lines, weights + np.log(WEIGHT) * article)
    if not high.any() or all(cued[o] for o in owners) and _only_furniture(tree):
        return ""
    found = _totals(parents, owners, high.tolist())
    region = 0
    for e in range(1, n):
        if parents[e] == region and found[e] == found[0] and names[e] in REGIONS:
            region = e
    every, linked = _totals(parents, owners, sizes), _totals(parents, owners, [x.linked for x in lines])
    links = _totals(parents, owners, [x.links for x in lines])
    kept = [False] * n
    kept[region] = True
    told = np.flatnonzero(high)
    spans = _spans(parents, owners)
    for e in range(region + 1, n):
        beside = spans[e][0] < told[0] or spans[e][1] > told[-1]
        mostly_links = links[e] > 1 and linked[e] > LINKS * every[e] and names[e] != "p" and (beside or cued[e])
        kept[e] = kept[parents[e]] and not (found[e] == 0 and (tree.cues[e] or mostly_links))
    last = len(lines)
    while last - 1 > told[-1] and (COPYRIGHT.search(lines[last - 1].text) or not kept[owners[last - 1]]):
        last -= 1
    first = next(i for i, o in enumerate(owners) if kept[o])
    above = _ancestors(region, parents)
    return "\n\n".join(
        x.text for i, x in enumerate(lines[:last]) if kept[x.owner] or i < first and not cued[x.owner] and _leads_to(x.owner, above, names, parents))


def _spans(parents: list[int], owners: list[int]) -> list[tuple[int, int]]:
    """For each element its first and last line; (0, -1) if it has none."""
    first, end = [len(owners)] * len(parents), [-1] * len(parents)
    for i, owner in enumerate(owners):
        first[owner], end[owner] = min(first[owner], i), i
    for e in range(len(parents) - 1, 0, -1):
        first[parents[e]], end[parents[e]] = min(first[parents[e]], first[e]), max(end[parents[e]], end[e])
    return [(a, b) if b >= 0 else (0, -1) for a, b in zip(first, end)]


def _only_furniture(tree: PageLines) -> bool:
    """Whether all text lies in furniture by its tag, so that the page has no article."""
    by_tag = [False] * len(tree.names)
    for e in range(1, len(tree.names)):
        by_tag[e] = by_tag[tree.parents[e]] or tree.cues[e] and tree.names[e] in FURNITURE - {"form"}
    return all(by_tag[x.owner] for x in tree.lines)


def _ancestors(element: int, parents: list[int]) -> set[int]:
    out = {element, 0}
    while element:
        element = parents[element]
        out.add(element)
    return out


def _leads_to(owner: int, above: set[int], names: list[str], parents: list[int]) -> bool:
    """Whether a line before the region is its heading: the page's first rank, or beside an element
    that holds the region."""
    return names[owner] == "h1" or names[owner] in HEADINGS and parents[owner] in above


def extracted(html: Column) -> Column:
    """Main text of each page."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py()) for page in batch], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string").asNondeterministic()(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points of the text).

    A null or empty page, and one without text outside its furniture, has an empty text. Repeated
    rows are each extracted. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), extracted(F.col(html_col)).alias("text"))
    return rows.select(F.col("key").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
