"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams its events; block tags end a line, and a
line keeps how much text and how many tags it has. Text inside an element whose
name, class or role says it is not content takes no part; where a line has no other
text its ratio is zero. The ratios are smoothed with a Gaussian along the page, and a
threshold from their spread makes clusters of consecutive lines. A cluster selects the
articles it lies in, with their short lines; on a page without one, the smallest
container of all clusters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches

SIGMA = 1.0
#: Share of the ratios' spread that a smoothed ratio must reach.
LEVEL = 1.0

# Element names of HTML and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table "
                   "tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("head title script style noscript template svg math iframe object canvas audio video nav header footer aside menu "
                    "form button select textarea dialog".split())
RAW = frozenset(("script", "style"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLASSES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
                    "breadcrumb breadcrumbs sidebar side header masthead footer cookie cookies consent gdpr notice notices popup modal overlay "
                    "newsletter subscribe signup social share sharing related recommended comment comments respond disqus reply replies widget "
                    "login search pagination pager skip toolbar tagcloud".split())
CONTENT = frozenset(("article", "main"))
REGIONS = frozenset("article main body div section td th".split())
# Words of class names that mean the same wherever they stand, and names that an article's own parts carry.
CLEAR = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored breadcrumb breadcrumbs navbar cookie cookies comments disqus newsletter pagination".split())
ARTICLE_PARTS = frozenset("header side masthead search".split())
#: Elements that some pages wrap around everything, or never close.
WRAPPERS = frozenset("form nav header aside".split())
WRAPPED_SHARE = 0.5
_NAME = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


def _unwanted(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    """Whether an element is no content. Inside an article only clear class names count, such as ``ad-box`` or ``share``, not ``post-header``."""
    if tag in SKIPPED:
        return not (tag == "header" and inside_article)
    for name, value in attrs:
        if not value and name != "hidden":
            continue
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            words = _NAME.findall(value.lower())
            if inside_article:
                if not CLEAR.isdisjoint(words) or not (CLASSES - ARTICLE_PARTS).isdisjoint(value.lower().split()):
                    return True
            elif not CLASSES.isdisjoint(words):
                return True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


class LineParser(HTMLParser):
    """Pieces of text of a page by line, with the unwanted elements they lie in; unclosed and stray tags are tolerated.

    A piece is judged where it stands, not where its line ends.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[list[tuple[str, tuple[int, ...]]]] = []  # per line
        self.tags: list[int] = []
        self.regions: list[int] = []
        self.parents = {0: 0}
        self.articles: set[int] = set()
        self.wrappers: dict[int, bool] = {}  # unwanted element that may be a wrapper -> whether it holds an article or a heading
        self._open: list[tuple[str, int]] = []
        self._unwanted: list[int] = []
        self._regions = [0]
        self._count = self._elements = self._in_articles = self._tags = 0
        self._line: list[tuple[str, tuple[int, ...]]] = []
        self._at = 0

    def _end_line(self) -> None:
        if any(text.strip() for text, _ in self._line):
            self.pieces.append(self._line)
            self.tags.append(self._tags)
            self.regions.append(self._at)
            self._tags = 0
        self._line = []

    def _pop(self) -> None:
        tag, element = self._open.pop()
        if element:
            self._unwanted.remove(element)
        self._in_articles -= tag in CONTENT
        if tag in REGIONS:
            self._regions.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
            self._close_implied(tag)
        self._tags += 1
        if tag in VOID:
            if tag == "br":
                self._line.append((" ", tuple(self._unwanted)))
            return
        if tag in CONTENT or tag == "h1":
            for element in self._unwanted:
                if element in self.wrappers:
                    self.wrappers[element] = True
        element = 0
        if _unwanted(tag, attrs, self._in_articles > 0):
            self._elements += 1
            element = self._elements
            self._unwanted.append(element)
            if tag in WRAPPERS:
                self.wrappers[element] = False
        self._open.append((tag, element))
        if tag in REGIONS:
            self._count += 1
            inside = self._regions[-1]
            if self._in_articles:  # an article is one region with all its parts
                self._regions.append(inside)
            else:
                self.parents[self._count] = inside
                self._regions.append(self._count)
                if tag in CONTENT:
                    self.articles.add(self._count)
        self._in_articles += tag in CONTENT

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, an item the item before it."""
        ended = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        for k in range(len(self._open) - 1, -1, -1):
            name = self._open[k][0]
            if name == "p" or name in ended:
                while len(self._open) > k:
                    self._pop()
                if name == "p":
                    continue
            elif name in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._tags += 1
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                while len(self._open) > k:
                    self._pop()
                return
            if tag not in BLOCKS and self._open[k][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not (self._open and self._open[-1][0] in RAW):
            if not any(text.strip() for text, _ in self._line):
                self._at = self._regions[-1]
            self._line.append((data, tuple(self._unwanted)))

    def close(self) -> None:
        super().close()
        self._end_line()

    def lines(self) -> list[tuple[str, int, int, bool]]:
        """text, tags, region, wanted of every line. An element that holds an article or the heading and most of the page's text is a wrapper, not a part of it."""
        inside: dict[int, int] = {}
        total = 0
        for line in self.pieces:
            for text, elements in line:
                size = len(text.strip())
                total += size
                for element in elements:
                    inside[element] = inside.get(element, 0) + size
        void = {e for e, holds in self.wrappers.items() if holds and inside.get(e, 0) > WRAPPED_SHARE * total}
        out = []
        for line, tags, region in zip(self.pieces, self.tags, self.regions):
            kept = _BLANK.sub(" ", "".join(text for text, elements in line if void.issuperset(elements))).strip()
            whole = kept or _BLANK.sub(" ", "".join(text for text, _ in line)).strip()
            out.append((whole, tags, region, bool(kept)))
        return out


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the lines, renormalised at the ends."""
    reach = int(np.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(values, kernel)[reach:reach + len(values)] / np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]


def _around(region: int, parents: dict[int, int]) -> list[int]:
    """The region and the regions around it, outermost first."""
    path = [region]
    while region:
        region = parents[region]
        path.append(region)
    return path[::-1]


def content_lines(lines: list[tuple[str, int, int, bool]], parents: dict[int, int], articles: set[int]) -> list[str]:
    """The wanted lines of the articles that hold a cluster of lines with a high smoothed ratio.

    Without articles they are those of the smallest region around all clusters, so short
    paragraphs between long ones stay.
    """
    if not any(wanted for *_, wanted in lines):
        return []
    ratio = smoothed(np.array([wanted * len(text) / max(1, tags) for text, tags, _, wanted in lines]))
    high = {region for (_, _, region, wanted), r in zip(lines, ratio) if wanted and r >= LEVEL * ratio.std()}
    chosen = high & articles
    if not chosen:
        paths = [_around(region, parents) for region in high]
        shared = 0
        for step in zip(*paths):
            if len(set(step)) > 1:
                break
            shared = step[0]
        chosen = {region for _, _, region, _ in lines if shared in _around(region, parents)}
    return [text for text, _, region, wanted in lines if wanted and region in chosen]


def main_text(html: str) -> str:
    parser = LineParser()
    parser.feed(html)
    parser.close()
    return "\n".join(content_lines(parser.lines(), parser.parents, parser.articles))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages``.

    Null or empty html, or a page without content, gives empty text. White space within
    a block is one space, blocks are joined by a line end. Rows that repeat are
    separate; other columns are ignored.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "") for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
