"""Main text of web pages: parser events make lines, each line has a ratio of text to tags, ratios are smoothed by a Gaussian, and a
threshold clusters lines into content and rest.

Elements that are boilerplate by their meaning (menus, forms, adverts, comments and so on) never make lines. A content line stands
for its region: all lines of the same article, or else of the same parent, are kept, so short paragraphs are not lost."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe input label map menu meter nav noscript object option output progress script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark boilerplate.
MARKS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer login masthead menu modal nav navbar navigation newsletter notice notices notification pagination paywall popup promo promoted promotion related remarks replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Marks that count outside of an article only: an article's own head belongs to it.
OUTER_MARKS = frozenset(("header",))
#: Marks that may name a part of an article's own text.
SECTIONS = frozenset("copyright disclaimer discussion notice notices related remarks".split())
#: An open element of the key ends where one of the values begins.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ARTICLE = re.compile(r"<(article|main)\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Lines(HTMLParser):
    """Lines as (text, tags, region). An element is (tag, dropped, region); dropped is 1 by a mark, 2 by more. Marks drop elements if heed is 2, and but for an article or main inside of them if it is 1."""

    def __init__(self, heed: int = 2):
        super().__init__(convert_charrefs=True)
        self.heed, self.marked = heed, False
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.tags, self.regions, self.articles = 1, 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1][2]))
        self.parts, self.tags = [], 1

    def dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED or tag == "header" and not self.articles:
            return True
        if tag in ("body", "html", "article", "main"):
            own = {w.lower() for k, v in attrs if k in ("class", "id") and v for w in _WORD.findall(v)}
            return tag == "article" and bool(own & {"comment", "comments", "ad", "advert", "promo", "sponsored", "related", "reply"})
        for key, value in attrs:
            if key in ("hidden",) or key == "aria-hidden" and value == "true":
                return True
            if key == "role" and value and value.strip().lower() in ROLES:
                return True
        return False

    def by_mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("body", "html", "article", "main"):
            return False
        own = {w.lower() for k, v in attrs if k in ("class", "id") and v for w in _WORD.findall(v)}
        if tag == "section" and self.articles:
            own -= SECTIONS
        found = bool(own & MARKS) or not self.articles and bool(own & OUTER_MARKS)
        self.marked |= found
        return found and self.heed > 0

    def pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.articles -= self.stack.pop()[0] in ("article", "main")

    def close_open(self, tags, barrier=frozenset(("ul", "ol", "dl", "table", "article", "main", "section", "div", "body"))) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] in tags:
                self.flush()
                self.pop(depth)
                return
            if self.stack[depth][0] in barrier:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.close_open(("p",))
            self.flush()
        for old, new in IMPLIED_END.items():
            if tag in new:
                self.close_open((old,))
        if tag == "br":
            self.parts.append(" ")
        if tag == "body":
            self.pop(1)
        self.tags += 1
        if tag in VOID:
            return
        top = self.stack[-1]
        around = 0 if top[1] == 1 and self.heed == 1 and tag in ("article", "main") else top[1]
        drop = max(around, 2 if self.dropped(tag, attrs) else int(self.by_mark(tag, attrs)))
        region = top[2]
        if tag in ("article", "main") or tag in BLOCK and tag not in ("p", "li", "dd", "dt", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6") and not self.articles:
            self.regions += 1
            region = self.regions
        self.articles += tag in ("article", "main")
        self.stack.append((tag, drop, region))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                self.pop(depth)
                return
            if tag not in BLOCK and self.stack[depth][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.parts.append(data)


def content(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are content: smoothed ratios of at least their standard deviation."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    smooth = np.convolve(ratios, kernel / kernel.sum(), mode="full")[reach : reach + len(ratios)]
    return smooth >= min(smooth.std(), smooth.max())


def _content_lines(html: str, heed: int) -> tuple[list[str], bool]:
    parser = Lines(heed)
    parser.feed(html)
    parser.close()
    parser.flush()
    if not parser.lines:
        return [], parser.marked
    good = content(np.array([len(t) / n for t, n, _ in parser.lines]))
    kept = {region for (_, _, region), g in zip(parser.lines, good, strict=True) if g}
    return [t for t, _, region in parser.lines if region in kept], parser.marked


def main_text(html: str | None) -> str:
    """The content lines. Marks around an article or main are not heeded if they hide more than is left, and none is if nothing is left, or if the page has no article or main and they hide more."""
    if not html:
        return ""
    lines, marked = _content_lines(html, 2)
    if marked:
        inner, _ = _content_lines(html, 1)
        if 2 * sum(map(len, lines)) < sum(map(len, inner)):
            lines = inner
        if not lines or not _ARTICLE.search(html):
            every, _ = _content_lines(html, 0)
            if 2 * sum(map(len, lines)) < sum(map(len, every)):
                lines = every
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of pages(page_id, url, html); null, empty and textless pages have an empty text.

    Rows stay as they are, repeated or with nulls; other columns are not read; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
