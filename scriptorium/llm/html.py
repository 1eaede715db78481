"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's streaming parser yields events; each block of a page is a line.
A line has a text-to-tag ratio: characters of text outside links for each tag in it. The
ratios are smoothed by a Gaussian and clustered by a threshold (content against
boilerplate, after Weninger, Hsu and Han, "CETR", 2010). The main text is all that the
clusters mark as content, wherever it stands, and with it short lines beside it: all lines
of articles and of the section that holds most of the content, the lines that run up to
that section or on from it, and those between two content lines of one section.

Elements whose role is boilerplate are left out, and elements whose class names say nothing
else than that; where that would leave nothing, class names do not count. Time and memory
are linear in a page, however deeply it is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements of HTML by their role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript iframe object svg math canvas audio video select textarea button head title datalist option".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog search".split())
REGIONS = frozenset("article main section div body td html".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "dd", "dt", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "li"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# Words of class names and ids that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar sidebar sidenav aside rail breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus replies respond related recommended recommendations pagination pager widget widgets copyright disclaimer skip hidden form".split())
#: With these, a class name describes a layout or a state.
LAYOUT = frozenset("has no with without is layout grid".split())
#: What may stand beside a mark without making it a word of the article: form-factor and related-work are no marks.
GENERIC = frozenset("main site page left right top bottom inner outer box block area section list lists item items post posts article articles entry entries story stories link links bar bars container wrap wrapper holder content text group primary secondary panel zone region body module small large mobile desktop global local sticky fixed row col column columns unit slot label title heading button buttons icon icons media set my the app".split())
CONTENT = frozenset("article post entry story content page section title".split())
#: Marks by which an article element is not the page's own article.
INSIDE_LISTS = frozenset("ad ads advert advertisement promo sponsored comment comments replies respond related recommended widget".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")

SIGMA, RADIUS = 1.0, 3


class Line:
    """A block's text, its characters in links, tags since the line before, innermost region, and how many elements had been left out before it."""

    __slots__ = ("text", "linked", "tags", "region", "gap")

    def __init__(self, text: str, linked: int, tags: int, region: int, gap: int):
        self.text, self.linked, self.tags, self.region, self.gap = text, linked, tags, region, gap

    @property
    def own(self) -> int:
        """Characters outside links."""
        return len(self.text) - min(self.linked, len(self.text))


class Blocks(HTMLParser):
    """Turns events into lines. Regions are numbered as they begin; up has each one's parent, last the highest number inside it."""

    def __init__(self, by_class: bool):
        super().__init__(convert_charrefs=True)
        self.by_class, self.named = by_class, False
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool]] = []
        self.open: dict[str, int] = {}
        self.inside = [0]
        self.kind, self.up, self.last = ["html"], [0], [0]
        self.dropped, self.linked, self.tags, self.gap = 0, 0, 0, 0
        self.text: list[str] = []
        self.in_links = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.in_links, self.tags, self.inside[-1], self.gap))
            self.tags = 0
        self.text, self.in_links = [], 0

    def boilerplate(self, tag: str, attrs: list) -> bool:
        if tag in BOILERPLATE and not (tag == "header" and self.open.get("article")):
            return True
        if tag in ("html", "body", "main"):
            return False
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v in ROLES:
                return True
            if k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
                return True
            if self.by_class and k in ("class", "id") and v and any(self.marked(name, tag) for name in v.split()):
                self.named = True
                return True
        return False

    def marked(self, name: str, tag: str) -> bool:
        """Whether one class name or id says that its element is boilerplate, and nothing else."""
        words = {w.lower() for w in WORD.findall(name)}
        marks = words & MARKS
        if words & LAYOUT or words - MARKS - GENERIC:
            return False
        if tag == "article":
            marks &= INSIDE_LISTS
        if words & CONTENT:
            marks -= {"header", "masthead", "banner"}
        return bool(marks)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P:
                self.close_to({"p"}, REGIONS | {"li", "th", "caption", "blockquote"} | BOILERPLATE)
            elif tag in SAME_LEVEL:
                self.close_to(SAME_LEVEL[tag], {"ul", "ol", "menu", "dl", "table"} if tag not in ("td", "th") else {"table", "tr"})
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        drop = tag in SKIPPED or self.boilerplate(tag, attrs)
        self.stack.append((tag, drop))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.dropped += drop
        self.gap += drop and tag not in SKIPPED
        self.linked += tag == "a"
        if tag in REGIONS:
            self.up.append(self.inside[-1])
            self.inside.append(len(self.kind))
            self.last.append(len(self.kind))
            self.kind.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def close_to(self, tags: set, stop: set) -> None:
        """Ends the innermost open element of these, if nothing of stop lies between."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self.pop(i)
                return
            if self.stack[i][0] in stop:
                return

    def pop(self, i: int) -> None:
        while len(self.stack) > i:
            tag, drop = self.stack.pop()
            self.open[tag] -= 1
            self.dropped -= drop
            self.linked -= tag == "a"
            if tag in REGIONS:
                r = self.inside.pop()
                self.last[self.up[r]] = max(self.last[self.up[r]], self.last[r])

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return
            if self.stack[i][0] in REGIONS and tag not in REGIONS and tag not in BOILERPLATE:
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
            if self.linked:
                self.in_links += len(data)

    def finish(self) -> None:
        self.close()
        self.flush()
        self.pop(0)

    def holds(self, region: int, other: int) -> bool:
        return region <= other <= self.last[region]


def smoothed(x: np.ndarray) -> np.ndarray:
    reach = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    padded = np.concatenate([np.zeros(RADIUS), x, np.zeros(RADIUS)])
    return np.convolve(padded, kernel / kernel.sum(), "same")[RADIUS:-RADIUS]


def threshold(x: np.ndarray) -> float:
    """Between the two clusters of the smoothed ratios: their means settle by turns."""
    t = x.mean()
    for _ in range(20):
        low, high = x[x < t], x[x >= t]
        if not len(low) or not len(high):
            return 0.0
        new = (low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return min(t, x.std())


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by an empty line; empty for null or no content."""
    if not page:
        return ""
    for by_class in (True, False):
        parser = Blocks(by_class)
        parser.feed(page)
        parser.finish()
        if parser.lines or not parser.named:
            break
    return "\n\n".join(x.text for x, keep in zip(parser.lines, chosen(parser), strict=True) if keep)


def chosen(page: Blocks) -> list[bool]:
    """Which lines are the main text."""
    lines = page.lines
    if not lines:
        return []
    ratio = np.array([x.own / max(1, x.tags) for x in lines])
    smooth = smoothed(ratio)
    # smoothing lifts lines of links beside content, which are none
    content = (smooth >= threshold(smooth)) & (ratio > 0)
    weight = [0] * len(page.kind)
    for x, c in zip(lines, content.tolist(), strict=True):
        if c:
            weight[x.region] += x.own
    for r in range(len(weight) - 1, 0, -1):
        weight[page.up[r]] += weight[r]
    if not weight[0]:
        return [False] * len(lines)
    marked = [r for r, w in enumerate(weight) if page.kind[r] in ("article", "main") and w >= 0.3 * weight[0]]
    if marked:
        best = max(marked, key=lambda r: (page.kind[r] == "article", weight[r], -r))
    else:  # the innermost region with nearly all of the content
        best = max(r for r, w in enumerate(weight) if w >= 0.8 * weight[0])
    whole = [r == best or page.kind[r] == "article" and w > 0 for r, w in enumerate(weight)]
    for r in range(1, len(whole)):
        whole[r] = whole[r] or whole[page.up[r]]
    keep = [c or whole[x.region] for x, c in zip(lines, content.tolist(), strict=True)]
    if not marked:
        around(page, best, ratio, keep)
    at = np.flatnonzero(content).tolist()
    for i, j in zip(at, at[1:]):
        if lines[i].region == lines[j].region:
            for k in range(i + 1, j):
                keep[k] = keep[k] or ratio[k] > 0 and page.holds(lines[i].region, lines[k].region)
    return keep


def around(page: Blocks, best: int, ratio: np.ndarray, keep: list[bool]) -> None:
    """Keeps the lines that stand in what surrounds the best region and run up to it, or on from it, with nothing left out between."""
    lines = page.lines
    inside = [k for k, x in enumerate(lines) if page.holds(best, x.region)]
    for start, step in ((inside[0], -1), (inside[-1], 1)):
        k = start + step
        while 0 <= k < len(lines) and ratio[k] > 0 and lines[k].gap == lines[k - step].gap and page.holds(lines[k].region, best):
            keep[k] = True
            k += step


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """(id, text) of each page row, and the columns named in carry; whole pages; null or empty html gives an empty text.

    Broken markup (elements that never end, stray ends) is read much as browsers do.
    Repeated rows give a row each; other columns are ignored.
    """

    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.record_batch([batch.column(0), text, *(batch.column(2 + i) for i in range(len(carry)))], ["id", "text", *carry])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), *carry)
    return rows.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *(pages.schema[c] for c in carry)]))
