"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams through the page. Block elements end lines; each line has
its characters of text and the number of tags seen since the line before. The ratios of the two
are smoothed by a Gaussian, so that a short paragraph between long ones counts with them, and
lines from a threshold of the page's own spread upwards form the content cluster. Two candidates are
weighed by their smoothed ratios: the articles of the page, which count ``LANDMARK`` times, and the
cluster outside of them. The heavier one selects the region: the articles, or the least element
around all lines of the cluster. It gives all its lines, with lists, quotes, tables and nested blocks.

Elements that cannot hold an article (navigation, headers, footers, asides, forms, scripts, styles
and those whose class, id or role names an advert, notice, menu, sidebar or comments) have ratio
zero and are never selected. A name counts as a whole class or id, or as its first or last part
(``ad-slot``, ``site-footer``); a heading within an article may be called a header. An article in an
element excluded by name alone is judged anew, and an element that holds more than half of the page's
text is not excluded by name, unless the name is one of comments.

Defined results: null or empty pages, and pages without text, give the empty string; unclosed
elements end with the one around them; repeated rows are extracted row by row; an empty table
gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dockpulse.llm.common import map_arrow

#: Lines on either side that smoothing takes in, and the width of the Gaussian.
RADIUS = 2
SIGMA = 1.0
#: How many times the ratios of articles count.
LANDMARK = 40.0
#: Part of the threshold that a line of the cluster has by its own ratio.
OWN = 0.1

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_NEVER = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form head iframe map menu nav "
    "noscript object script select style svg template textarea title video".split()
)
_ARTICLE = frozenset(["article", "main"])
#: Blocks that belong to the region around them.
_LEAVES = frozenset("dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre".split())
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "status toolbar".split()
)
_NAME = (
    r"(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|consent|cookies?|disqus|"
    r"footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|"
    r"pagination|popup|promo\w*|recommend\w*|related|replies|respond|search|share|sidebar|signup|"
    r"skip|social|sponsor\w*|subscribe|tags|toolbar|widget{})"
)
_NAMES = {
    inside: re.compile(rf"(?:^|\s)(?:{name}(?:[_-]\S*)?|\S*[_-]{name})(?:$|\s)")
    for inside, name in ((True, _NAME.format("")), (False, _NAME.format("|header")))
}
_COMMENTS = re.compile(r"(?:^|\s)(?:comments?|replies|respond|disqus)(?:[_-]\S*)?(?:$|\s)")
#: Stand for the tag of an element that is excluded by its name alone.
_NAMED, _COMMENTED = "#name", "#comments"
#: A tag, comment or declaration that the page ends in.
_UNFINISHED = re.compile("<[A-Za-z/!?]")
#: An element of these ends an open one of the same kind of its own accord.
_CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}


class _Lines(HTMLParser):
    """Lines of a page with their tags, region and whether they may be content."""

    def __init__(self, spared: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.spared = spared  # elements, by number, that are not excluded by name
        self.named: list[int] = []  # characters in each element of an excluding name
        self.characters = 0
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.regions: list[int] = []
        self.allowed: list[bool] = []
        self.landmark: dict[int, bool] = {}
        self.around: dict[int, int] = {}  # the region that a region stands in
        # Open elements: tag, tag that excludes it or "", region, inside an article, and whether
        # an excluded inline element mutes it, whose text is no part of the line around.
        # Last the numbers of the elements of excluding names around.
        self._open: list[tuple[str, str, int, bool, bool, tuple[int, ...]]] = [
            ("", "", 0, False, False, ())
        ]
        self._next_region = 1
        self._parts: list[str] = []
        self._tag_count = 0

    def end_line(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self._parts = []
            if text:
                _, excluded, region, inside, *_ = next(e for e in reversed(self._open) if not e[4])
                self.texts.append(text)
                self.tags.append(self._tag_count)
                self.regions.append(region)
                self.allowed.append(not excluded)
                self.landmark[region] = inside
                self._tag_count = 0

    def handle_starttag(self, tag, attrs):
        self._tag_count += 1
        if tag in _BLOCK:
            self.end_line()
            self._close_implied(tag)
        elif tag == "br":
            self._parts.append(" ")
        if tag in _VOID:
            return
        _, excluded, region, inside, muted, names = self._open[-1]
        article = tag in _ARTICLE
        if article and excluded in ("form", _NAMED):  # a form or wrapper around the whole page
            excluded, muted = "", False
        if excluded in ("", _NAMED):
            if self._excludes(tag, attrs, inside):
                excluded = tag
            elif tag not in ("html", "body") and self._is_named(attrs, _COMMENTS):
                excluded = _COMMENTED
            elif tag not in ("html", "body") and self._is_named(attrs, _NAMES[inside]):
                number = len(self.named)
                self.named.append(0)
                names = (*names, number)
                if number not in self.spared:
                    excluded = _NAMED
            muted = muted or bool(excluded) and tag not in _BLOCK
        if article and not inside and not excluded:
            region, inside = self._new_region(region), True
        elif tag in _BLOCK - _LEAVES and not inside:
            region = self._new_region(region)
        self._open.append((tag, excluded, region, inside, muted, names))

    def _new_region(self, around: int) -> int:
        region = self._next_region
        self._next_region += 1
        self.around[region] = around
        return region

    def around_all(self, regions: set[int]) -> set[int]:
        """The least region that holds all of these, and all regions in it."""
        for region in range(max(regions), 0, -1):  # a region has a larger number than that around it
            if len(regions) == 1:
                break
            if region in regions:
                regions.remove(region)
                regions.add(self.around[region])
        held = set(regions)
        for region, around in self.around.items():
            if around in held:
                held.add(region)
        return held

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._tag_count += 1
        if tag in _BLOCK:
            self.end_line()
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth][0] == tag:
                if tag not in _BLOCK and any(e[0] in _BLOCK for e in self._open[depth + 1 :]):
                    return  # an inline end tag does not end the blocks within
                del self._open[depth:]
                return

    def handle_data(self, data):
        _, excluded, _, _, muted, names = self._open[-1]
        if excluded in ("", _NAMED, _COMMENTED):
            length = len("".join(data.split()))
            self.characters += length
            for number in names:
                self.named[number] += length
        if not muted:
            self._parts.append(data)

    def close(self):
        if _UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        super().close()
        self.end_line()

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, and an item the item before it."""
        closed = _CLOSES.get(tag, frozenset())
        for depth in range(len(self._open) - 1, 0, -1):
            name = self._open[depth][0]
            if name == "p" or name in closed:
                del self._open[depth:]
            elif name in _BLOCK:
                return

    @staticmethod
    def _excludes(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
        if tag in _NEVER or (tag == "header" and not inside):
            return True
        for name, value in attrs:
            if name == "role":
                if (value or "").lower() in _ROLES:
                    return True
            elif name == "hidden":
                return True
            elif name == "style" and "display:none" in (value or "").replace(" ", "").lower():
                return True
        return False

    @staticmethod
    def _is_named(attrs: list[tuple[str, str | None]], names: re.Pattern) -> bool:
        return any(
            name in ("class", "id") and bool(names.search((value or "").lower())) for name, value in attrs
        )


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean of each ratio and those of its neighbours; beyond the ends there is nothing."""
    weights = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    total = np.convolve(ratios, weights)[RADIUS : len(ratios) + RADIUS]
    return total / weights.sum()


def _read(html: str, spared: frozenset[int] = frozenset()) -> _Lines:
    page = _Lines(spared)
    page.feed(html)
    page.close()
    return page


def main_text(html: str) -> str:
    """The text of the selected regions, one block to a line."""
    page = _read(html)
    most = frozenset(i for i, n in enumerate(page.named) if 2 * n > page.characters)
    if most:
        page = _read(html, most)
    if not any(page.allowed):
        return ""
    allowed = np.array(page.allowed)
    lengths = np.array([len(t) for t in page.texts], float)
    ratios = np.where(allowed, lengths / np.maximum(page.tags, 1), 0.0)
    smooth = np.where(allowed, smoothed(ratios), 0.0)
    # A line of links beside long text has its neighbours' weight, but none of its own.
    content = allowed & (smooth >= smooth.std()) & (ratios >= OWN * smooth.std())
    if not content.any():  # no line stands out
        content = allowed
    regions = np.array(page.regions)
    articles = {r for r in set(regions[allowed].tolist()) if page.landmark[r]}
    in_article = allowed & np.isin(regions, list(articles))
    elsewhere = content & ~in_article
    # Each candidate is smoothed by itself: lines of one lend no weight to the other.
    landmark = LANDMARK * smoothed(ratios[in_article]).sum() if articles else 0.0
    others = smoothed(ratios[elsewhere]).sum() if elsewhere.any() else 0.0
    if articles and landmark >= others:
        chosen = articles
    else:
        chosen = page.around_all(set(regions[elsewhere if elsewhere.any() else content].tolist()))
    kept = [
        text
        for text, region, may in zip(page.texts, page.regions, page.allowed)
        if may and region in chosen
    ]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    schema = StructType(
        [
            StructField("page_id", LongType()),
            StructField("url", StringType()),
            StructField("text", StringType()),
            StructField("n_chars", LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            texts = [main_text(html or "") for html in batch.column(2).to_pylist()]
            yield [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return map_arrow(rows, schema, run)
