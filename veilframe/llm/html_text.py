"""Main text of web pages from parser events: text-to-tag ratio per line, smoothed, clustered by a threshold.

Events of the standard library's HTML parser become lines (one for each block of text).  A line's
text-to-tag ratio is its characters over the tags met in it.  The ratios are smoothed with a Gaussian, and two-means clustering
finds the threshold between poor and rich lines.  The rich lines select the regions: the declared articles, where they hold nearly all of the rich text, or
else the deepest element that has nearly all of their text.  Every line of a region is kept, short ones
too, except what stands in menus, footers, forms, adverts, reader comments and the like, block or inline.

End tags that HTML lets a page leave out are supplied, elements know their parent only, and every step is linear in the page.

Defined results: a null or empty page gives an empty text, as does a page of boilerplate only; a null id or url is kept; each
repeated row is extracted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: elements whose text never belongs to an article
_NEVER = frozenset("head title script style noscript template iframe object svg canvas nav footer aside form button select textarea dialog menu".split())
#: elements that start and end a line
_BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption hr br address details summary header fieldset center".split()) | _NEVER
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: elements that a start tag ends, up to the elements in which it looks
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "thead", "tbody", "tfoot"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}
_ARTICLES = frozenset(("article", "main"))
#: elements that may be chosen as a region
_REGIONS = frozenset("html body main article section div center td fieldset details blockquote".split())
#: words of class and id that mark boilerplate, and those of them that pages also give to an article's frame
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors banner banners cookie cookies consent gdpr sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead siteheader sitefooter pageheader topbar disqus adsbygoogle comment comments reply replies respond newsletter subscribe subscription pagination pager toolbar skiplink login signup".split()
)
_MAYBE = frozenset("promo promos promotion notice notices alert popup modal overlay discussion share sharing social related recommended recommendations widget widgets".split())
#: what follows a marking word in the name of a box of that kind, as in comment-list; other words make it another thing, as in notice-period
_BOXES = frozenset("list box area section wrapper wrap container bar block links link posts articles stories items item panel inner outer content text body form header title thread feed buttons button icons unit slot top bottom left right message popup modal banner bar menu nav widget widgets row col column grid group region holder footer info".split())
_WORDS = re.compile(r"[a-z]+")
_MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: share of the rich lines' text that the chosen element holds at least
_MOST = 0.8
_SIGMA = 1.0
_KERNEL = [math.exp(-(k * k) / (2 * _SIGMA * _SIGMA)) for k in range(-2, 3)]
#: marks of an element: none, perhaps boilerplate, surely
_NO, _PERHAPS, _SURELY = 0, 1, 2


def _name_mark(name: str) -> int:
    """Mark of one class or id: a marking word at its end, or followed by words for boxes only."""
    words, found = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()), _NO
    if "".join(words) in _MARKS:
        return _SURELY
    for w in reversed(words):
        if w in _MARKS:
            return _SURELY
        if w in _MAYBE:
            found = _PERHAPS
        elif w not in _BOXES:
            break
    return found


def _mark(tag: str, attrs: list) -> int:
    found = _NO
    if tag in ("html", "body"):
        return found
    for name, value in attrs:
        if name == "hidden" or value and (name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _MARKED_ROLES):
            return _SURELY
        if value and name in ("class", "id"):
            found = max([found, *map(_name_mark, value.split())])
    return found


class _Events(HTMLParser):
    """Collects lines: (text, tags met, innermost element). Elements are numbered in page order and know their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.tags, self.parents, self.marks = ["html"], [-1], [_NO]
        self._open: list[tuple[str, int]] = [("", 0)]  # tag, number; inline elements only if they are marked
        self._counts: Counter[str] = Counter()
        self._inline = 0  # open marked inline elements
        self._text: list[str] = []
        self._met = 0

    def end_line(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                k = len(self._open) - 1
                while k and self._open[k][0] not in _BLOCKS:
                    k -= 1  # the text is from before the marked inline element
                self.lines.append((text, self._met, self._open[k][1]))
            self._text = []
        self._met = 0

    def _close(self, size: int) -> None:
        """Leaves the innermost elements until ``size`` are open."""
        for tag, _ in self._open[size:]:
            self._counts[tag] -= 1
            self._inline -= tag not in _BLOCKS
        del self._open[size:]

    def _push(self, tag: str, mark: int) -> None:
        self._open.append((tag, len(self.tags)))
        self._counts[tag] += 1
        self.parents.append(self._open[-2][1])
        self.tags.append(tag)
        self.marks.append(mark)

    def handle_starttag(self, tag, attrs):
        self._met += 1
        if tag not in _BLOCKS:
            if attrs and tag not in _VOID and _mark(tag, attrs):
                self._push(tag, _SURELY)
                self._inline += 1
            return
        if not self._inline:
            self.end_line()
        elif tag == "br":
            return
        if tag in _VOID:
            self._met = 1
            return
        if self._counts["p"]:  # a block ends a paragraph
            self._leave("p")
        elif tag in _ENDS:
            ends, within = _ENDS[tag]
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] in within:
                    break
                if self._open[k][0] in ends:
                    self._finish(k)
                    break
        self.end_line()
        self._met = 1
        mark = _SURELY if tag in _NEVER else _mark(tag, attrs)
        if tag == "header" and not any(self._counts[t] > 0 for t in _ARTICLES):
            mark = _SURELY
        self._push(tag, mark)

    def _finish(self, size: int) -> None:
        self.end_line()
        self._close(size)

    def _leave(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                self._finish(k) if tag in _BLOCKS else self._close(k)
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self._open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._met += 1
        if tag in _VOID:
            return
        if tag in _BLOCKS and not self._inline:
            self.end_line()
        if self._counts[tag] > 0:
            self._leave(tag)

    def handle_data(self, data):
        if not self._inline:
            self._text.append(data)


def _smooth(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i in range(n):
        weight = total = 0.0
        for k, w in enumerate(_KERNEL, i - 2):
            if 0 <= k < n:
                weight += w
                total += w * values[k]
        out.append(total / weight)
    return out


def _threshold(values: list[float]) -> float:
    """Midway between the centres of two clusters (2-means from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _regions(events: _Events, held: list[int], total: int, best: list[float], cut: float) -> set[int]:
    """Elements that make up the main text: ``held`` has the rich text in each one, ``total`` all of it, ``best`` its highest ratio."""
    articles = [n for n, tag in enumerate(events.tags) if tag == "article"]
    if articles and max(held[n] for n in articles) and sum(held[n] for n in articles) >= _MOST * total:
        return {n for n in articles if held[n] or best[n] >= cut / 2}  # siblings too, unless they are mere links
    mains = [n for n, tag in enumerate(events.tags) if tag in _ARTICLES and held[n]]
    if mains:  # a declared article beats a deeper part of it
        return set(mains)
    return {max((n for n, tag in enumerate(events.tags) if tag in _REGIONS and held[n] >= _MOST * total), default=0)}


def extract(html: str | None) -> str:
    """Main text of one page, blocks joined by a line feed."""
    if not html:
        return ""
    events = _Events()
    events.feed(html)
    events.close()
    events.end_line()
    parents, marks = events.parents, events.marks
    for n in range(1, len(marks)):  # what is surely boilerplate, and what stands in such
        if marks[parents[n]] == _SURELY:
            marks[n] = _SURELY
    lines = [x for x in events.lines if marks[x[2]] != _SURELY]
    if not lines:
        return ""
    ratios = _smooth([len(text) / max(1, tags) for text, tags, _ in lines])
    cut = _threshold(ratios)

    def rich_text(of: list) -> list[int]:
        held = [0] * len(parents)
        for text, _, n in of:
            held[n] += len(text)
        for n in range(len(parents) - 1, 0, -1):
            held[parents[n]] += held[n]
        return held

    rich = [x for x, r in zip(lines, ratios) if r >= cut]
    held = rich_text(rich)
    total = held[0]
    # perhaps boilerplate: unless it holds the text that the page is about
    out = [mark == _SURELY or mark == _PERHAPS and held[n] < _MOST * total for n, mark in enumerate(marks)]
    for n in range(1, len(out)):
        out[n] = out[n] or out[parents[n]]
    lines = [x for x in lines if not out[x[2]]]
    held = rich_text([x for x in rich if not out[x[2]]])
    best = [0.0] * len(parents)
    for text, tags, n in lines:
        best[n] = max(best[n], len(text) / max(1, tags))
    for n in range(len(parents) - 1, 0, -1):
        best[parents[n]] = max(best[parents[n]], best[n])
    inside, chosen = _regions(events, held, held[0], best, cut), [False] * len(parents)
    for n in range(len(parents)):
        chosen[n] = n in inside or n > 0 and chosen[parents[n]]
    return "\n".join(text for text, _, n in lines if chosen[n])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for each row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = pa.array([extract(h) for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["id", "url", "text"])

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [source.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = source.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.toDF(id_col, url_col, "text")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
