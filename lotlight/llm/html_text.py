"""Main text of web pages by text-to-tag ratios over parser events.

The standard library's parser streams events; block elements and line breaks
end a line.  Every line has the ratio of its text to the tags within it.  The
ratios are smoothed with a Gaussian over neighbouring lines and split into two
clusters; the lines of the upper cluster show which region of the page holds
the content, on every page.  An article or main element is chosen whole where
it holds at least ``HELD`` of that content, and counts as any other region
where it doesn't.  All lines of the chosen region are kept, so that a short
paragraph between long ones stays.

Elements that never hold article text (navigation, headers, footers, asides,
forms, scripts, styles, roles of that kind) are left out before, and so are
elements with a class or id that is such a name or begins with one
(``comments``, ``cookie-bar``).  Other names (``share-price-news``,
``social-history``) are a vote: the element is left out unless it holds at
least half of the page's text and no article or main stands outside it.
Words about layout (``with-sidebar``) say nothing.

Time and memory are linear in the page, however deep its elements nest: lines
know their region, regions their parent, and weights are summed once.

Inline elements, also those left out, never end a line.

Defined cases: null, empty or tag-only html gives an empty text; text
without any markup is one line; every cell of a table is a line; unclosed elements end with the element around
them, an unclosed comment with the page; marked sections and unknown declarations are comments; very
long pages are read whole; repeated rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import row_slices

#: Element names by role.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title nav header footer aside form script style noscript template svg math iframe object select button textarea dialog menu canvas audio video map datalist input".split())
REGIONS = frozenset("article main section div td body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "caption", "body", "html"}
#: Names of what is no article, as whole words or as their beginnings.
CLEAR = "ads advert* adsense sponsor* banner* sidebar* nav* menu* breadcrumb* masthead footer* copyright comment* replies respond disqus cookie* consent popup* modal newsletter subscri* pagination pager skip*".split()
#: Names that are a vote only, where they are one part of a word.
HINTS = "ad promo* side header discussion notice* notification* alert alerts overlay signup login share sharing social related recommend* widget* toolbar hidden".split()
#: Parts that make a word one about layout.
LAYOUT = frozenset("with without has no".split())
#: The share of a page's text from which a vote does not count.
MOST = 0.5

#: The share of content that a chosen region holds at least.
HELD = 0.8
#: Clusters whose means are closer than this factor are one.
APART = 2.0
SIGMA = 1.5
RADIUS = 4


def _pattern(names: list[str]) -> re.Pattern:
    return re.compile("|".join(n.replace("*", r"\w*") for n in names), re.I)


_clear, _any = _pattern(CLEAR), _pattern([*CLEAR, *HINTS])


def named(words: str) -> int:
    """2 where a class or id says clearly that an element is no article, 1 for a vote, else 0."""
    found = 0
    for word in words.split():
        parts = re.split("[_-]+", word.lower())
        if parts[0] in LAYOUT:
            continue
        if _any.fullmatch(word) or _clear.fullmatch(parts[0]):
            return 2
        if any(_any.fullmatch(part) for part in parts):
            found = 1
    return found


class Lines(HTMLParser):
    """Collects lines as (text, tags, region); region ``r`` has the parent
    ``parents[r]``, which is smaller, and is a vote where ``votes[r]``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.ending = False
        self.open: list[tuple[str, bool, bool]] = []  # name, left out, a region
        self.places: dict[str, list[int]] = {}  # open elements by name
        self.walls: dict[str, list[int]] = {"block": [], "region": []}
        self.regions = [0]
        self.parents, self.kinds, self.votes = [0], ["body"], [False]
        self.dropped = 0
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []

    def line_end(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.regions[-1]))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.line_end()
        if tag in ENDS_P and tag != "li" and self.places.get("p"):
            self._close("p")
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self._close("li")
        self.tags += 1
        if tag in VOID:
            return
        a = dict(attrs)
        says = 0 if tag in ("html", "body", "article", "main") else named(f"{a.get('class') or ''} {a.get('id') or ''}")
        gone = tag in DROPPED or "hidden" in a or (a.get("role") or "").lower() in ROLES or (a.get("aria-hidden") or "").lower() == "true" or says == 2
        self.dropped += gone
        region = not self.dropped and (tag in REGIONS or says == 1)
        at = len(self.open)
        self.open.append((tag, gone, region))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self.walls["block"].append(at)
        if tag in REGIONS:
            self.walls["region"].append(at)
        if region:
            self.parents.append(self.regions[-1])
            self.kinds.append(tag)
            self.votes.append(says == 1)
            self.regions.append(len(self.parents) - 1)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.line_end()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.line_end()
        self.tags += 1
        self._close(tag)

    def _close(self, tag: str) -> None:
        """End the innermost open element of this name and all within it; an
        inline end tag doesn't reach beyond the block it stands in."""
        places = self.places.get(tag)
        if not places:
            return
        walls = self.walls["region"] if tag == "p" else [] if tag in BLOCKS else self.walls["block"]
        if walls and walls[-1] > places[-1]:
            return
        for at in range(len(self.open) - 1, places[-1] - 1, -1):
            name, gone, region = self.open.pop()
            self.places[name].pop()
            self.dropped -= gone
            if name in BLOCKS:
                self.walls["block"].pop()
            if name in REGIONS:
                self.walls["region"].pop()
            if region:
                self.regions.pop()

    def parse_marked_section(self, i, report=1):
        """A marked section, of whatever name, is a comment up to the next ``>``."""
        return self.parse_bogus_comment(i)

    def parse_comment(self, i, report=1):
        """A comment that nothing ends reaches to the end of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.ending else end

    def close(self):
        self.ending = True
        super().close()

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)


def smoothed(values: list[float]) -> list[float]:
    """Gaussian average over neighbouring lines."""
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(RADIUS + 1)]
    out = []
    for i in range(len(values)):
        total = part = 0.0
        for j in range(max(0, i - RADIUS), min(len(values), i + RADIUS + 1)):
            w = weights[abs(i - j)]
            total += w * values[j]
            part += w
        out.append(total / part)
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of two clusters (two-means in one dimension)."""
    low, high = min(values), max(values)
    for _ in range(50):
        middle = (low + high) / 2
        below = [v for v in values if v <= middle]
        above = [v for v in values if v > middle]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def below(parents: list[int], own: list[float]) -> list[float]:
    """What each region holds with all regions in it."""
    out = list(own)
    for r in range(len(out) - 1, 0, -1):
        out[parents[r]] += out[r]
    return out


def within(parents: list[int], chosen: list[bool]) -> list[bool]:
    """Whether a region or one around it is chosen."""
    out = list(chosen)
    for r in range(1, len(out)):
        out[r] = out[r] or out[parents[r]]
    return out


def voted_out(page: Lines) -> list[bool]:
    """Regions that are left out by a vote, and those within them."""
    sizes, marks = [0.0] * len(page.parents), [0.0] * len(page.parents)
    for text, _, r in page.lines:
        sizes[r] += len(text)
    for r, kind in enumerate(page.kinds):
        marks[r] = float(kind in ("article", "main"))
    sizes, marks = below(page.parents, sizes), below(page.parents, marks)
    keeps = [size >= MOST * sizes[0] and mark == marks[0] for size, mark in zip(sizes, marks)]
    return within(page.parents, [vote and not keep for vote, keep in zip(page.votes, keeps)])


def main_text(html: str | None) -> str:
    """Blocks of the main content, one a line."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.line_end()
    gone = voted_out(page)
    lines = [x for x in page.lines if not gone[x[2]]]
    if not lines:
        return ""
    ratios = smoothed([len(t) / max(1, tags) for t, tags, _ in lines])
    edge = threshold(ratios)
    low, high = [r for r in ratios if r < edge], [r for r in ratios if r >= edge]
    if low and sum(high) * len(low) < APART * sum(low) * len(high):
        edge = 0.0  # one kind of lines only
    # the text of content lines in each region
    weight = [0.0] * len(page.parents)
    for (text, _, r), ratio in zip(lines, ratios):
        weight[r] += len(text) if ratio >= edge else 0.0
    weight = below(page.parents, weight)
    inner: list[int] = [0] * len(weight)  # the child that holds most content, 0 where there is none
    for r in range(1, len(weight)):
        if inner[page.parents[r]] == 0 or weight[r] > weight[inner[page.parents[r]]]:
            inner[page.parents[r]] = r
    # go down while one inner region holds nearly all content
    chain = [0]
    while inner[chain[-1]] and weight[inner[chain[-1]]] >= HELD * weight[0]:
        chain.append(inner[chain[-1]])
    # an article or main on the way is kept whole
    whole = [r for kind in ("article", "main") for r in chain if page.kinds[r] == kind]
    region = whole[0] if whole else chain[-1]
    kept = within(page.parents, [r == region for r in range(len(weight))])
    return "\n".join(t for t, _, r in lines if kept[r])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            for lo, n in row_slices(batch.column(2)):
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
