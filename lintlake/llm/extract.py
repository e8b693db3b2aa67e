"""HTML main-content extraction by smoothed text-to-tag ratios.

``html.parser`` streams over a page once.  Its events cut the page into lines, one per block
element, and count the characters and tags of each.  The ratio of characters to tags is
smoothed over neighbouring lines with a Gaussian, lines above a threshold are clustered into
regions, and the innermost sectioning element that holds all regions gives the main text, with its
heading.  Elements that are never
main text (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are known from their tag, role or class and have the ratio 0.  A class or id, a form, or a menu that is never
ended is only a hint: alone it leaves out no article, nothing that holds an article, main or h1, and nothing that
holds most of the text of a page without an article or main elsewhere.

Defined cases: a null or empty page gives an empty text; a page without any text line gives an
empty text; an unfinished tag at the end of a page is markup and is dropped; repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
RADIUS = 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset(
    "head title script style template noscript iframe object svg math canvas audio video button select textarea "
    "option nav menu footer aside dialog input".split())
UNENDED = frozenset("form nav aside header footer menu".split())  # where one is never ended, the text below ends it
MARKS = frozenset("article main h1".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notification popup modal overlay newsletter subscribe subscription signup sidebar sidenav menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist reply "
    "replies disqus respond share sharing social related recommended widget widgets".split())
COMMENTS = frozenset("comment comments commentlist reply replies disqus respond".split())
BEFORE = frozenset("has no not with without show hide".split())  # these make the words after them in a class name no hint
AFTER = frozenset("free on off enabled disabled".split())  # these, as the last word, the words before them
CONTAINERS = frozenset("html body main article section div center".split())  # what can be the main element
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_SECTIONS = re.compile(rf"<(/?)({'|'.join(sorted(UNENDED))})(?=[\s>/])", re.I)
_OPEN_END = re.compile(r"<(?:!--(?:(?!-->).)*|[A-Za-z/!?][^<>]*)\Z", re.S)


class Line:
    """The text of one block: its pieces with the element around each, the tags met in it and, once it
    is known what is left out, the elements around it."""

    __slots__ = ("pieces", "tags", "path", "text")

    def __init__(self) -> None:
        self.pieces: list[tuple[str, int]] = []
        self.tags = 1
        self.path: tuple[int, ...] = ()
        self.text = ""


def _hint(value: str) -> int:
    """0 if a class or id is no hint, 2 if it hints at reader comments, or else 1."""
    made = 0
    for name in value.split():
        words = _WORDS.findall(_CAMEL.sub(r"\1 \2", name).lower())
        for k, word in enumerate(words):
            if word in HINTS and BEFORE.isdisjoint(words[:k]) and (words[-1] not in AFTER or k == len(words) - 1):
                made = max(made, 2 if word in COMMENTS else 1)
    return made


class Events(HTMLParser):
    """Turns parser events into lines.  ``kinds``, ``parents`` and ``hints`` have the tag, the number of the
    element around and the hint of each element by number."""

    def __init__(self, unended: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.unended = unended  # tags with more starts than ends on this page
        self.lines: list[Line] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.hints: list[int] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, number, whether its text is left out
        self.here: Line | None = None

    def _left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in HIDDEN and tag not in self.unended:
            return True
        if tag == "label":  # of a control; elsewhere it is text
            return any(kind == "form" for kind, _, _ in self.open)
        if tag == "header":
            return not any(kind in ("article", "main") for kind, _, _ in self.open)
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and (value or "").strip().lower() in ROLES:
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        return False

    def _push(self, tag: str, left_out: bool, hint: int) -> None:
        self.parents.append(self.open[-1][1] if self.open else -1)
        self.hints.append(hint)
        self.open.append((tag, len(self.kinds), left_out or bool(self.open and self.open[-1][2])))
        self.kinds.append(tag)

    def _pop(self, tag: str, upto: frozenset[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in upto:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if tag in MARKS and self.unended:
            outer = next((k for k, (kind, _, _) in enumerate(self.open) if kind in self.unended), None)
            if outer is not None:
                del self.open[outer:]
        if block:
            self.here = None
            # What HTML lets authors leave open: a block ends a paragraph, an item ends the item before it.
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            if tag == "li":
                self._pop("li", frozenset(("ul", "ol", "menu")))
            elif tag in ("dt", "dd"):
                self._pop("dt", frozenset(("dl",)))
                self._pop("dd", frozenset(("dl",)))
            elif tag in ("td", "th"):
                self._pop("td", frozenset(("tr", "table")))
                self._pop("th", frozenset(("tr", "table")))
            elif tag == "tr":
                self._pop("tr", frozenset(("table",)))
        elif self.here is not None:
            self.here.tags += 1
            if tag == "br":
                self.here.pieces.append((" ", self.open[-1][1] if self.open else -1))
        if tag in VOID:
            return
        left_out = self._left_out(tag, attrs)
        hint = 0 if left_out or tag in ("html", "body", "main") else max((_hint(v) for n, v in attrs if n in ("class", "id") and v), default=0)
        if not left_out and (tag == "form" or tag in self.unended):
            hint = max(hint, 1)  # whole pages can stand in one
        if block or left_out or hint:
            self._push(tag, left_out, hint)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.here = None
            self._pop(tag)
        else:
            if self.here is not None:
                self.here.tags += 1
            if any(kind == tag for kind, _, _ in self.open):
                self._pop(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        if self.here is None:
            if not data.strip():
                return
            self.here = Line()
            self.lines.append(self.here)
        self.here.pieces.append((data, self.open[-1][1] if self.open else -1))

    def hinted_out(self) -> list[bool]:
        """Which elements are left out by hints, their own or one of an element around them."""
        n = len(self.kinds)
        if not any(self.hints):
            return [False] * n
        sizes = [0] * n  # characters in each element
        total = 0
        for line in self.lines:
            for piece, number in line.pieces:
                size = len(piece.strip())
                total += size
                if number >= 0:
                    sizes[number] += size
        ends = list(range(n))  # last element within each; elements within another have the numbers after its own
        for k in range(n - 1, -1, -1):
            if (parent := self.parents[k]) >= 0:
                sizes[parent] += sizes[k]
                ends[parent] = max(ends[parent], ends[k])
        marks = [k for k in range(n) if sizes[k] and self.kinds[k] in ("article", "main", "h1")]

        def most(k: int) -> bool:
            # Not where an article or main stands apart, however short.  Reader comments are often longer than what
            # they are about, so for them an article, main or h1 around or beside is enough.
            if 2 * sizes[k] <= total:
                return False
            outside = [m for m in marks if not k <= m <= ends[k]]
            if self.hints[k] == 2:
                return not any(sizes[m] > (sizes[k] if m < k <= ends[m] else 0) for m in outside)
            return not any(self.kinds[m] != "h1" and not m < k <= ends[m] for m in outside)

        def holds(k: int, of: list[int]) -> bool:
            at = bisect_left(of, k)
            return at < len(of) and of[at] <= ends[k]

        large = [bool(self.hints[k]) and most(k) for k in range(n)]
        # Around each element: whether a hint is, and whether an article is.
        doubted, nested = [False] * n, [False] * n
        for k in range(n):
            if (parent := self.parents[k]) >= 0:
                doubted[k] = doubted[parent] or bool(self.hints[parent]) and not large[parent]
                nested[k] = nested[parent] or self.kinds[parent] == "article"
        # An article with a hint in an element with a hint, or in another article, does not rest on one hint alone.
        articles = [k for k in marks if self.kinds[k] == "article" and not (self.hints[k] and (doubted[k] or nested[k]))]
        others = [k for k in marks if self.kinds[k] != "article"]
        made = [False] * n
        for k in range(n):
            made[k] = self.parents[k] >= 0 and made[self.parents[k]] or bool(self.hints[k]) and not (
                large[k] or holds(k, others) or not nested[k] and holds(k, articles))
        return made


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian-weighted means over the neighbouring lines."""
    weights = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    made = []
    for i in range(len(ratios)):
        total = norm = 0.0
        for k, weight in enumerate(weights, i - RADIUS):
            if 0 <= k < len(ratios):
                total += weight * ratios[k]
                norm += weight
        made.append(total / norm)
    return made


def regions(ratios: list[float]) -> list[bool]:
    """Which lines are content: two clusters of the smoothed ratios, split at the threshold that
    lies midway between their means (one-dimensional 2-means from the extremes)."""
    values = smoothed(ratios)
    if not values:
        return []
    low, high = min(values), max(values)
    if high <= low:
        return [True] * len(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        new = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    cut = (low + high) / 2
    # Content may be all there is: only a clear gap makes a lower cluster.
    if low > 0.5 * high:
        return [True] * len(values)
    return [v > cut for v in values]


def _unended(html: str) -> frozenset[str]:
    """Tags that start more often than they end."""
    seen = {tag: 0 for tag in UNENDED}
    for end, tag in _SECTIONS.findall(html):
        seen[tag.lower()] += -1 if end else 1
    return frozenset(tag for tag, n in seen.items() if n > 0)


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by an empty line."""
    if not html:
        return ""
    if "<" in html[html.rfind(">") + 1:]:
        html = _OPEN_END.sub("", html)
    events = Events(_unended(html))
    events.feed(html)
    events.close()
    out = events.hinted_out()
    lines = []
    for line in events.lines:
        kept = [(piece, number) for piece, number in line.pieces if number < 0 or not out[number]]
        line.text = " ".join("".join([piece for piece, _ in kept]).split())
        if line.text:
            path, number = [], next(number for piece, number in kept if piece.strip())
            while number >= 0:
                path.append(number)
                number = events.parents[number]
            line.path = tuple(reversed(path))
            lines.append(line)
    if not lines:
        return ""
    chosen = regions([len(line.text) / line.tags for line in lines])
    # The element that holds the regions: the innermost container with all of the selected text.  Where
    # article or main have selected text, only what is in them counts.
    picked = [k for k, content in enumerate(chosen) if content]
    roots = {k: _root(lines[k], events.kinds) for k in picked}
    named = [k for k in picked if roots[k] is not None]
    common = set.intersection(*[set(lines[k].path) for k in named or picked])
    best = max((n for n in common if events.kinds[n] in CONTAINERS), default=None)
    inside = [k for k, line in enumerate(lines) if best is None or best in line.path]
    if best is None or events.kinds[best] in ("html", "body"):
        # No element of its own: from the first region to the last, or from the first article to the last.
        held = {roots[k] for k in named}
        ends = [k for k in inside if not held.isdisjoint(lines[k].path)] if named else picked
        inside = list(range(ends[0], ends[-1] + 1))
    return "\n\n".join(lines[k].text for k in _headed(inside, lines, events.kinds))


def _root(line: Line, kinds: list[str]) -> int | None:
    """The outermost article or main around a line."""
    return next((n for n in line.path if kinds[n] in ("article", "main")), None)


def _headed(inside: list[int], lines: list[Line], kinds: list[str]) -> list[int]:
    """Lines of a text, with its heading and what stands between where that precedes its element: the
    nearest h1 within the same article or main, or before it on a page without them, and the h1 and h2 directly before."""

    def heads(k: int, *tags: str) -> bool:
        return any(kinds[n] in tags for n in lines[k].path)

    first = inside[0]
    if any(heads(k, "h1") for k in inside):
        return inside
    root = _root(lines[first], kinds)
    if root is not None or all(_root(line, kinds) is None for line in lines):
        first = next((k for k in range(first - 1, -1, -1) if (root is None or root in lines[k].path) and heads(k, "h1")), first)
    while first and heads(first - 1, "h1", "h2") and _root(lines[first - 1], kinds) == root:
        first -= 1
    return [*range(first, inside[0]), *inside]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return (pages.selectExpr("cast(page_id AS bigint) AS page_id", "cast(url AS string) AS url", "cast(html AS string) AS html")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
