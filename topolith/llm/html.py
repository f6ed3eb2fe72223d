"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block-level stretch of text. Lines
of scripts, menus, headers, footers, adverts, notices, forms and comments are
emptied by their elements' names, classes and roles, as are lists of three or
more lines of nothing but links outside of ``article``. Over the lines left, text
lengths are summed in a sliding window; a surge starts a stretch of content
and a dive ends it. Every page goes this way. A line in ``article`` or ``main``
weighs a surge more than its text, so that its short lines start a stretch too.

Of the stretches outside of these elements the one with the most text gives the
article there, together with what follows its container's first surge within
the container (an element such as ``div`` that holds the stretch); if only the
page holds it, all of the page's stretches count. Stretches within ``article`` and
``main`` are kept unless there is more text in the article outside, which in turn is
left out unless it has more text than the largest of them.

A class or an id marks an element as no part of the article only if that leaves
one: an element with most of the page's text is kept whatever a word such as
"social" says of it, and one named for comments, menus or notices is kept if next
to nothing is left without it, except beside an ``article`` or ``main``. Adverts
always go. In an article's own ``header`` the headings stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Lines in a window, and the text (in characters) a window needs for a surge.
WINDOW, SURGE = 3, 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTIAL = re.compile(r"&#?\w{0,8}\Z")

# fixed values: element names of the HTML standard
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav header footer aside form button dialog menu label input option fieldset title head select svg math noscript template object canvas".split())
_FALLBACK = frozenset("noscript template object canvas".split())  # may hold any element; without an end tag they hold nothing
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_SCOPE = frozenset("article main".split())
_HOLDERS = frozenset("article body center details div html main section td".split())
_OPTIONAL_END = frozenset("p li dt dd tr td th option thead tbody tfoot caption".split())

def _words(listed: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(listed.split())})(?:$|[\s_-])", re.I)


_ADVERT = _words(r"ads? advert\w* adbox sponsor\w* outbrain taboola byline-ads")
_BOILER = _words(
    r"banner cookies? consent gdpr popup modal overlay newsletter subscri\w* signup login menu nav navbar navigation breadcrumbs? sidebar "
    r"masthead topbar footer comments? replies reply respond disqus outbrain pagination pager toolbar skip"
)
_DOUBTFUL = _words(r"promo\w* notice alert side aside header copyright legal share sharing social related recommend\w* widget tags search form")
_STATE = re.compile(r"(?:^|(?<=\s))(?:no|has|have|with|without|not|is|hide|show)[_-]\S+", re.I)  # says what the page has, not what this is
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


#: How far an element is from the article: by its name or role, an advert, or by a word in its class or id.
_NOT, _DOUBT, _LIKELY, _CERTAIN = range(4)


def _unwanted(tag: str, attrs: str) -> int:
    if tag in _DROPPED:
        return _CERTAIN
    worst = _NOT
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if tag not in ("main", "body", "html"):
                value = _STATE.sub(" ", value)
                found = _CERTAIN if _ADVERT.search(value) else _LIKELY if _BOILER.search(value) else _DOUBT if _DOUBTFUL.search(value) else _NOT
                worst = max(worst, found)
        elif name == "role":
            if value.strip().lower() in _ROLES:
                return _CERTAIN
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return _CERTAIN
    return worst


class Elements:
    """Elements in page order: name, parent, and the last element within; 0 is the page."""

    def __init__(self):
        self.tag, self.parent, self.last = ["html"], [-1], [0]

    def open(self, tag: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.last.append(-1)
        return len(self.tag) - 1

    def close(self, k: int) -> None:
        self.last[k] = len(self.tag) - 1

    def holder(self, first: int, low: int, high: int) -> int:
        """The innermost element that holds ``first`` and all from ``low`` to ``high`` and can hold an article."""
        k = first
        while k and not (k <= low and high <= self.last[k] and self.tag[k] in _HOLDERS):
            k = self.parent[k]
        return 0 if self.tag[k] in ("body", "html") else k


@dataclass
class Page:
    """Lines of a page in order, its elements, and what its classes have emptied."""

    lines: list[tuple[str, int, int, bool]]  # text, scope, element, nothing but links
    elements: Elements
    scopes: list[str]  # names of the scopes from 1 on
    emptied: list[tuple[int, int, int, bool, bool]]  # where an element begins, how far it is, its text, whether outermost, whether in a scope
    bare: bool  # no scope was found outside of emptied elements


def lines(html: str) -> list[tuple[str, int]]:
    """The text of each block in page order, with the scope it lies in."""
    return [(text, scope) for text, scope, *_ in parse(html).lines]


def parse(html: str, surge: int = SURGE) -> Page:
    page = _parse(html, frozenset())
    if page.emptied:
        total = sum(len(text) for text, *_ in page.lines) + sum(size for _, _, size, outermost, _ in page.emptied if outermost)
        spared = frozenset(
            at
            for at, far, size, _, inside in page.emptied
            if (page.bare or inside and far == _DOUBT) and (2 * size > total if far == _DOUBT else total - size < surge and size >= surge)
        )
        if spared:
            return _parse(html, spared)
    return page


def _parse(html: str, spared: frozenset[int]) -> Page:
    """Lines with the scope and the element each lies in; ``spared`` elements (by where they begin) are not emptied for their class.

    Scope 0 is outside of every ``article`` and ``main``; each outermost such
    element counts on. An element that is dropped leaves an empty line. A tag cut off
    by the end of the page is no text.
    """
    out: list[tuple[str, int, int, bool]] = []
    elements = Elements()
    held: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements: name, what it adds to ``dropped``, scope outside, number
    scopes: list[str] = []
    emptied: list[tuple[int, int, int, bool, bool]] = []
    watched: list[list[int]] = []  # open elements emptied for their class: number, place, how far, text
    dropped, scope, breaks, at, links, unlinked, certain = 0, 0, 0, 0, 0, False, 0
    last_end: dict[str, int] = {}
    lowered = ""

    def flush() -> None:
        nonlocal held, unlinked
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held = []
            if text:
                out.append((text, scope, stack[-1][3] if stack else 0, not unlinked))
        unlinked = False

    def close(k: int) -> None:
        nonlocal dropped, scope, links, certain
        while len(stack) > k:
            name, was, outer, number = stack.pop()
            elements.close(number)
            dropped -= was
            links -= name == "a"
            scope = outer
            if watched and watched[-1][0] == number:
                _, begin, far, size = watched.pop()
                emptied.append((begin, far, size, not watched, bool(scope)))
                if watched:
                    watched[-1][3] += size
            elif was > 0:
                certain -= 1

    def text_of(begin: int, end: int) -> None:
        nonlocal breaks, unlinked
        if end <= begin:
            return
        if dropped > 0:
            if watched and not certain:
                watched[-1][3] += len(html[begin:end].strip())
            return
        text = html[begin:end]
        if "&" in text:
            if end == len(html):
                text = _whole_references(text)
            text = unescape(text)
        held.append(text)
        if text.strip():
            breaks = 0
            unlinked = unlinked or not links

    for m in _TOKEN.finditer(html):
        text_of(at, m.start())
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() == "iframe":
                flush()
            continue
        tag, closing, attrs = tag.lower(), bool(m[2]), m[4]
        if tag == "br":
            held.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if tag in _BLOCK:
            flush()
            breaks = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _SCOPE:
                        out.append(("", scope, 0, False))
                    close(k)
                    break
                if tag not in _BLOCK and stack[k][0] in _BLOCK:
                    break  # a stray end of an inline element ends no block
            continue
        if tag in _VOID or attrs.endswith("/"):
            continue
        if tag in _FALLBACK:
            if tag not in last_end:
                lowered = lowered or html.lower()
                last_end[tag] = lowered.rfind(f"</{tag}")
            if last_end[tag] < at:
                continue
        if tag in _BLOCK or tag == "body":
            # ends that may be left out: of the head before content, of a list of choices or a drawing before a block
            if tag != "title" and stack and stack[0][0] in ("head", "html"):
                k = 0 if stack[0][0] == "head" else 1
                if k < len(stack) and stack[k][0] == "head":
                    close(k)
            if tag != "option" and stack and tag not in ("hr", "title"):
                for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if stack[k][0] in ("select", "svg", "math"):
                        close(k)
                        break
        if tag in _BLOCK and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in _OPTIONAL_END and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        if tag == "p" or tag in _BLOCK:
            # inline elements left open inside a paragraph end with it
            k = len(stack)
            while k and stack[k - 1][0] not in _BLOCK:
                k -= 1
            if k and stack[k - 1][0] == "p":
                close(k - 1)
        far = _unwanted(tag, attrs)
        if far in (_DOUBT, _LIKELY) and m.start() in spared:
            far = _NOT
        number = elements.open(tag, stack[-1][3] if stack else 0)
        change = 0
        if far and not certain:
            if not dropped:
                flush()
                out.append(("", scope, 0, False))
            change = 1
            if far == _CERTAIN:
                certain += 1
            else:
                watched.append([number, m.start(), far, 0])
        elif tag in _HEADINGS and scope and dropped == 1 and stack and any(s[0] == "header" and s[1] for s in stack[-3:]):
            change = -1  # a heading in the article's own header
        stack.append((tag, change, scope, number))
        dropped += change
        links += tag == "a"
        if tag in _SCOPE and not dropped:
            out.append(("", scope, 0, False))
            if not scope:
                scopes.append(tag)
                scope = len(scopes)
    rest = html[at:]
    if rest and dropped <= 0:
        cut = rest.find("<")
        if cut >= 0 and re.match(r"</?[a-zA-Z!]|<\Z", rest[cut:]):
            rest = rest[:cut]
        held.append(unescape(_whole_references(rest)))
        unlinked = unlinked or not links
    flush()
    close(0)
    elements.close(0)
    return Page(out, elements, scopes, emptied, not scopes)


def _whole_references(text: str) -> str:
    """Without a character reference that the end of the page has cut off."""
    m = _PARTIAL.search(text)
    return text[: m.start()] if m and unescape(m[0]) == m[0] and m[0] != "&" else text


def stretches(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches of lines from a surge point up to a dive point.

    The sum over ``window`` lines from a line on must reach ``surge`` at a
    surge, and that line must have text; a stretch ends where a window holds
    no text at all or the lines end.
    """
    n = len(sizes)
    sums = [0] * (n + 1)
    total = sum(sizes[: window - 1])
    for i in range(n):
        total += sizes[i + window - 1] if i + window - 1 < n else 0
        sums[i] = total
        total -= sizes[i]
    out, i = [], 0
    while i < n:
        if sizes[i] and sums[i] >= surge:
            k = i
            while k < n and sums[k]:
                k += 1
            out.append((i, k))
            i = k
        i += 1
    return out


def _weights(page: Page, surge: int) -> tuple[list[int], list[int]]:
    """What each line weighs inside of scopes, and outside of them."""
    n = len(page.lines)
    idle = [False] * n  # in a list of links
    with_text = [k for k, (text, *_) in enumerate(page.lines) if text]
    for linked, run in groupby(with_text, key=lambda k: page.lines[k][3]):
        listed = list(run)
        if linked and len(listed) > 2:
            for k in listed:
                idle[k] = True
    inside, outside = [0] * n, [0] * n
    for k, (text, scope, _, _) in enumerate(page.lines):
        if not text:
            continue
        if not scope:
            outside[k] = 0 if idle[k] else len(text)
        elif not idle[k] or page.scopes[scope - 1] == "article":
            inside[k] = len(text) + surge
    return inside, outside


def extract(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page: blocks joined by an empty line; empty for a page without text."""
    page = parse(html, surge)
    inner, outer = _weights(page, surge)
    inside = [k for a, b in stretches(inner, window, surge) for k in range(a, b) if inner[k]]
    outside = _article(page, outer, window, surge)
    regions: dict[int, int] = {}
    for k in inside:
        scope = page.lines[k][1]
        regions[scope] = regions.get(scope, 0) + len(page.lines[k][0])
    size = sum(len(page.lines[k][0]) for k in outside if not page.lines[k][1])
    kept = set(inside) if sum(regions.values()) >= size else set()
    if size > max(regions.values(), default=0):
        kept |= set(outside)
    return "\n\n".join(page.lines[k][0] for k in sorted(kept))


def _article(page: Page, sizes: list[int], window: int, surge: int) -> list[int]:
    """Lines of the article that has its longest stretch outside of every scope."""
    runs = stretches(sizes, window, surge) or stretches(sizes, window, 1)
    if not runs:
        return []
    a, b = max(runs, key=lambda r: sum(sizes[r[0] : r[1]]))
    at = [page.lines[k][2] for k in range(a, b) if sizes[k]]
    top = page.elements.holder(at[0], min(at), max(at))
    if not top:
        return [k for a, b in runs for k in range(a, b) if sizes[k]]
    within = [k for k, (text, scope, n, _) in enumerate(page.lines) if text and (sizes[k] or scope) and top <= n <= page.elements.last[top]]
    own = set(within)
    begin = min(k for a, b in runs for k in range(a, b) if sizes[k] and k in own)
    return [k for k in within if k >= begin]


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of each page with ``text`` and ``n_chars`` (its code points).

    One row for each input row, repeated rows included. A null page counts as
    empty; its text is the empty string, as is that of a page without any
    text. Pages are read whole whatever their length. An empty table gives an
    empty result; other columns are left out.
    """
    kinds = {k: docs_type for k, docs_type in ((f.name, f.dataType.simpleString()) for f in pages.schema) if k in keep}
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join([f"{n} {kinds[k]}" for n, k in zip(names, keep)] + ["text string", "n_chars long"])
    source = pages.select(*[F.col(k).alias(n) for n, k in zip(names, keep)], text_or_empty(html_col).alias("html"))
    return source.mapInArrow(run, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "text", "n_chars")
