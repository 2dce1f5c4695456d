"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block with text. Lines of boilerplate elements
(by element name, or by the words of class, id and role) count as blank. Then the
lengths of text outside links are summed over sliding windows of lines. A line is light if no
window that holds it reaches ``SURGE`` characters, or ``SHARE`` of the page's highest window if
that is less: menus, footers and link lists are light whatever their markup. The
distribution surges where heavy lines follow light or blank ones and dives where
``WINDOW`` or more light lines follow; the text between a surge and its dive is a run. Short
lines at a run's ends that are no headings, paragraphs or sentences, and lie in other
containers than its long lines, belong to the slopes and go.
Runs with only a light stretch of few links between them are one: a list within the article. Runs
whose highest window reaches ``SURGE`` characters, or a quarter of the page's highest window
if that is less, are the main text. ``<article>`` and ``<main>`` are evidence: lines inside
are heavy, they make runs of their own, and a run outside must also reach ``MARKED`` times the
highest window inside.

Words of class and id (and forms) mark an element only if it does not hold the
page's main run: the element whose own text has the highest window, where that is
more than four times the highest window outside all such elements, is text, and
so are the elements around it and those with its very tag.

Defined results: NULL or empty html, and html without text, give the empty
text; truncated html ends its open elements; repeated rows give the same text;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import column_chunks, ship_package

#: Lines of a sliding window.
WINDOW = 3
#: Characters in a window from which on it can start a run.
SURGE = 80
#: Share of the page's highest window that a line's window must reach on pages of little text.
SHARE = 0.6
#: Characters below which a line at a run's end must be a heading, a paragraph or a sentence, or lie with longer lines.
SHORT = 40
#: A run outside ``<article>`` and ``<main>`` needs so many times the highest window inside.
MARKED = 4

# Elements and words that mark what is not the article.
_RAW = "script|style|title|noscript|textarea|template|svg|math|iframe|object|select|xmp"
_BOILERPLATE = frozenset("nav footer aside button menu dialog input label fieldset search".split())
_BOILERPLATE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar side aside rail
    footer foot copyright legal disclaimer cookie cookies consent gdpr notice notices alert popup modal overlay
    comment comments commentlist discussion replies respond disqus share sharing social related recommended
    teaser teasers newsletter subscribe subscription signup login search form widget widgets toolbar skip""".split()
)
_HEADER_WORDS = frozenset(("header", "masthead", "topbar"))
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span
    strike strong sub sup time tt u var wbr""".split()
)
_ARTICLE = frozenset(("article", "main"))
_OWN_LINES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p"))
_CONTAINERS = frozenset(("ul", "ol", "table", "div", "section", "td", "article", "main", "form", "center", "blockquote", "fieldset"))
#: How a sentence ends.
_SENTENCE = tuple(".!?:;…。！？\"'”’»)")

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+(?<=/)>"""
    rf"|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _boilerplate(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is unless it holds the main run; a header inside the article holds its title."""
    if name in _BOILERPLATE or name == "header" and not inside:
        return True, False
    soft = name == "form"
    for m in _MARKS.finditer(rest) if rest and name not in ("body", "html") else ():
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return True, False
        if kind == "style" and "display:none" in value.replace(" ", "").lower():
            return True, False
        words = {w.lower() for w in _WORD.findall(value)}
        if kind == "role" and words & _ROLES:
            return True, False
        if kind in ("class", "id") and (words & _BOILERPLATE_WORDS or not inside and words & _HEADER_WORDS):
            soft = True
    # An inline element is no block, so no run of its own.
    return soft and name in _INLINE, soft and name not in _INLINE


def text_lines(html: str) -> tuple[list[str], list[bool], list[int], list[bool], list[tuple[int, ...]]]:
    """The page's lines of text (blank for boilerplate); which lie in a marked article; their characters in links;
    which are headings or paragraphs; their containers."""
    lines, marked, owners, elements, links, blocks, containers = _lines(html)
    lengths, owner = np.fromiter(map(len, lines), np.int64, len(lines)), np.array(owners, np.int64)
    text = {-1}
    if elements and len(lines):
        # Highest window of each element's own lines; the last place is of those outside (-1).
        sums = lengths.copy()
        for lag in range(1, WINDOW):
            sums[:-lag] += lengths[lag:] * (owner[lag:] == owner[:-lag])
        tops = np.zeros(len(elements) + 1, np.int64)
        np.maximum.at(tops, owner, sums)
        most = int(tops[:-1].argmax())
        if tops[most] > 4 * tops[-1]:
            tag = elements[most][1:]
            for e in (most, *(e for e in range(len(elements)) if elements[e][1:] == tag)):
                while e not in text:
                    text.add(e)
                    e = elements[e][0]
    return [line if e in text else "" for line, e in zip(lines, owners, strict=True)], marked, links, blocks, containers


def _lines(html: str) -> tuple[list[str], list[bool], list[int], list[tuple[int, str, str]], list[int], list[bool], list[tuple[int, ...]]]:
    """Lines, marks, and for each line the innermost element that words mark (-1: none); those elements: the one around, name,
    attributes; then each line's characters in links, whether it is a heading or paragraph, its containers from the innermost out (none: the page)."""
    lines, marked, owners, links, blocks, containers = [], [], [], [], [], []
    elements: list[tuple[int, str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int, tuple[int, ...]]] = []  # open elements: name, boilerplate, article, owner and container outside
    skipped = inside = at = 0
    owner = -1
    linked = anchors = made = 0  # characters of the line in links; open links; containers so far
    container: tuple[int, ...] = ()
    dropped = False  # whether boilerplate text was met since the last line

    def close_line() -> None:
        nonlocal dropped, linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text or dropped:
            lines.append(text)
            marked.append(inside > 0)
            owners.append(owner)
            links.append(min(linked, len(text)))
            blocks.append(next((e[0] in _OWN_LINES for e in reversed(stack) if e[0] not in _INLINE), False))
            containers.append(container)
        parts.clear()
        dropped = False
        linked = 0

    def read(piece: str) -> None:
        nonlocal dropped, linked
        if not skipped:
            parts.append(piece)
            if anchors:
                linked += len(" ".join(piece.split()))
        elif not piece.isspace():
            dropped = True

    def pop() -> None:
        nonlocal skipped, inside, owner, anchors, container
        name, boilerplate, article, outside, around = stack.pop()
        if owner != outside:
            close_line()
            owner = outside
        skipped -= boilerplate
        inside -= article
        anchors -= name == "a"
        container = around

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            read(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            close_line()
        if m["end"]:
            if any(name == e[0] for e in reversed(stack)):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in _VOID and not m["rest"].endswith("/"):
            if stack and name not in _INLINE:
                # A new block ends open inline elements and a paragraph; an item ends the item before it.
                while stack and (stack[-1][0] in _INLINE or stack[-1][0] == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name):
                    pop()
            boilerplate, soft = _boilerplate(name, m["rest"], inside > 0)
            article = name in _ARTICLE and not boilerplate and not skipped
            stack.append((name, boilerplate, article, owner, container))
            if soft and not skipped:
                elements.append((owner, name, m["rest"]))
                owner = len(elements) - 1
            skipped += boilerplate
            inside += article
            anchors += name == "a"
            if name in _CONTAINERS:
                made += 1
                container = (made, *container)
    if at < len(html):
        read(html[at:])
    close_line()
    return lines, marked, owners, elements, links, blocks, containers


def runs(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Runs of text as first line, line after the last, highest window: from a surge of the window sums to the next dive."""
    filled = np.flatnonzero(lengths)
    if not len(filled):
        return []
    sums = np.convolve(lengths, np.ones(window, np.int64))[window - 1 :]  # sums[i] is of the lines from i on
    # A dive: ``window`` blank lines, so a window sum of 0, after a line with text.
    breaks = np.flatnonzero(np.diff(filled) > window)
    firsts, lasts = filled[np.append(0, breaks + 1)], filled[np.append(breaks, len(filled) - 1)]
    return [(int(a), int(b) + 1, int(sums[a : b + 1].max())) for a, b in zip(firsts, lasts, strict=True)]


def heavy_lines(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines some window that holds them gives ``surge`` characters, or ``SHARE`` of the highest window."""
    if not len(lengths):
        return np.zeros(0, bool)
    sums = np.convolve(lengths, np.ones(window, np.int64))  # sums[i] is of the lines up to i
    best = np.lib.stride_tricks.sliding_window_view(sums, window).max(axis=1)
    return (best >= min(surge, SHARE * int(best.max()))) & (best > 0)


def _ends(a: int, b: int, lines: list[str], blocks: list[bool], containers: list[tuple[int, ...]], links: np.ndarray) -> tuple[int, int]:
    """A run without the short lines at its ends, unless they are headings, paragraphs or sentences, or lie with its longer lines;
    up to ``WINDOW`` light lines after it that do lie with them are its end."""
    short = min(SHORT, max(map(len, lines[a:b])) / 2)
    held = {containers[i][:1] for i in range(a, b) if len(lines[i]) >= short}

    def slope(i: int) -> bool:
        if blocks[i] or len(lines[i]) >= short or lines[i].endswith(_SENTENCE):
            return False
        return containers[i][:1] not in held and not any((c,) in held for c in containers[i])

    while slope(a):
        a += 1
    while slope(b - 1):
        b -= 1
    near = [i for i in range(b, min(b + WINDOW + 1, len(lines))) if lines[i] and 2 * links[i] < len(lines[i]) and any((c,) in held for c in containers[i])]
    return a, max([b, *(i + 1 for i in near)])


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks in page order, joined by a space."""
    lines, marked, links, blocks, containers = text_lines(html)
    lengths, linked = (np.fromiter(x, np.int64, len(lines)) for x in (map(len, lines), links))
    inside = np.array(marked, bool)
    plain = np.maximum(lengths - linked, 0) * ~inside
    heavy = heavy_lines(plain, window, surge) & (lengths > 0) & ~inside
    kept = np.zeros(len(lines), bool)
    found = runs(lengths * inside, window), runs(plain * heavy, window)
    in_article, top = (max((t for *_, t in part), default=0) for part in (found[0], found[0] + found[1]))
    least = min(surge, top / 4)
    for a, b, t in found[0]:
        if t >= least:
            kept[a:b] |= (lengths[a:b] > 0) & inside[a:b]
    strong: list[tuple[int, int]] = []
    for a, b, t in found[1]:
        if t < max(least, MARKED * in_article):
            continue
        a, b = _ends(a, b, lines, blocks, containers, linked)
        if strong and 2 * linked[strong[-1][1] : a].sum() < max(1, lengths[strong[-1][1] : a].sum()):
            a = strong.pop()[0]  # a light stretch of few links between them
        strong.append((a, b))
    for a, b in strong:
        kept[a:b] |= (lengths[a:b] > 0) & ~inside[a:b]
    return " ".join(lines[i] for i in np.flatnonzero(kept).tolist())


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    ship_package(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, html in column_chunks(batches, text=2):
            texts = [main_text(h) for h in html.to_pylist()]
            columns = [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
