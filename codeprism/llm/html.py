"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each run of text between block tags. Each line has a
weight: its text length, nothing for menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, more inside an article or main element, and less outside of one
where a page has one. Sums of weights over a sliding window of lines surge where main text
begins and dive to zero where it ends; the text between surge and dive is kept, but for lines
of menus and the like. Tags and classes only weigh lines: on every page the window sums decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

WINDOW = 3
#: Characters in a window at which text surges. A page without such a window surges at its highest one.
SURGE = 80
#: Part of its length that a line outside an article or main element weighs where a page has one.
OUTSIDE = 8
#: Items of lists outside an article of up to so many characters are a menu's: they weigh nothing.
ITEM = 20

#: HTML elements by what they mean here.
RAW = "script|style|textarea|title|iframe|noframes|xmp"
MUTE = frozenset("button canvas math noscript object select svg template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul video audio".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that the start of another one of the same row ends.
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
CHROME = frozenset("aside footer form dialog".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus "
    "footer header menu modal nav navbar navigation newsletter notice notices popup promo related respond share sharing sidebar "
    "skip social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
CHROME_ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search alert".split())

#: Kinds of chrome. SOFT: an article inside is the main text; FIRM: it is plain text; HARD: it is not text.
SOFT, FIRM, HARD = 1, 2, 3
#: Where a line stands: in an article or main element, or in one inside FIRM chrome.
MAIN, PLAIN = 1, 2

ATTRS = r"(?:[^>=]+|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=)*+"
MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW})(?=[\s/>]){ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRS})>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[a-z]+")


class Line(NamedTuple):
    text: str
    chrome: int
    main: int
    item: bool
    heading: bool
    linked: int  # characters inside links


BLANK = Line("", 0, 0, False, False, 0)


def chrome_of(tag: str, attrs: str, main: int) -> int:
    """What kind of chrome an element is, by its tag, role, class and id; 0: none.

    A heading is one by a whole class only, as `header-big` says how it looks; neither that nor
    an element inside an article is a header.
    """
    if tag in ("nav", "menu") or tag == "header" and not main:
        return SOFT
    if tag in CHROME:
        return FIRM
    if not attrs or tag in ("body", "head", "html", "article", "main"):
        return 0
    kind = 0
    for key, a, b, c in NAMES.findall(attrs):
        value = (a or b or c).lower()
        words = set(value.split() if tag in HEADINGS else WORDS.findall(value)) & CHROME_WORDS
        if main or tag in HEADINGS:
            words.discard("header")
        if words & COMMENT_WORDS:
            return HARD
        if words or key.lower() == "role" and value in CHROME_ROLES:
            kind = FIRM
    return kind or (HARD if HIDDEN.search(attrs) else 0)


def lines_of(page: str) -> list[Line]:
    """The lines of a page; WINDOW blank ones stand at the edges of an article or main element.

    A head has no text of its own: its title, styles and scripts are dropped as such, and what
    else stands there belongs to the body, whether or not the head is closed.
    """
    lines: list[Line] = []
    run: list[str] = []
    stack: list[tuple] = []  # tag, and what holds inside of it: chrome, main, item, mute
    open_: Counter = Counter()
    chrome = main = linked = 0
    item = heading = mute = link = False

    def text(piece: str) -> None:
        nonlocal linked
        if not mute:
            run.append(html.unescape(piece) if "&" in piece else piece)
            if link:
                linked += len(piece)

    def end() -> None:
        nonlocal linked, heading
        if run:
            if line := " ".join("".join(run).split()):
                lines.append(Line(line, chrome, main, item, heading, linked))
            run.clear()
        linked, heading = 0, False

    def close(k: int) -> None:
        """Closes the elements from the k-th on."""
        nonlocal chrome, main, item, mute
        end() if any(e[0] in BLOCKS or e[1] for e in stack[k:]) else None
        for e in stack[k:]:
            open_[e[0]] -= 1
            if e[0] in ("article", "main"):
                lines.extend([BLANK] * WINDOW)
        del stack[k:]
        chrome, main, item, mute = stack[-1][1:] if stack else (0, 0, False, False)

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "a":
            link = not m["close"]
        elif tag == "br":
            run.append(" ")
        if tag in BLOCKS:
            end()
            link = False
        if m["close"]:
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if stack and tag in BLOCKS and (stack[-1][0] == "p" or tag in ENDED_BY.get(stack[-1][0], ())):
            close(len(stack) - 1)
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        before = chrome, mute
        if tag in MUTE:
            mute = True
        elif tag in ("article", "main"):
            lines.extend([BLANK] * WINDOW)
            mute = False
            if chrome < FIRM:
                chrome, main = 0, MAIN
            elif chrome == FIRM and not main:
                chrome, main = 0, PLAIN
        elif not chrome and (kind := chrome_of(tag, m["attrs"], main)):
            end()
            chrome = kind
        if tag in BLOCKS or (chrome, mute) != before:
            heading = tag in HEADINGS
            item = item or tag == "li"
            stack.append((tag, chrome, main, item, mute))
            open_[tag] += 1
    if at < len(page):
        text(page[at:])
    end()
    return lines


def weights(lines: list[Line]) -> list[int]:
    """What each line weighs, in parts of a character (OUTSIDE of them)."""
    has_main = any(x.main == MAIN and not x.chrome and x.text for x in lines)

    def weight(x: Line) -> int:
        if x.chrome or not x.text:
            return 0
        if x.main == MAIN:
            return (len(x.text) + SURGE) * OUTSIDE
        if not x.main and x.item and len(x.text) <= ITEM:
            return 0
        return max(len(x.text) - x.linked, 0) * (1 if has_main else OUTSIDE)

    return [weight(x) for x in lines]


def stretches(weight: list[int], headings: list[bool]) -> list[tuple[int, int]]:
    """Stretches of lines from a surge of the window sums to the dive where a sum is zero.

    A stretch begins with the first line of the surging window that weighs anything; a heading
    that stands before it, with no dive between, begins it instead.
    """
    n = len(weight)
    sums = [sum(weight[i : i + WINDOW]) for i in range(n)]
    surge = max(1, min(SURGE * OUTSIDE, max(sums, default=0)))
    out, start, opened = [], None, None
    for i, s in enumerate(sums):
        if s == 0:
            if start is not None:
                out.append((start, i))
            start = opened = None
        elif start is None:
            if headings[i] and weight[i] and opened is None:
                opened = i
            if s >= surge and weight[i]:
                start = i if opened is None else opened
    if start is not None:
        out.append((start, n))
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by an empty line; empty for null, empty or markup-only pages."""
    if not page:
        return ""
    lines = lines_of(page)
    found = stretches(weights(lines), [x.heading for x in lines])
    return "\n\n".join(x.text for a, b in found for x in lines[a:b] if x.text and not x.chrome)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty page has an empty text. Repeated rows give repeated rows, an empty table
    an empty result; ids and urls may be null; other columns are ignored. Pages are worked on
    one by one and whole, whatever their length.
    """
    rows = pick(pages, page_id=page_id, url=url, html=page)
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
