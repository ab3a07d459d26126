"""The visible text of HTML pages, laid out as a browser without styles would.

A tokenizer and a tree builder turn a page into properly nested elements: tags that HTML implies are closed
or opened (paragraphs before blocks, list items, table rows and cells), stray end tags are dropped. The
renderer then writes all text a reader would see: one line per block, a blank line around paragraphs,
headings, lists and tables, list items with bullets or numbers and indents, table cells in aligned columns,
preformatted text as it is. A head ends at ``</head>`` or at the first text or element that can't be in one.
Formulas give the text of their signs, drawings that of their labels (``text`` and ``foreignObject``). Hidden:
head, scripts, styles, templates, comments, form values, ``hidden``, ``display:none``, ``visibility:hidden``,
closed ``details`` (but its summary), closed ``dialog``, notes on formulas, titles and definitions of drawings.

One pass over the page. All open elements are held, however deep; each knows where the nearest of a tag is, so
neither deep nesting nor unclosed tags cost more than their length. Only the look has bounds, no text is left
out for them (output would grow as the square of the page): indents grow to ``INDENT`` characters, tables inside
``NESTED`` others are written as rows of words, and cells that spans push more than ``EDGE`` characters to the right
of what their row's own cells could fill follow the cell before them. Cells are placed by colspan and rowspan. A cell over
``WIDEST`` characters doesn't widen its column: what follows it in the row starts on the next line, in its own
column. Pages are read where they lie.

Cases: null html gives null; html without visible text gives the empty text. Malformed markup is read as far
as it makes sense, a ``<`` that starts no tag is text. Quotes delimit only where an attribute's value begins; a tag in
which the page would end by that rule ends at its first ``>``, so that a quote never closed hides no text. Other columns are passed on; the result is one more
struct column, last, named ``layout`` (underscores are added while that name is taken).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from outings.llm.common import append, free_name

MARK = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
# HTML's rules of attributes: a quote delimits a value only where the value begins, anywhere else it is a character like others
NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
EQUALS = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+"
BARE = r"[^ \t\n\r\f>\"'][^ \t\n\r\f>]*+"
TAG = re.compile(rf"</?([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|{NAME}(?:{EQUALS}(?:\"[^\">]*+\"|'[^'>]*+'|{BARE}|(?=>))|(?!{EQUALS})))*+)>")
TAG_NAME = re.compile(r"</?([a-zA-Z][^ \t\n\r\f/>]*+)")
GAP = re.compile(r"[ \t\n\r\f/]*+")
ATTRIBUTE = re.compile(rf"({NAME})(?:{EQUALS}(\"[^\"]*+\"|'[^']*+'|{BARE}|))?+")
TO_THE_END = re.compile(rf"{NAME}(?:{EQUALS}(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|{BARE}|))?+")
SPACES = re.compile(r"[ \t\n\r\f]+")
SPAN = re.compile(r"[ \t\n\r\f]*\+?([0-9]+)")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes textarea title xmp".split())
NEVER = frozenset("head script style template iframe noembed noframes object audio video canvas datalist select textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
#: an opening tag closes these open elements, unless one of the second kind is opened inside them
CLOSES = {
    "li": ("li", "ul ol menu table"), "dt": ("dt dd", "dl table"), "dd": ("dt dd", "dl table"), "tr": ("tr td th caption", "table"),
    "td": ("td th", "table"), "th": ("td th", "table"), "thead": ("thead tbody tfoot tr td th caption", "table"),
    "tbody": ("thead tbody tfoot tr td th caption", "table"), "tfoot": ("thead tbody tfoot tr td th caption", "table"),
    "body": ("head", ""), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())  # don't end a head
NOSCRIPT = frozenset("html basefont bgsound link meta noframes style".split())  # don't end a noscript in a head
#: html tags that end a formula or drawing they are found in, as if it had been closed
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
                   "pre ruby s small span strong strike sub sup table tt u ul var".split())
POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())  # html again inside formulas and drawings
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc filter lineargradient radialgradient annotation annotation-xml mphantom".split())
APART = frozenset("text foreignobject mtd".split())  # parted from what is beside them
SCOPE = POINTS - {"title"} | frozenset("table td th caption button".split())  # a paragraph isn't closed across these
WIDEST = 40
EDGE = 1000
INDENT = 512
NESTED = 100


Cell = tuple[int, int, list[str]]  # colspan, rowspan, lines


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def tag_stop(page: str, at: int, endless: set[int]) -> int:
    """Where the ``>`` lies that ends a tag with attributes from ``at`` on; -1: in no place, the page ends within the tag.

    ``endless`` holds the attributes from which the page's end is reached, so no stretch is read again for each tag in it.
    """
    passed = []
    while (at := GAP.match(page, at).end()) < len(page) and at not in endless:
        if page[at] == ">":
            return at
        passed.append(at)
        at = TO_THE_END.match(page, at).end()
    endless.update(passed)
    return -1


def unseen(tag: str, attrs: dict[str, str]) -> bool:
    return (tag in NEVER or "hidden" in attrs or bool(UNSEEN.search(attrs.get("style", "")))
            or tag == "dialog" and "open" not in attrs)


def nested(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """Properly nested events: ("open", tag, attributes), ("text", text, None), ("close", tag, None)."""
    stack: list[str] = []
    foreign: list[bool] = []  # of each open element: whether it holds a formula's or drawing's elements
    held: dict[str, list[int]] = {}  # where the open elements of a tag are in the stack

    def push(tag: str, attrs: dict[str, str]) -> tuple:
        inside = bool(foreign) and foreign[-1]
        stack.append(tag)
        foreign.append(tag in ("svg", "math") or inside and tag not in POINTS)
        held.setdefault(tag, []).append(len(stack) - 1)
        return "open", tag, attrs

    def pop() -> tuple:
        tag = stack.pop()
        foreign.pop()
        held[tag].pop()
        return "close", tag, None

    def nearest(kinds: frozenset) -> int:
        return max((places[-1] for k in kinds if (places := held.get(k))), default=-1)

    def until(kinds: frozenset, fence: frozenset) -> Iterator[tuple]:
        """Close everything up to the outermost of ``kinds`` inside the nearest fence; of one kind, the nearest."""
        floor = nearest(fence)
        found = [places[-1 if len(kinds) == 1 else bisect_right(places, floor)]
                 for k in kinds if (places := held.get(k)) and places[-1] > floor]
        while found and len(stack) > min(found):
            yield pop()

    def leave(tag: str | None) -> Iterator[tuple]:
        """Close a head that can't hold this tag (None: text) and the formula or drawing that it ends."""
        while stack and (stack[-1] == "head" and tag not in HEAD
                         or stack[-1] == "noscript" and stack[-2:-1] == ["head"] and tag not in NOSCRIPT):
            yield pop()
        while tag in BREAKS and stack and foreign[-1]:
            yield pop()

    begun = False  # whether the body is: there is no head any more
    endless: set[int] = set()
    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        mark = MARK.search(page, at)
        start = mark.start() if mark else size
        found, after, tag, ending, inner = None, 0, None, None, ""
        if mark and page[start + 1] in "!?":
            found = ASIDE.match(page, start)
            after = found.end()
        elif mark and start < last:
            found = TAG.match(page, start)
            if found:
                after, inner = found.end(), found[2]
            else:
                found = TAG_NAME.match(page, start)
                stop = tag_stop(page, found.end(), endless)
                after = (stop if stop >= 0 else page.index(">", found.end())) + 1
                inner = page[found.end():after - 1]
            tag, ending = (None, found[1]) if page[start + 1] == "/" else (found[1], None)
        stop = start if found else min(size, start + 1) if start < last else size
        if stop > at:
            text = html.unescape(page[at:stop])
            if text.strip(" \t\n\r\f"):
                yield from leave(None)
                begun = True
            yield "text", text, None
        at = after if found else stop
        if ending:
            tag = ending.lower()
            if tag in ("p", "br") and stack and foreign[-1]:
                yield from leave(tag)
            if tag == "p" and not held.get("p"):
                yield "open", "p", {}
                yield "close", "p", None
            elif tag == "br":
                yield "open", "br", {}
            elif held.get(tag):
                place = held[tag][-1]
                if tag in ("table", "body", "html") or place > nearest(frozenset({"table"})):
                    while len(stack) > place:
                        yield pop()
        elif tag:
            tag = tag.lower()
            attrs = attributes(inner) if inner.strip(" \t\n\r\f/") else {}
            yield from leave(tag)
            if tag == "head" and begun:
                continue
            begun = begun or tag not in HEAD
            if tag in BLOCK and held.get("p"):
                yield from until(frozenset({"p"}), SCOPE)
            if tag in CLOSES:
                yield from until(*CLOSES[tag])
            if tag in ("td", "th") and held.get("table") and not (stack and stack[-1] == "tr"):
                yield push("tr", {})
            if tag in VOID:
                yield "open", tag, attrs
                continue
            inside = bool(foreign) and foreign[-1]
            yield push(tag, attrs)
            if inner.endswith("/") and (inside or tag in ("svg", "math")):
                yield pop()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else size
    while stack:
        yield pop()


class Flow:
    """Lines of a block context: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False
        self.mark = ""  # a list item's bullet, before its first line

    def text(self, text: str) -> None:
        self.parts.append(text)

    def add(self, lines: list[str], indent: str) -> None:
        """Lines that are laid out already, with a blank one around them."""
        self.blank = True
        for line in lines[:1]:
            self.text(line)
            self.end(indent, keep=True)
        self.lines.extend([indent + line for line in lines[1:]] if indent else lines[1:])
        self.blank = True

    def end(self, indent: str, spaced: bool = False, keep: bool = False) -> None:
        """The line so far, if it holds anything; ``spaced``: a blank line before what follows."""
        line = "".join(self.parts)
        self.parts.clear()
        if not keep:
            line = SPACES.sub(" ", line).strip(" ")
        for one in line.split("\n") if keep else [line] if line else []:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            if self.mark:
                indent_ = indent[:-len(self.mark)] + self.mark
                self.mark = ""
            else:
                indent_ = indent
            self.lines.append((indent_ + one).rstrip())
        self.blank = self.blank or spaced


def span(text: str | None, most: int) -> int:
    """A colspan or rowspan as HTML reads it."""
    found = SPAN.match(text or "")
    return min(int(found[1][:6]), most) if found else 1


def placed(groups: list[list[list[Cell]]]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """The first column, the end and the lines of each row's cells; a rowspan ends with its row group."""
    for rows in groups:
        taken: list[tuple[int, int, int]] = []  # by first column: first, end, and the row of the group from which they are free
        for number, row in enumerate(rows):
            at, passed, still, out = 0, 0, [], []
            for wide, high, lines in row:
                while passed < len(taken) and taken[passed][0] <= at:
                    if taken[passed][2] > number:
                        at = max(at, taken[passed][1])
                        still.append(taken[passed])
                    passed += 1
                out.append((at, at + wide, lines))
                if high != 1:
                    free = min(number + high, len(rows)) if high else len(rows)
                    if still and still[-1][1:] == (at, free):
                        still[-1] = still[-1][0], at + wide, free
                    else:
                        still.append((at, at + wide, free))
                at += wide
            taken[:passed] = still
            yield out


def columns(groups: list[list[list[Cell]]]) -> list[str]:
    """Row groups of rows of cells as lines, cells of a column under each other."""
    rows = list(placed(groups))
    if all(len(row) < 2 and (not row or not row[0][0]) for row in rows):
        return [line for row in rows for cell in row for line in cell[2] if line]
    starts = sorted({first for row in rows for first, _, _ in row})  # columns in which no cell starts have no width
    ends: list[dict[int, int]] = [{} for _ in starts]  # of cells that end before the next column: width by first column
    rows = [[(bisect_left(starts, first), bisect_left(starts, end), lines) for first, end, lines in row] for row in rows]
    for row in rows:
        for first, end, lines in row:
            widest = max(n for line in ["", *lines] if (n := len(line)) <= WIDEST)
            ends[end - 1][first] = max(widest, ends[end - 1].get(first, 0))
    begin = [0]
    for own in ends:
        begin.append(max([begin[-1] + 2, *(begin[first] + n + 2 for first, n in own.items())]))
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line, size = [], 0
            for i, (first, _, lines) in enumerate(row):
                if k >= len(lines) or not lines[k]:
                    continue
                place = begin[first] if begin[first] <= (i + 1) * (WIDEST + 2) + EDGE else size + 2
                if line and size + 2 > place:
                    out.append("".join(line).rstrip())
                    line, size = [], 0
                line += " " * (place - size), lines[k]
                size = place + len(lines[k])
            out.append("".join(line).rstrip())
    return [line for line in out if line]


def render(page: str) -> str:
    """The visible text of a page."""
    flow = Flow()
    flows: list[tuple[Flow, str, int, int, int]] = []  # around the open cells, and the cells' depths and spans
    tables: list[list[list[list[Cell]]]] = []  # of each open table: row groups of rows of cells
    deep = 0  # tables that are open in ``NESTED`` others
    lists: list[list] = []  # of each open list: kind, next number
    indents: list[str] = []
    indent, dark, pre = "", 0, 0
    darkened: list[int] = []  # depth marks of hidden elements
    depth, details = 0, []  # of each open closed-details element: its depth
    drawings: list[list[int]] = []  # of each open formula or drawing: its depth, how many labels are open in it (one more in a formula)
    for kind, tag, attrs in nested(page):
        if kind == "text":
            if not dark and not (details and not details[-1][1]) and not (drawings and not drawings[-1][1]):
                if pre:
                    *done, last = tag.split("\n")
                    for one in done:
                        flow.text(one)
                        flow.end(indent, keep=True)
                    flow.text(last)
                else:
                    flow.text(tag)
            continue
        if kind == "open":
            if tag in VOID:
                if dark:
                    continue
                if tag == "br":
                    flow.end(indent, keep=bool(pre))
                elif tag == "hr":
                    flow.end(indent, spaced=True)
                elif tag == "img" and attrs.get("alt", "").strip() and not unseen(tag, attrs):
                    flow.text(attrs["alt"])
                continue
            depth += 1
            if dark or unseen(tag, attrs) or drawings and tag in UNDRAWN:
                if not dark:
                    darkened.append(depth)
                dark += 1
                continue
            if tag == "details" and "open" not in attrs:
                flow.end(indent)
                details.append([depth, False])
            elif tag == "summary" and details and depth == details[-1][0] + 1:
                details[-1][1] = True
            if tag in ("svg", "math"):
                drawings.append([depth, int(tag == "math")])
            elif drawings and tag in APART:
                flow.text(" ")
                drawings[-1][1] += tag != "mtd"
            if tag in BLOCK:
                flow.end(indent, spaced=tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, int(attrs["start"]) if attrs.get("start", "").isascii() and attrs.get("start", "").isdigit() else 1])
            elif tag == "li":
                own = lists[-1] if lists else ["ul", 1]
                flow.mark = f"{own[1]}. " if own[0] == "ol" else "- "
                own[1] += 1
                indents.append(indent)
                indent += " " * len(flow.mark) if len(indent) < INDENT else ""
            elif tag in ("blockquote", "dd"):
                indents.append(indent)
                indent += "  " if len(indent) < INDENT else ""
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                if len(tables) == NESTED:
                    deep += 1
                else:
                    tables.append([[]])
            elif deep:
                if tag == "tr":
                    flow.end(indent)
                elif tag in ("td", "th"):
                    flow.text(" ")
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].append([])
            elif tag == "tr" and tables:
                tables[-1][-1].append([])
            elif tag in ("td", "th") and tables and tables[-1][-1]:
                flows.append((flow, indent, depth, max(1, span(attrs.get("colspan"), 1000)), span(attrs.get("rowspan"), 65534)))
                flow, indent = Flow(), ""
            continue
        # close
        if dark:
            dark -= 1
            depth -= 1
            continue
        if tag == "tr" and deep:
            flow.end(indent)
        elif flows and depth == flows[-1][2]:
            flow.end(indent)
            own = flow.lines or [""]
            flow, indent, _, wide, high = flows.pop()
            tables[-1][-1][-1].append((wide, high, own))
        elif tag in ("thead", "tbody", "tfoot") and tables and not deep:
            tables[-1].append([])
        elif tag == "table" and deep:
            flow.end(indent, spaced=True)
            deep -= 1
        elif tag == "table" and tables:
            flow.end(indent)
            flow.add(columns(tables.pop()), indent)
        elif tag in BLOCK:
            flow.end(indent, keep=bool(pre) and bool(flow.parts) and any(p for p in flow.parts))
            flow.end(indent, spaced=tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        elif tag == "li":
            flow.mark = ""
            indent = indents.pop() if indents else ""
        elif tag in ("blockquote", "dd"):
            indent = indents.pop() if indents else ""
        elif tag == "pre":
            pre -= 1
        if drawings and tag in APART:
            flow.text(" ")
            drawings[-1][1] -= tag != "mtd"
        elif drawings and depth == drawings[-1][0]:
            drawings.pop()
        if details and tag == "summary" and depth == details[-1][0] + 1:
            details[-1][1] = False
        elif details and depth == details[-1][0]:
            details.pop()
        depth -= 1
    while flows:  # not reached where all elements are closed
        flow, indent = flows.pop()[:2]
    flow.end("")
    return "\n".join(flow.lines)


def extract_layout(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with the laid-out text of each, its lines and characters."""
    at = pages.columns.index(column)

    def rows(batch: pa.RecordBatch) -> list[dict]:
        out = []
        for page in batch.column(at).to_pylist():
            text = None if page is None else render(page)
            out.append({"text": text, "n_lines": None if text is None else len(text.split("\n")) if text else 0,
                        "n_chars": None if text is None else len(text)})
        return out

    return append(pages, free_name(pages, "layout"), "text string, n_lines int, n_chars int", rows)
