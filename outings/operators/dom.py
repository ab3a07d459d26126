"""One HTML pass per page; everything after it is native Spark.

The pass keeps the page's visible text, and its pieces in order; elements are described by
offsets into the text and by their first and last piece, so nested elements do not repeat their
text and reading one costs its own length only. Rules (which element
means what) live in ``extract.py`` as column expressions over this table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors get this small module with the task, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ATTRS = ("class", "id", "itemprop", "href", "name", "property", "content", "type")
_NODE = (
    "tag string, class string, id string, itemprop string, href string, name string, "
    "property string, content string, type string, parent int, start int, stop int, first int, last int, "
    "crumb boolean, raw string"
)
DOM = (
    "page_id bigint, url string, parsed boolean, text string, "
    f"nodes array<struct<{_NODE}>>, texts array<struct<node int, start int, stop int, word string>>"
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))


#: Tags that end an open paragraph.
_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul".split())


class _Page(HTMLParser):
    """Collects elements and visible text of one page. End tags close the nearest open
    element of that name; a stray end tag is ignored. A block ends an open paragraph."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.words: list[str] = []
        self.texts: list[tuple[int, int, int]] = []
        self._open: list[int] = []
        self._count: dict[str, int] = {}
        self._pending: list[str] = []
        self._length = 0

    def _flush(self) -> None:
        raw, self._pending = "".join(self._pending), []
        if not raw:
            return
        if any(self._count.get(tag) for tag in _HIDDEN):
            top = self.nodes[self._open[-1]]
            if top["tag"] == "script":
                top["raw"] = (top["raw"] or "") + raw
            return
        text = " ".join(raw.split())
        if text:
            start = self._length + (1 if self.words else 0)
            self._length = start + len(text)
            self.words.append(text)
            self.texts.append((self._open[-1] if self._open else -1, start, self._length))

    def _close(self, index: int) -> None:
        node = self.nodes[index]
        first, last = node["first"], len(self.texts)
        node["last"] = last
        node["start"], node["stop"] = (self.texts[first][1], self.texts[last - 1][2]) if first < last else (0, 0)
        if node["tag"] == "a":
            node["raw"] = "".join(self.words[first:last])

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in _BLOCK and self._count.get("p"):
            self._end("p")
        values = {k: v or "" for k, v in attrs if k in _ATTRS}
        above = self.nodes[self._open[-1]] if self._open else None
        node = {k: values.get(k) for k in _ATTRS}
        node["class"] = " ".join(values["class"].split()) if "class" in values else None
        node.update(
            tag=tag, parent=self._open[-1] if self._open else -1, start=0, stop=0, first=len(self.texts), last=0, raw=None,
            crumb=above is not None and (above["crumb"] or "breadcrumb" in (above["class"] or "").split()),
        )
        self.nodes.append(node)
        if tag in _VOID:
            self._close(len(self.nodes) - 1)
        else:
            self._open.append(len(self.nodes) - 1)
            self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if self._count.get(tag):
            self._end(tag)

    def _end(self, tag: str) -> None:
        while True:
            index = self._open.pop()
            self._count[self.nodes[index]["tag"]] -= 1
            self._close(index)
            if self.nodes[index]["tag"] == tag:
                return

    def handle_data(self, data):
        self._pending.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def finish(self) -> None:
        self.close()
        self._flush()
        while self._open:
            self._close(self._open.pop())


def _read(html: str) -> _Page | None:
    page = _Page()
    try:
        page.feed(html)
        page.finish()
    except (AssertionError, ValueError):  # markup the parser refuses: the page counts as unreadable
        return None
    return page


_NODE_ARROW = {
    name: {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[kind]
    for name, kind in (part.split() for part in _NODE.split(", "))
}
_TEXT_ARROW = ("node", "start", "stop", "word")
#: Characters of html that are parsed at once, a page at least: a worker holds the elements of so many and no more.
_LOT = 1 << 20


def _lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``_LOT`` characters of html."""
    ends = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column("html")), pa.int64())).to_pylist()
    first, before = 0, 0
    for i, end in enumerate(ends):
        if end - before >= _LOT or i + 1 == len(ends):
            yield batch.slice(first, i + 1 - first)
            first, before = i + 1, end


def _lists(counts: list[int], columns: list[pa.Array], names: list[str]) -> pa.Array:
    offsets = pa.array([0, *accumulate(counts)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lot in _lots(batch):
            yield _parse_lot(lot)


def _parse_lot(lot: pa.RecordBatch) -> pa.RecordBatch:
    pages = [_read(html) for html in lot.column("html").to_pylist()]
    read = [p for p in pages if p is not None]
    nodes = [n for p in read for n in p.nodes]
    texts = [t for p in read for t in p.texts]
    return pa.RecordBatch.from_arrays(
        [
            lot.column("page_id"), lot.column("url"),
            pa.array([p is not None for p in pages]),
            pa.array([" ".join(p.words) if p else None for p in pages], pa.string()),
            _lists([len(p.nodes) if p else 0 for p in pages],
                   [pa.array([n[name] for n in nodes], kind) for name, kind in _NODE_ARROW.items()], list(_NODE_ARROW)),
            _lists([len(p.texts) if p else 0 for p in pages],
                   [pa.array([t[i] for t in texts], pa.int32()) for i in range(3)]
                   + [pa.array([w for p in read for w in p.words], pa.string())], list(_TEXT_ARROW)),
        ],
        names=["page_id", "url", "parsed", "text", "nodes", "texts"],
    )


def dom_pass(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page text, elements and text nodes.

    No shuffle: every input split is parsed where it is read, in Arrow batches, of which a worker parses
    and gives back a small lot at a time.
    """
    return pages.select("page_id", "url", "html").where(F.col("html").isNotNull()).mapInArrow(_parse_batches, DOM)


# --- column helpers over the table above --------------------------------------


def node_text(node: Column, texts: str = "texts") -> Column:
    """Visible text of an element, white space collapsed: its pieces, joined."""
    own = F.slice(F.col(texts), node["first"] + 1, node["last"] - node["first"])
    return F.array_join(F.transform(own, lambda t: t["word"]), " ")


def matches(node: Column, selector: str) -> Column:
    """``tag``, ``.class``, ``[attr*=part]`` or ``[attr=value]``."""
    if selector.startswith("."):
        found = F.concat(F.lit(" "), node["class"], F.lit(" ")).contains(f" {selector[1:]} ")  # single blanks between classes
    elif selector.startswith("["):
        name, value = selector[1:-1].split("=", 1)
        if name.endswith("*"):
            found = node[name[:-1]].contains(value)
        else:
            found = node[name] == value
    else:
        found = node["tag"] == selector
    return F.coalesce(found, F.lit(False))


def outer_texts(selector: str, nodes: str = "nodes") -> Column:
    """Texts of the elements a selector finds that lie in no other it finds, in page order.

    An element's text holds that of the elements inside it, so a rule that takes the first
    hit reads the same; and all texts together are no longer than the page.
    """
    spans = F.transform(F.filter(F.col(nodes), lambda n: matches(n, selector) & (n["last"] > n["first"])),
                        lambda n: F.struct(n["first"].alias("first"), n["last"].alias("last")))
    none = F.expr("cast(array() as array<struct<first: int, last: int>>)")

    def step(state: Column, n: Column) -> Column:
        outside = n["first"] >= state["end"]
        return F.struct(F.when(outside, n["last"]).otherwise(state["end"]).alias("end"),
                        F.when(outside, F.array_append(state["kept"], n)).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate(spans, F.struct(F.lit(0).alias("end"), none.alias("kept")), step)["kept"]
    return F.transform(kept, lambda n: node_text(n))


def first_node(predicate, nodes: str = "nodes") -> Column:
    return F.get(F.filter(F.col(nodes), predicate), F.lit(0))


def json_ld(nodes: str = "nodes") -> Column:
    """Contents of the page's JSON-LD scripts."""
    blobs = F.filter(
        F.col(nodes),
        lambda n: (n["tag"] == "script") & (n["type"] == "application/ld+json") & (F.length(n["raw"]) > 0),
    )
    return F.transform(blobs, lambda n: n["raw"])
