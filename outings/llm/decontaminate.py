"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are cut into words and put into one automaton (several, one after the other, where they
hold more than ``shard_words`` words: that bound is what a broadcast carries). Every task streams
its documents' words through the automaton and follows the longest match ending at each word: at
``window`` words or more, the last ``window`` words are an occurrence of an item's window. Only
stretches all of whose neighbouring words are neighbours in some item are walked; no match of two
words leaves such a stretch, so nothing is lost. Documents are never shuffled.

Cases: null, empty or wordless text has no words, no hits, and is clean. A null or empty item, or
an empty benchmark, marks nothing. An item without id marks words and is not named. Repeated items
count once per id; repeated documents each get their row. Other columns, whatever their names, are
passed on; the result is one more struct column, last, named ``contamination`` (underscores are
added while that name is taken).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.llm.common import append, free_name, materialize, texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z become a-z; every byte outside the words becomes a space.
FOLD = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if WORD.match(bytes([b])) else 0x20 for b in range(256))

KIND = ("n_words long, n_hit long, longest long, items array<string>, spans array<struct<start: int, stop: int>>, "
        "contaminated boolean, cut string")


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(FOLD).split() if data else []


class Automaton:
    """All substrings (in words) of many items, with the items in which each window occurs."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes], bool]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str | None]] = []  # states that end a window, with the item
        self.whole: dict[int, set] = {}  # states that are a whole short item
        pairs = set()
        self.least = window
        for item, words, short in pieces:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for n, c in enumerate(ids, 1):
                last = self._extend(last, c)
                if n >= window and not short:
                    ends.append((last, item))
            if short:
                self.whole.setdefault(last, set()).add(item)
                self.least = min(self.least, len(ids))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: the state of the last ``window`` words, and the next shorter state that is a whole short item
        self.base, self.shorter = [0] * len(self.next), [0] * len(self.next)
        for s in order:
            up = self.link[s]
            self.base[s] = s if self.length[up] < window else self.base[up]
            self.shorter[s] = up if up in self.whole else self.shorter[up]
        self.items: dict[int, set] = {}
        for s, item in ends:
            self.items.setdefault(self.base[s], set()).add(item)
        size = len(self.vocabulary)
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), np.int64)

    def _new(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings that end in ``c`` after state ``p``; cut off from ``q`` where q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Spans of words hit (merged), items with occurring windows, longest match."""
        known = self.vocabulary.get
        ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set = set()
        longest = 0
        for start, stop in self._stretches(ids):
            s = matched = 0
            for at, c in enumerate(ids[start:stop].tolist(), start + 1):
                while s and c not in self.next[s]:
                    s = self.link[s]
                    matched = self.length[s]
                s = self.next[s].get(c, 0)
                matched = matched + 1 if s else 0
                hit = 0
                if matched >= self.window:
                    found |= self.items.get(self.base[s], set())
                    hit = self.window
                if self.whole:
                    t = s if s in self.whole and matched >= self.length[s] else self.shorter[s]
                    while t:
                        found |= self.whole[t]
                        hit = max(hit, self.length[t])
                        t = self.shorter[t]
                if hit:
                    longest = max(longest, matched)
                    spans.append((at - hit, at))
        return merged(spans), found, longest

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of known words, each next to the one before it in some item, of the least window's length at least."""
        if len(ids) < self.least:
            return
        known = ids >= 0
        near = known[1:] & known[:-1]
        at = np.flatnonzero(near)
        if len(at):
            keys = ids[at] * len(self.vocabulary) + ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
            near[at] = self.pairs[place] == keys if len(self.pairs) else False
        breaks = np.flatnonzero(~near) + 1
        starts, stops = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(ids)]])
        for i in np.flatnonzero((stops - starts >= self.least) & known[starts]):
            yield int(starts[i]), int(stops[i])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[str, Automaton] = {}


def _automaton(shared, window: int) -> Automaton:
    """The automaton of a broadcast, built once in a worker."""
    if shared.id not in _built:
        _built.clear()
        _built[shared.id] = Automaton(shared.value, window)
    return _built[shared.id]


class _Shared:
    """A broadcast with a name that tells it from others in a worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(data.translate(bytes((b | 0x20) if 0x41 <= b <= 0x5A else b for b in range(256))))]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, data[last:]])


def _pieces(benchmark: DataFrame, item_id: str, item_text: str, window: int, most: int) -> DataFrame:
    """Items as pieces of at most ``most`` words that share ``window - 1`` words with the next, so that none loses a window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                w = words_of(text)
                for at in range(0, max(1, len(w) - window + 1), most - window + 1):
                    if w:
                        rows.append({"item": item, "words": b" ".join(w[at:at + most]), "short": len(w) < window})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.string()), ("words", pa.binary()), ("short", pa.bool_())]))

    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).mapInArrow(
        cut, "item string, words binary, short boolean")


def _shards(pieces: DataFrame, most: int) -> Iterator[list[tuple[str | None, list[bytes], bool]]]:
    """Pieces in lots of at most ``most`` words; the driver holds one lot."""
    lot, size = [], 0
    for row in pieces.toLocalIterator():
        words = bytes(row.words).split()
        if lot and size + len(words) > most:
            yield lot
            lot, size = [], 0
        lot.append((row.item, words, row.short))
        size += len(words)
    if lot:
        yield lot


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 13, times: int = 20, min_span: int = 13, shard_words: int = 100_000) -> DataFrame:
    """``docs`` with what of them lies in ``benchmark``, as one struct column.

    n_words, n_hit: words, and words inside an occurrence of a window (``window`` words of an item, or
    a whole shorter item). longest: the longest match with words of the items that holds a window. items: ids of the items with occurring
    windows, sorted. spans: hit words as [start, stop). contaminated: ``times * n_hit >= n_words`` and a
    hit. cut: the text without the spans of ``min_span`` words and more, and without spans at all where the
    document is contaminated; null where the text stands as it is.
    """
    name = free_name(docs, "contamination")
    context, out = docs.sparkSession.sparkContext, docs
    rounds = _shards(_pieces(benchmark, item_id, item_text, window, shard_words), shard_words)
    ahead = next(rounds, [])
    first = True
    while True:
        lot, ahead = ahead, next(rounds, None)
        shared = _Shared(context.broadcast(lot))
        column, old = docs.columns.index(text), None if first else len(docs.columns)

        def rows(batch: pa.RecordBatch, shared=shared, old=old) -> list[dict]:
            found = []
            automaton = _automaton(shared, window)
            before = batch.column(old).to_pylist() if old is not None else [None] * batch.num_rows
            for data, had in zip(texts(batch.column(column)), before):
                words = words_of(data)
                spans, items, longest = automaton.scan(words)
                items.discard(None)
                if had:
                    spans = merged(spans + [(x["start"], x["stop"]) for x in had["spans"]])
                    items, longest = items | set(had["items"]), max(longest, had["longest"])
                hit = sum(b - a for a, b in spans)
                bad = hit > 0 and times * hit >= len(words)
                gone = [x for x in spans if bad or x[1] - x[0] >= min_span]
                found.append({
                    "n_words": len(words), "n_hit": hit, "longest": longest, "items": sorted(items),
                    "spans": [{"start": a, "stop": b} for a, b in spans], "contaminated": bad,
                    "cut": _without(data, gone).decode() if gone else None})
            return found

        done = append(out, free_name(out, name), KIND, rows)
        if not first:
            done = done.drop(name).withColumnRenamed(done.columns[-1], name)
        if ahead is None:
            return done
        out, first = materialize(done, "decontaminate"), False
