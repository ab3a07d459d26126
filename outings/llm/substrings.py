"""Removal of repeated passages, found by fixed blocks.

Every document is cut into non-overlapping blocks of (window + 1) / 2 words, the anchors. Any run of
``window`` words holds one whole anchor of its document, so a run that two documents share is found
by looking up every rolling block-length window of one among the anchors of the other. Hits are then
extended to the runs of ``window`` words around them, equal runs meet, and each learns the smallest
document it starts in; overlapping runs merge into maximal repeats.

Documents are dealt out once, to batches of about ``batch_bytes`` of text; that exchange is read
three times (Spark reuses it), the text moves only once:

1. a batch sends the distinct hashes of its rolling windows, packed to about three bytes each and
   marked where one is an anchor, to the shard that owns the hash;
2. a shard tells each batch which of its hashes are anchors that another document holds too. A hash
   comes at most once from a batch, however often a passage is repeated;
3. a batch sends the runs around its hits, once each, with the smallest document of its own;
4. the owning shard tells those batches whose smallest document is not the smallest of all;
5. a batch marks the runs so named and those it repeats itself, and cuts their words.

Runs are told apart by 64 bits of hash; the shorter hash of steps 1 and 2 only chooses candidates.
A batch or shard is the largest thing a task holds; both are sized from the bytes of the input. Rows are
dealt by id and text, so a repeated id is spread too: runs are judged by ids, wherever their rows lie.
Only rows with the same id and the same text share a batch whatever their number.

Cases: null or empty text has no words. A document without id is neither changed nor looked at: such rows
stay where they are read and never enter a batch. Rows that share an id are one document, so they do not
count as repeats of each other. Repeats inside one document stay. Other columns are passed on; the result is one more struct column, last, named
``repeats`` (underscores are added while that name is taken). No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.common import append, arrow, free_name, hash_words, pack, texts, unpack

KIND = "n_words long, n_removed long, spans array<struct<start: int, stop: int>>, kept string"
SHORT = np.uint64(30)  # bits of a rolling window's hash within its shard
ONE = np.uint64(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive word hashes."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    x = np.zeros(size, np.uint64)
    for j in range(n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[j:j + size]
    for shift, factor in ((np.uint64(32), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(29), np.uint64(0xBF58476D1CE4E5B9))):
        x = (x ^ (x >> shift)) * factor
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a batch of documents, in ascending order of their ids."""

    def __init__(self, ids: pa.ChunkedArray, text: pa.ChunkedArray):
        self.rows = ids.to_numpy(zero_copy_only=False) if ids.null_count == 0 else None
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.lexsort((values, ~known))
        data = texts(text.combine_chunks())
        self.words = [data[i].split() if data[i] else [] for i in self.order]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.ids, self.known = values[self.order], known[self.order]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.hashes = hash_words([x for w in self.words for x in w])
        self.row = np.repeat(np.arange(len(self.words)), self.lengths)

    def valid(self, n: int) -> np.ndarray:
        """Whether ``n`` words from here are within one document that has an id."""
        size = max(0, len(self.hashes) - n + 1)
        return (self.row[:size] == self.row[n - 1:n - 1 + size]) & self.known[self.row[:size]]

    def anchored(self, n: int) -> np.ndarray:
        size = max(0, len(self.hashes) - n + 1)
        return (np.arange(size) - self.starts[self.row[:size]]) % n == 0


def short(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of a hash, and the bits that stand for it there."""
    return h >> np.uint64(64 - bits), (h >> (np.uint64(64 - bits) - SHORT)) & ((ONE << SHORT) - ONE)


def by_shard(shards: np.ndarray):
    """Slices of equal values in an ascending array."""
    cuts = np.flatnonzero(np.diff(shards)) + 1 if len(shards) else []
    edges = [0, *cuts, len(shards)] if len(shards) else []
    return [(int(shards[a]), slice(a, b)) for a, b in zip(edges, edges[1:])]


def probes(words: Words, n: int, bits: int) -> list[tuple[int, bytes]]:
    """Per shard the distinct rolling windows: hash, whether several documents hold it, whether one is an anchor."""
    ok = words.valid(n)
    h, row, anchor = grams(words.hashes, n)[ok], words.row[:len(ok)][ok], words.anchored(n)[ok]
    shard, rest = short(h, bits)
    key = (shard << SHORT) | rest
    order = np.argsort(key, kind="stable")
    key, ids, anchor = key[order], words.ids[row[order]], anchor[order]
    if not len(key):
        return []
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.concatenate([first[1:], [len(key)]]) - 1
    several = ids[first] != ids[last]  # ids ascend within a key
    marked = np.bitwise_or.reduceat(anchor, first)
    key = key[first]
    value = ((key & ((ONE << SHORT) - ONE)) << np.uint64(2)) | (several.astype(np.uint64) << ONE) | marked.astype(np.uint64)
    return [(s, pack(value[at])) for s, at in by_shard(key >> SHORT)]


def shared_anchors(batches: list[int], data: list[bytes]) -> list[tuple[int, bytes]]:
    """For each batch the hashes it sent that are an anchor and are held by more than one document."""
    values = [unpack(d) for d in data]
    value = np.concatenate(values)
    batch = np.repeat(np.array(batches, np.int64), [len(v) for v in values])
    order = np.argsort(value >> np.uint64(2), kind="stable")
    value, batch = value[order], batch[order]
    key = value >> np.uint64(2)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    flags = np.bitwise_or.reduceat(value & np.uint64(3), first)
    found = np.repeat((flags & ONE).astype(bool) & ((size > 1) | (flags > ONE)), size)
    key, batch = key[found], batch[found]
    order = np.argsort(batch, kind="stable")
    return [(b, pack(key[order][at])) for b, at in by_shard(batch[order])]


def runs(words: Words, n: int, window: int, bits: int, replies: list[tuple[int, bytes]]) -> list[tuple[int, bytes, bytes]]:
    """Per shard the distinct runs of ``window`` words around a hit, with the smallest document that has each."""
    hits = np.sort(np.concatenate([(np.uint64(s) << SHORT) | unpack(d) for s, d in replies] or [np.empty(0, np.uint64)]))
    ok = words.valid(window)
    if not len(hits) or not len(ok):
        return []
    shard, rest = short(grams(words.hashes, n), bits)
    key = (shard << SHORT) | rest
    near = np.concatenate([[0], np.cumsum(hits[np.minimum(np.searchsorted(hits, key), len(hits) - 1)] == key)])
    step = window - n + 1
    at = np.flatnonzero(ok & (near[step:step + len(ok)] > near[:len(ok)]))
    h, place = np.unique(grams(words.hashes, window)[at], return_index=True)
    ids = words.ids[words.row[at[place]]]
    mask = (ONE << np.uint64(64 - bits)) - ONE
    return [(s, pack(h[x] & mask), numbers(ids[x])) for s, x in by_shard(h >> np.uint64(64 - bits))]


def numbers(ids: np.ndarray) -> bytes:
    """Signed numbers as the smallest and the distances from it, in as few bytes as the largest needs."""
    low = ids.min()
    away = ids.astype(np.uint64) - np.uint64(low.astype(np.uint64))
    width = max(1, -(-int(away.max()).bit_length() // 8))
    return low.tobytes() + np.ascontiguousarray(away.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_numbers(data: bytes, count: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint64, 1)
    away = np.zeros((count, 8), np.uint8)
    body = np.frombuffer(data, np.uint8, offset=8).reshape(count, -1)
    away[:, :body.shape[1]] = body
    return (away.reshape(-1).view(np.uint64) + low).view(np.int64)


def later(batches: list[int], keys: list[bytes], ids: list[bytes]) -> list[tuple[int, bytes]]:
    """For each batch the runs that a smaller document of another batch has."""
    values = [unpack(k) for k in keys]
    h = np.concatenate(values)
    doc = np.concatenate([from_numbers(d, len(v)) for d, v in zip(ids, values)])
    batch = np.repeat(np.array(batches, np.int64), [len(v) for v in values])
    order = np.lexsort((doc, h))
    h, doc, batch = h[order], doc[order], batch[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    low = np.repeat(doc[first], np.diff(np.concatenate([first, [len(h)]])))
    h, batch = h[doc > low], batch[doc > low]
    order = np.argsort(batch, kind="stable")
    return [(b, pack(h[order][at])) for b, at in by_shard(batch[order])]


def removed(words: Words, window: int, bits: int, replies: list[tuple[int, bytes]]) -> np.ndarray:
    """For each word whether a run that a smaller document has too covers it."""
    told = np.sort(np.concatenate([(np.uint64(s) << np.uint64(64 - bits)) | unpack(d) for s, d in replies] or [np.empty(0, np.uint64)]))
    ok = np.flatnonzero(words.valid(window))
    gone = np.zeros(len(words.hashes) + 1, np.int64)
    if len(ok):
        h = grams(words.hashes, window)[ok]
        ids = words.ids[words.row[ok]]
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        bad = ids > ids[first][back]
        if len(told):
            bad |= told[np.minimum(np.searchsorted(told, h), len(told) - 1)] == h
        np.add.at(gone, ok[bad], 1)
        np.add.at(gone, ok[bad] + window, -1)
    return np.cumsum(gone)[:-1] > 0


def cut(words: Words, gone: np.ndarray) -> list[dict]:
    """The result of each document, in the order of the rows."""
    out: list[dict] = [{}] * len(words.words)
    for i, (row, own) in enumerate(zip(words.order, words.words)):
        bad = gone[words.starts[i]:words.starts[i + 1]]
        n = int(bad.sum())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], bad.astype(np.int8), [0]]))).reshape(-1, 2).tolist() if n else []
        kept = own if not n else [w for w, b in zip(own, bad.tolist()) if not b]
        out[row] = {"n_words": len(own), "n_removed": n, "spans": [{"start": a, "stop": b} for a, b in edges],
                    "kept": b" ".join(kept).decode()}
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13,
                   batch_bytes: int = 4 << 20, shard_words: int = 2_000_000) -> DataFrame:
    """``docs`` with what is left of each text, as one struct column.

    A word goes when a run of ``window`` words covers it whose words also start in a document with a
    smaller id. n_words, n_removed; spans: removed words as [start, stop); kept: the other words with
    one space between them. Runs are judged on the text as given.
    """
    n = (window + 1) // 2
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first().n
    count = max(1, -(-size // batch_bytes))
    bits = max(3, int(size / 6 / shard_words).bit_length())
    name, key = free_name(docs, "repeats"), free_name(docs, "batch")
    dealt = docs.where(F.col(doc_id).isNotNull()).withColumn(
        key, F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)), F.lit(count)).cast("int"))
    id_at, text_at, key_at = docs.columns.index(doc_id), docs.columns.index(text), len(docs.columns)
    packed = "shard int, batch int, data binary"

    def words(part: pa.Table) -> Words:
        return Words(part.column(id_at), part.column(text_at))

    def rows(part: pa.Table) -> list[tuple[int, bytes]]:
        return list(zip(part.column("shard").to_pylist(), part.column("data").to_pylist()))

    def told(batches: list[tuple], shard) -> pa.Table:
        return pa.table({
            "shard": pa.array([shard] * len(batches), pa.int32()), "batch": pa.array([b for b, _ in batches], pa.int32()),
            "data": pa.array([d for _, d in batches], pa.binary())})

    def probe(part: pa.Table) -> pa.Table:
        out = probes(words(part), n, bits)
        return pa.table({
            "shard": pa.array([s for s, _ in out], pa.int32()), "batch": pa.array([part.column(key_at)[0].as_py()] * len(out), pa.int32()),
            "data": pa.array([d for _, d in out], pa.binary())})

    def match(part: pa.Table) -> pa.Table:
        return told(shared_anchors(part.column("batch").to_pylist(), part.column("data").to_pylist()), part.column("shard")[0].as_py())

    def extend(part: pa.Table, replies: pa.Table) -> pa.Table:
        out = runs(words(part), n, window, bits, rows(replies))
        return pa.table({
            "shard": pa.array([s for s, _, _ in out], pa.int32()), "batch": pa.array([part.column(key_at)[0].as_py()] * len(out), pa.int32()),
            "data": pa.array([d for _, d, _ in out], pa.binary()), "ids": pa.array([d for _, _, d in out], pa.binary())})

    def judge(part: pa.Table) -> pa.Table:
        return told(later(*(part.column(c).to_pylist() for c in ("batch", "data", "ids"))), part.column("shard")[0].as_py())

    kind = arrow(f"x struct<{KIND}>").field(0).type
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL(KIND))])

    def finish(part: pa.Table, replies: pa.Table) -> pa.Table:
        own = words(part)
        result = cut(own, removed(own, window, bits, rows(replies)))
        return part.remove_column(key_at).append_column(name, pa.array(result, kind))

    batches = dealt.groupBy(key)
    hits = batches.applyInArrow(probe, packed).groupBy("shard").applyInArrow(match, packed)
    found = batches.cogroup(hits.groupBy("batch")).applyInArrow(extend, f"{packed}, ids binary")
    verdicts = found.groupBy("shard").applyInArrow(judge, packed)
    judged = batches.cogroup(verdicts.groupBy("batch")).applyInArrow(finish, schema)

    def untouched(part: pa.RecordBatch) -> list[dict]:
        own = [d.split() if d else [] for d in texts(part.column(text_at))]
        return [{"n_words": len(w), "n_removed": 0, "spans": [], "kept": b" ".join(w).decode()} for w in own]

    return judged.unionByName(append(docs.where(F.col(doc_id).isNull()), name, KIND, untouched))
