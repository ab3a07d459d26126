"""Near-duplicates by SimHash, found with a hierarchical index in Gray order.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Only
distinct fingerprints are compared, so a group of copies costs one. Two fingerprints that differ in
at most ``distance`` bits agree in at least one of ``distance`` + 1 blocks of bits (in several, where
the bits are cut into more blocks), so each is filed under its value in every choice of blocks; the
number of blocks follows from the number of fingerprints.

Within a file the fingerprints are sorted by their rank in the Gray code, where neighbours share long
bit patterns, and cut into segments of at most ``segment`` rows. A segment, and each group of it down
to single fingerprints, is a node: the mask of the bits its members share and their pattern. Two nodes
whose patterns differ in more than ``distance`` bits under both masks are skipped with everything below
them; the masks grow downwards, so differences add up on the way. A file of many segments, say of a
large group of near copies, becomes pairs of segments that several tasks share.

A task gives the links of a spanning forest of what it found, never all pairs of a group. Components
are then settled over all links.

Cases: null text has no words. No words: fingerprint zero, linked like any other. Rows with equal
text or equal id each get their row. A null id never names a component unless no other id is in it.
Other columns are passed on; two columns more, last: ``fingerprint`` (long) and ``component``
(underscores are added while those names are taken). No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.common import components, free_name, materialize, parts, texts

#: A-Z become a-z, nothing else changes.
LOWER = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b for b in range(256))
PART = 1 << 16  # shingles whose bits are counted at once
FAN = 16  # children of a node


def fingerprint(data: bytes | None, width: int) -> int:
    """The SimHash of a text's word shingles."""
    import xxhash

    words = data.translate(LOWER).split() if data else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], stops[:-width]]).tolist()
    ends = (stops[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):
        part = hashes[at:at + PART].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, text: str, width: int) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            bits = np.array([fingerprint(d, width) for d in texts(batch.column(at))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def choices(count: int, distance: int) -> list[int]:
    """Masks of the bits to file by: the fewest blocks that leave about a thousand fingerprints in a file."""
    blocks = distance + 1
    while blocks < distance + 4 and count >> (64 * (blocks - distance) // blocks) > 1000:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


class Index:
    """Fingerprints in Gray order under nodes of shared bits; level 0 holds the fingerprints themselves."""

    def __init__(self, prints: np.ndarray):
        self.all, self.any = [prints], [prints]
        while len(self.all[-1]) > 1:
            at = np.arange(0, len(self.all[-1]), FAN)
            self.all.append(np.bitwise_and.reduceat(self.all[-1], at))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], at))

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes at ``level``, FAN places each, and which of them are there."""
        children = nodes[:, None] * FAN + np.arange(FAN)
        return children, children < len(self.all[level - 1])

    def apart(self, level: int, mine: np.ndarray, other: Index, at: int, theirs: np.ndarray) -> np.ndarray:
        """The least number of bits in which members of two nodes differ."""
        low, high = self.all[level][mine], self.any[level][mine]
        low2, high2 = other.all[at][theirs], other.any[at][theirs]
        shared = ~(low ^ high) & ~(low2 ^ high2)
        return np.bitwise_count((low ^ low2) & shared)


def links(a: Index, b: Index, distance: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within ``distance``, from the roots down; in lots, so that memory stays bounded. a is b: each pair once."""
    same = a is b
    todo = [(len(a.all) - 1, len(b.all) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        i, j, x, y = todo.pop()
        if len(x) > most // (FAN * FAN) and (i or j):
            half = len(x) // 2
            todo += [(i, j, x[:half], y[:half]), (i, j, x[half:], y[half:])]
            continue
        near = a.apart(i, x, b, j, y) <= distance
        x, y = x[near], y[near]
        if not len(x):
            continue
        if not i and not j:
            keep = x < y if same else slice(None)
            yield x[keep], y[keep]
            continue
        down_a, down_b = i >= j, j >= i
        cx, okx = a.below(i, x) if down_a else (x[:, None], np.ones((len(x), 1), bool))
        cy, oky = b.below(j, y) if down_b else (y[:, None], np.ones((len(y), 1), bool))
        ok = okx[:, :, None] & oky[:, None, :]
        nx, ny = np.broadcast_to(cx[:, :, None], ok.shape)[ok], np.broadcast_to(cy[:, None, :], ok.shape)[ok]
        if same:
            keep = nx <= ny
            nx, ny = nx[keep], ny[keep]
        todo.append((i - down_a, j - down_b, nx, ny))


class Forest:
    """Joins places into trees; tells which links were needed."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for p, q in zip(x.tolist(), y.tolist()):
            p0, q0 = self.root(p), self.root(q)
            if p0 != q0:
                self.up[max(p0, q0)] = min(p0, q0)
                out.append((p, q))
        return out


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a: np.ndarray, b: np.ndarray, pairs) -> pa.RecordBatch:
    x, y = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a[x].view(np.int64)), pa.array(b[y].view(np.int64))], schema=EDGE)


def _within(prints: np.ndarray, distance: int) -> pa.RecordBatch:
    index, forest = Index(prints), Forest(len(prints))
    return _edges(prints, prints, [p for x, y in links(index, index, distance) for p in forest.add(x, y)])


def _between(a: np.ndarray, b: np.ndarray, distance: int) -> pa.RecordBatch:
    forest = Forest(len(a) + len(b))
    found = [p for x, y in links(Index(a), Index(b), distance) for p in forest.add(x, y + len(a))]
    return _edges(a, b, [(x, y - len(a)) for x, y in found])


def fingerprint_links(prints: DataFrame, distance: int, segment: int, purpose: str = "simhash") -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints in column ``p`` within ``distance`` of each other."""
    spark = prints.sparkSession
    masks = choices(prints.count(), distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    filed = prints.select("p", F.posexplode(F.array(*[F.col("p").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "value"))
    rank = F.col("p")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = filed.withColumn("rank", rank).repartitionByRange(parts, "choice", "value", "rank").sortWithinPartitions("choice", "value", "rank")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows of one file, in segments of at most ``segment`` rows."""
        held: list[np.ndarray] = []
        file, size = None, 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                all_prints = np.concatenate(held)
                yield pa.RecordBatch.from_pylist([{
                    "choice": file[0], "value": file[1], "first": int(all_prints[0]), "n": len(all_prints),
                    "shared": int(np.bitwise_and.reduce(all_prints)), "any": int(np.bitwise_or.reduce(all_prints)),
                    "prints": all_prints.tobytes()}], SEGMENT)

        for batch in batches:
            p, choice, value = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("p", "choice", "value"))
            edges = np.flatnonzero((np.diff(choice) != 0) | (np.diff(value) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(p)]):
                if a == b:
                    continue
                if file != (choice[a], value[a]):
                    yield from out()
                    held, file, size = [], (int(choice[a]), int(value[a])), 0
                while a < b:
                    take = min(b - a, segment - size)
                    held.append(p[a:a + take].copy())
                    a, size = a + take, size + take
                    if size == segment:
                        yield from out()
                        held, size = [], 0
        yield from out()

    SEGMENT = pa.schema([("choice", pa.int32()), ("value", pa.int64()), ("first", pa.int64()), ("n", pa.int32()),
                         ("shared", pa.int64()), ("any", pa.int64()), ("prints", pa.binary())])
    kind = "choice int, value long, first long, n int, shared long, any long, prints binary"
    segments = materialize(ordered.mapInArrow(cut, kind), purpose)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _within(np.frombuffer(data, np.uint64), distance)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _between(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), distance)

    own = segments.where("n > 1").select("prints").repartition(parts).mapInArrow(inside, "a long, b long")
    # files of several segments: pairs of segments whose shared bits are near enough
    heads = segments.select("choice", "value", "first", "shared", "any")
    several = heads.groupBy("choice", "value").agg(F.count("*").alias("k")).where("k > 1").select("choice", "value")
    heads = heads.join(several, ["choice", "value"], "left_semi")
    left = heads.select("choice", "value", *[F.col(c).alias(f"{c}1") for c in ("first", "shared", "any")])
    right = heads.select("choice", "value", *[F.col(c).alias(f"{c}2") for c in ("first", "shared", "any")])
    fixed = F.bitwise_not(F.col("shared1").bitwiseXOR(F.col("any1"))).bitwiseAND(F.bitwise_not(F.col("shared2").bitwiseXOR(F.col("any2"))))
    pairs = left.join(right, ["choice", "value"]).where("first1 < first2").where(
        F.bit_count(F.col("shared1").bitwiseXOR(F.col("shared2")).bitwiseAND(fixed)) <= distance)
    bodies = segments.select("choice", "value", "first", "prints")
    both = (
        pairs.select("choice", "value", "first1", "first2")
        .join(bodies.withColumnsRenamed({"first": "first1", "prints": "prints1"}), ["choice", "value", "first1"])
        .join(bodies.withColumnsRenamed({"first": "first2", "prints": "prints2"}), ["choice", "value", "first2"])
    )
    other = both.select("prints1", "prints2").repartition(parts).mapInArrow(across, "a long, b long")
    return own.unionByName(other)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4,
                    segment: int = 4096) -> DataFrame:
    """``docs`` with the fingerprint of each text and the smallest id reachable by links of ``distance`` bits."""
    name, group = free_name(docs, "fingerprint"), free_name(docs, "component")
    marked = materialize(with_fingerprint(docs, name, text, width), "simhash")
    prints = materialize(marked.groupBy(F.col(name).alias("p")).agg(F.min(doc_id).alias("low")), "simhash")
    edges = fingerprint_links(prints.select("p"), distance, segment)
    label = components(edges, "simhash")
    labelled = prints.join(label.withColumnRenamed("node", "p"), "p", "left").select(
        "p", "low", F.coalesce("label", "p").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("low").alias(group))
    named = materialize(labelled.join(lowest, "label").select(F.col("p").alias(name), group), "simhash")
    return marked.join(named, name).select(*docs.columns, name, group)
