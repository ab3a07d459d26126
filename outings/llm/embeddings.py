"""Near-duplicate embeddings with the epsilon grid order join.

Two unit vectors have cosine ``threshold`` or more when they are at most eps = sqrt(2 - 2 threshold) apart.
Vectors are projected on their leading principal directions, which are cut into cells of side eps; sorted by
cells, direction after direction, they form a sequence in which a vector's partners lie in few intervals. The
sequence is cut into blocks of at most ``block`` vectors with a bounding box in those directions. Blocks meet
by an equi-join on the cells of the first ``KEYS`` directions and their neighbours; pairs whose boxes are more
than eps apart are skipped. A pair of blocks is joined by halving intervals, skipping those whose boxes are
apart, down to short ones, which are compared in double precision on all components. The directions come from a
bounded sample; they only decide what is skipped, never what links.

Equal vectors are one class with a count, so a group of copies is compared once. Tasks give the number of links
of each vector and the links of a spanning forest, never all pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Shorter
vectors are read as if filled with zeros. Each row counts as a vector of its own, also where ids repeat. Null
ids count as links, but never name a component unless there is no other id in it. Other columns are passed on;
one struct column more, last, ``links`` (underscores are added while that name is taken). No rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.llm.common import components, free_name, materialize
from outings.llm.simhash import Forest

KEYS = 3  # directions whose cells are join keys
SAMPLE = 2048  # vectors the directions are taken from
LEAF = 128
SLACK = 1e-6  # what rounding may add to a distance between projections
FLUSH = 200_000


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of equal length, filled with zeros."""
    out = np.zeros((len(column), size))
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (counts == size).all():
        return flat.astype(np.float64).reshape(len(column), size)
    out[np.arange(size) < counts[:, None]] = flat
    return out


def directions(sample: np.ndarray, most: int) -> np.ndarray:
    """Leading principal directions of unit vectors, as columns."""
    if not len(sample):
        return np.zeros((sample.shape[1], 0))
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(np.cov(unit.T).reshape(unit.shape[1], -1) if len(unit) > 1 else np.eye(unit.shape[1]))
    return vectors[:, ::-1][:, :most]


class Side:
    """A block: vectors in grid order with their norms and projections."""

    def __init__(self, data: bytes, classes: bytes, counts: bytes, size: int, axes: np.ndarray, kind: str):
        self.vectors = np.frombuffer(data, kind).reshape(-1, size).astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.low = self.vectors / self.norms[:, None] @ axes
        self.classes, self.counts = np.frombuffer(classes, np.int64), np.frombuffer(counts, np.int64)

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.low[a:b].min(axis=0), self.low[a:b].max(axis=0)


def gap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """The distance between two boxes."""
    return float(np.sqrt((np.maximum(0, np.maximum(one[0] - two[1], two[0] - one[1])) ** 2).sum()))


def join(x: Side, y: Side, threshold: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places that link, interval by interval; within one block each pair once."""
    same = x is y
    todo = [(0, len(x.norms), 0, len(y.norms))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and a >= d or gap(x.box(a, b), y.box(c, d)) > eps + SLACK:
            continue
        if max(b - a, d - c) <= LEAF:
            cosine = x.vectors[a:b] @ y.vectors[c:d].T / (x.norms[a:b, None] * y.norms[None, c:d])
            i, j = np.nonzero(cosine >= threshold)
            i, j = i + a, j + c
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j
        elif b - a >= d - c:
            todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
        else:
            todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]


def vector_links(classes: DataFrame, threshold: float, block: int, axes: int, kind: str, purpose: str = "embeddings") -> DataFrame:
    """Of distinct vectors (class, v, n): rows (a, null, number of links) and (a, b, null), a forest of links; stored.

    ``kind``: how components are stored on the way, ``f4`` where the vectors are of floats. A pair of blocks
    sends both, so what is shuffled falls with the size of a block, which is also what a task holds.
    """
    spark = classes.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold))
    size = classes.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first().d
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = classes.orderBy(F.xxhash64("v"), "class").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    turn = spark.sparkContext.broadcast(directions(matrix(sample, size), min(axes, size)))  # size x axes numbers
    keys = min(KEYS, axes, size)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), size)
            low = v / np.linalg.norm(v, axis=1, keepdims=True) @ turn.value
            cell = np.floor(low / eps).astype(np.int32) if len(low) else np.zeros((0, 1), np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()),
                pa.array(cell.tolist(), pa.list_(pa.int32()))], names=["class", "n", "v", "cell"])

    ordered = classes.select("class", "v", "n").mapInArrow(cells, "class long, n long, v binary, cell array<int>")
    ordered = materialize(ordered, purpose).repartitionByRange(parts, "cell", "class").sortWithinPartitions("cell", "class")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            side = Side(b"".join(r["v"] for r in held), np.array([r["class"] for r in held]).tobytes(), np.array([r["n"] for r in held]).tobytes(), size, turn.value, kind)
            low, high = side.box(0, len(held))
            row = {"block": held[0]["class"], "low": low.tolist(), "high": high.tolist(), "cells": [list(c) for c in sorted({tuple(r["cell"][:keys]) for r in held})],
                   "v": b"".join(r["v"] for r in held), "classes": side.classes.tobytes(), "counts": side.counts.tobytes()}
            held.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("cells", pa.list_(pa.list_(pa.int32()))),
                ("v", pa.binary()), ("classes", pa.binary()), ("counts", pa.binary())]))

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == block:
                    yield out()
        if held:
            yield out()

    blocks = materialize(ordered.mapInArrow(
        cut, "block long, low array<double>, high array<double>, cells array<array<int>>, v binary, classes binary, counts binary"), purpose)
    heads = blocks.select("block", "low", "high", F.explode("cells").alias("cell"))
    around = F.array(*[F.array(*[F.col("cell")[i] + s for i, s in enumerate(step)]) for step in product((-1, 0, 1), repeat=keys)]) if keys else F.array("cell")
    left = heads.select(F.col("block").alias("x"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.explode(around).alias("cell"))
    right = heads.select(F.col("block").alias("y"), F.col("low").alias("low2"), F.col("high").alias("high2"), "cell")
    apart = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(min(axes, size) - 1)), lambda i: F.pow(F.greatest(
        F.lit(0.0), F.element_at("low1", i + 1) - F.element_at("high2", i + 1), F.element_at("low2", i + 1) - F.element_at("high1", i + 1)), 2)),
        F.lit(0.0), lambda s, g: s + g) if size else F.lit(0.0)
    pairs = left.join(right, "cell").where("x <= y").where(apart <= (eps + SLACK) ** 2).select("x", "y").distinct()
    body = blocks.select("block", "v", "classes", "counts")
    both = pairs.join(body.withColumnsRenamed({"block": "x", "v": "v1", "classes": "c1", "counts": "n1"}), "x").join(
        body.withColumnsRenamed({"block": "y", "v": "v2", "classes": "c2", "counts": "n2"}), "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sums() -> pa.RecordBatch:
            a, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(place, np.concatenate([h[1] for h in held])).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                one, two, v1, c1, n1, v2, c2, n2 = (c[k].as_py() for c in batch.columns)
                x = Side(v1, c1, n1, size, turn.value, kind)
                y = x if one == two else Side(v2, c2, n2, size, turn.value, kind)
                shift = 0 if x is y else len(x.classes)
                forest, edges = Forest(len(y.classes) + shift), []
                mine, theirs = np.zeros(len(x.classes), np.int64), np.zeros(len(y.classes), np.int64)
                for i, j in join(x, y, threshold, eps):
                    mine += np.bincount(i, y.counts[j], len(mine)).astype(np.int64)
                    theirs += np.bincount(j, x.counts[i], len(theirs)).astype(np.int64)
                    edges += forest.add(i, j + shift)
                for side, sum_ in ((x, mine), (y, theirs)):
                    at = np.flatnonzero(sum_)
                    if len(at):
                        held.append((side.classes[at], sum_[at]))
                if edges:
                    i, j = np.array(edges, np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.classes[i]), pa.array(y.classes[j - shift]), pa.nulls(len(i), pa.int64())], names=["a", "b", "n"])
                if sum(len(h[0]) for h in held) > FLUSH:
                    yield sums()
        if held:
            yield sums()

    rows = both.select("x", "y", "v1", "c1", "n1", "v2", "c2", "n2").repartition(2 * parts).mapInArrow(compare, "a long, b long, n long")
    return materialize(rows, purpose)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95,
                 block: int = 4096, axes: int = 8) -> DataFrame:
    """``vectors`` with n_links, component (the smallest id reachable by links) and kept (that id is its own)."""
    name = free_name(vectors, "links")
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    good = (F.col(embedding).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.withColumn("__v", F.when(good, v))
    classes = materialize(
        rows.where("__v is not null").groupBy(F.col("__v").alias("v")).agg(F.count("*").alias("n"), F.min(vec_id).alias("low"))
        .withColumn("class", F.monotonically_increasing_id()), "embeddings")
    kind = "f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "f8"
    found = vector_links(classes, threshold, block, axes, kind)
    label = components(found.where("b is not null").select("a", "b"), "embeddings")
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    marked = classes.join(degree, classes["class"] == degree.a, "left").join(label, F.col("class") == F.col("node"), "left").select(
        "v", "low", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "class").alias("label"))
    lowest = marked.groupBy("label").agg(F.min("low").alias("component"))
    told = materialize(marked.join(lowest, "label").select(
        F.col("v").alias("__v"), F.struct(F.col("n_links"), F.col("component")).alias("__told")), "embeddings")
    component = F.when(F.col("__v").isNull(), F.col(vec_id)).otherwise(F.col("__told.component"))
    return rows.join(told, "__v", "left").select(*vectors.columns, F.struct(
        F.coalesce("__told.n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"),
        F.coalesce(F.col(vec_id) == component, F.lit(False)).alias("kept")).alias(name))
