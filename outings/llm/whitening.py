"""Whitened embeddings: weighted covariance over distinct vectors, each whitened once.

Every entry c becomes the whole number x = floor(64 c) + ``BASE``. Rows of equal x-vectors are one class with
a count. The classes, weighted with their counts (``weights="count"``, the fit list is all rows) or with one
(``weights="one"``, the fit list is the distinct vectors), give

1. n and the sums S, as whole numbers, summed in each task and then per dimension;
2. the covariance V about S/n: each task centres its vectors and multiplies them with their weights, the
   products are summed per cell, D (D + 1) / 2 of them a task and at the driver, whatever the number of rows;
3. V's unit eigenvectors by falling eigenvalue e. A class is projected on the leading ones, over sqrt(e);
4. the largest deviation of the whitened vectors' own covariance from the identity, measured the same way.

The whitened classes are joined back to the rows. Classes that hold more than a share of 1 / (4 x shuffle
partitions) of all rows, at most that many, are sent to the rows; the others meet them by a shuffle in which no
key is large.

Cases: rows whose vector is null or holds null or non-finite entries are dropped. Shorter vectors, also empty
ones, are read as if filled with zeros. Entries are cut to +-2^60 before they are rounded, where rounding no
longer means anything. A ``deviation`` beyond a long is null. Directions without variance (e at most ``FLAT``
of the largest) have no component: a single vector, or copies of one, have none. Rows are passed on as they are,
null and repeated ids too; one struct column more, last, ``whitening`` (underscores are added while that name is
taken). No rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.llm.common import free_name, materialize

BASE = 1_000_000
EDGE = float(1 << 60)
FLAT = 1e-12
LONG = (1 << 63) - 1
PART = 4096  # vectors multiplied at once


def whole_numbers(embedding: str) -> F.Column:
    """floor(64 c) + BASE of each entry; null where the vector is null or an entry is null or not finite."""
    c = F.transform(F.col(embedding), lambda v: v.cast("double"))
    good = F.col(embedding).isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.floor(F.greatest(F.least(v * 64, F.lit(EDGE)), F.lit(-EDGE))) + F.lit(BASE).cast("long"))
    return F.when(good, x)


def vectors_of(column: pa.Array, size: int) -> np.ndarray:
    """x - BASE of a list column, rows of ``size`` entries."""
    out = np.zeros((len(column), size), np.int64)
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy() - BASE
    if len(column) and (counts == size).all():
        return flat.reshape(len(column), size)
    out[np.arange(size) < counts[:, None]] = flat
    return out


def exact_sums(y: np.ndarray, w: np.ndarray) -> list[int]:
    """Weighted sums per dimension, as Python integers where a long might not hold them."""
    most = int(np.abs(y).max(initial=0)) * int(w.sum())
    return (w @ y).tolist() if most < LONG else [int(s) for s in w.astype(object) @ y.astype(object)]


class Centre:
    """The mean S/n as whole part and rest, so that centring is exact to double precision."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in sums])

    def __call__(self, y: np.ndarray) -> np.ndarray:
        return (y - self.whole).astype(np.float64) - self.rest

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n y - S)^2 of each row; null where it is no long."""
        apart, left = y - self.whole, np.array([s % self.n for s in self.sums], object)
        most = int(np.abs(apart).max(initial=0)) * self.n + self.n
        if most * most * max(1, y.shape[1]) <= LONG:
            d = apart * self.n - left.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = apart.astype(object) * self.n - left
        sums = [int(s) for s in (d * d).sum(axis=1)]
        return [s if s <= LONG else None for s in sums]


def weighted_sums(classes: DataFrame, weights: str, size: int) -> tuple[int, list[int]]:
    """n and the sums of x - BASE."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (size + 1)
        for batch in batches:
            w = batch.column(1).to_numpy() if weights == "count" else np.ones(batch.num_rows, np.int64)
            own = exact_sums(vectors_of(batch.column(0), size), w)
            sums = [a + b for a, b in zip(sums, [*own, int(w.sum())])]
        yield pa.RecordBatch.from_pydict({"i": range(size + 1), "s": [str(s) for s in sums]}, pa.schema([("i", pa.int32()), ("s", pa.string())]))

    rows = classes.select("x", "n").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r.i: int(r.s) for r in rows.collect()}  # a row per dimension
    return found.get(size, 0), [found.get(i, 0) for i in range(size)]


def products(vectors: DataFrame, size: int, centred) -> np.ndarray:
    """The weighted sum of outer products of what ``centred`` makes of a batch: (vectors, weights)."""
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                own, w = centred(batch.slice(at, PART))
                total += (own * w[:, None]).T @ own
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    a, b, v = (cells.column(c).to_numpy() for c in ("i", "j", "v"))
    out[a, b] = out[b, a] = v
    return out


def leading(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; those without variance are left out."""
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    keep = int((values > max(float(values[0]), 0.0) * FLAT).sum()) if len(values) and values[0] > 0 else 0
    keep = min(keep, most)
    return values[:keep].copy(), np.ascontiguousarray(axes[:, :keep])


def whiten(vectors: DataFrame, embedding: str = "embedding", weights: str = "count", most: int = 32) -> DataFrame:
    """``vectors`` with usable vectors only, and n, deviation, whitened and explained (an entry a component), identity_error."""
    if weights not in ("count", "one"):
        raise ValueError("weights must be count or one")
    spark = vectors.sparkSession
    name, key = free_name(vectors, "whitening"), free_name(vectors, "__x")
    rows = vectors.withColumn(key, whole_numbers(embedding)).where(F.col(key).isNotNull())
    size = rows.agg(F.coalesce(F.max(F.size(key)), F.lit(0))).first()[0]
    filled = F.when(F.size(key) < size, F.concat(key, F.array_repeat(F.lit(BASE).cast("long"), F.lit(size) - F.size(key)))).otherwise(F.col(key))
    rows = rows.withColumn(key, filled)
    classes = materialize(rows.groupBy(F.col(key).alias("x")).agg(F.count("*").alias("n")), "whitening")
    n, sums = weighted_sums(classes, weights, size)
    centre = Centre(n, sums) if n else None

    def weight(batch: pa.RecordBatch) -> np.ndarray:
        w = batch.column(1).to_numpy()
        return w.astype(np.float64) if weights == "count" else np.ones(len(w))

    covariance = products(classes.select("x", "n"), size, lambda b: (centre(vectors_of(b.column(0), size)), weight(b))) / n if n else np.zeros((0, 0))
    values, axes = leading(covariance, most)
    scale = axes / np.sqrt(values) if n else axes
    explained = (values / np.trace(covariance)).tolist() if len(values) else []
    kept = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                y = vectors_of(part.column(0), size)
                flat = pa.array((centre(y) @ scale).reshape(-1))
                z = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * kept, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([z, part.column(1), part.column(0), pa.array(centre.deviations(y), pa.int64())], names=["z", "n", "x", "deviation"])

    done = materialize(classes.select("x", "n").mapInArrow(run, "z array<double>, n long, x array<long>, deviation long"), "whitened")
    told = F.struct(
        F.lit(n).cast("long").alias("n"), F.col("__deviation").alias("deviation"), F.col("__z").alias("whitened"),
        F.lit(explained).cast("array<double>").alias("explained") if explained else F.array().cast("array<double>").alias("explained"),
        F.lit(identity_error(done, kept, n, weight)).cast("double").alias("identity_error"))
    # a class of more than 1 / (4 x partitions) of the rows is sent to them: no more than 4 x partitions such classes exist
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") * 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) > total
    result = done.select(F.col("x").alias(key), F.col("z").alias("__z"), F.col("deviation").alias("__deviation"), heavy.alias("__heavy"))
    large = F.broadcast(result.where("__heavy").drop("__heavy"))
    others = rows.join(F.broadcast(result.where("__heavy").select(key)), key, "left_anti").join(result.where("NOT __heavy").drop("__heavy"), key)
    both = rows.join(large, key).unionByName(others)
    return both.select(*vectors.columns, told.alias(name))


def identity_error(done: DataFrame, kept: int, n: int, weight) -> float:
    """How far the covariance of the whitened vectors is from the identity, at most in an entry."""
    if not kept:
        return 0.0

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy().reshape(-1, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(kept)
        for batch in batches:
            sums += weight(batch) @ matrix(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(kept), pa.int32()), pa.array(sums)], names=["i", "s"])

    rows = done.select("z", "n").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row per component
    mean = np.zeros(kept)
    for row in rows:
        mean[row.i] = row.s / n
    own = products(done.select("z", "n"), kept, lambda b: (matrix(b) - mean, weight(b))) / n
    return float(np.abs(own - np.eye(kept)).max())
