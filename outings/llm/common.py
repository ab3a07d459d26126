"""Helpers the training-data operators share: appended results, packed numbers, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.session import materialize

__all__ = ["append", "arrow", "components", "free_name", "hash_words", "materialize", "pack", "parts", "release", "table", "texts", "unpack"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(ddl: str) -> pa.Schema:
    """A schema for Arrow batches; made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist() if pa.types.is_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def parts(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that what Python makes of a slice stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def release() -> None:
    """Give memory that is free back to the system: a worker waits between tasks, and then counts with all it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def append(df: DataFrame, name: str, kind: str, rows: Callable[[pa.RecordBatch], list[dict]]) -> DataFrame:
    """``df`` with one struct column more, which ``rows`` computes for a batch of rows."""
    struct = T.StructType.fromDDL(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(name, struct)])

    kind_ = arrow(f"x struct<{kind}>").field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            added = pa.array(rows(part), kind_)
            yield pa.RecordBatch.from_arrays([*part.columns, added], names=schema.names)
        release()

    return df.mapInArrow(run, schema)


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as differences, each in as few bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


class _Hashes(dict):
    """64-bit hashes of words, kept while there are few enough of them."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def components(edges: DataFrame, purpose: str, most: int = 60) -> DataFrame:
    """The smallest node reachable from each node that an edge (a, b) touches: columns node, label.

    Alternates the two star operations: every node hands its larger neighbours, then its smaller
    ones, to the smallest node next to it, until all edges end in the label. Each step is a minimum
    per node (combined before the shuffle) and a join with it, written to the shared folder, so no
    adjacency list is ever gathered in one place. Nodes are longs. No edges give no rows.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        now = materialize(small, purpose)
        # a star per component: nothing but edges to nodes that are no left end themselves, and the same as before
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
