"""Exact duplicates by Grace hash partitioning: spill files by hash, split until each fits a table of whole texts.

Two texts are equal when they are the same after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Of equal texts
the row with the most code points stays, then the one with the smallest id, then the first one stored.

1. A task reads its rows once. Equal texts of a lot of ``lot_bytes`` are put together in an open-addressing table
   to one record (text, how many, the best row), so a text that a third of all rows have costs a record a lot.
   Rows, with the number of their record, and records are stored.
2. Records are dealt by their hash into buckets of about ``bucket_bytes`` and written to spill files, which a
   manifest lists. A bucket that has grown larger than that consists of several files: each of them is put together
   again in a table and what is left is dealt by other bits of the hash into new spill files, level after level.
3. A bucket that fits is loaded into one table, which decides its classes. Levels hand their answers back.
4. Rows take the answer of their record; a record has the rows of one lot, so no key is large.

Texts are told apart by their whole content, hashes only deal them out. A task holds a lot, or a bucket, and one
record more. Rows and records, spill files and answers lie in the shared folder; the manifest of successful tasks
says which files count, so a task that is run twice leaves an unnamed file and no harm.

Cases: null counts as empty, and empty equals blank. Rows without id count, lose to rows with one, and are told
apart; of rows with equal ids and equal length the first one stored stays. ``keep_id`` is null where no row of the
class that could stay has an id. Columns named in ``carry`` (all, unless given) are passed on; one struct column
more, last, ``copies`` (underscores are added while that name is taken). No rows give none.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.common import arrow, free_name, materialize
from outings.llm.files import opened
from outings.session import scratch_dir

BLANK = b" \t\n\x0b\x0c\r"
RECORD = "rec long, h long, n long, chars long, low long, row long, body binary"
FIELDS = ["rec", "h", "n", "chars", "low", "row", "body"]
LEVELS = 40
SHIFT = 40  # bits for the rows of a task


class Table:
    """Open addressing with linear probing; an entry is found by its hash and its whole content."""

    def __init__(self):
        self.slots, self.mask, self.hashes, self.bodies, self.bytes = [-1] * 64, 63, [], [], 0

    def place(self, h: int, body: bytes) -> int:
        """The entry of ``body``; entries count from 0, in the order they come."""
        slots, hashes, bodies, at = self.slots, self.hashes, self.bodies, h & self.mask
        while (entry := slots[at]) >= 0:
            if hashes[entry] == h and bodies[entry] == body:
                return entry
            at = (at + 1) & self.mask
        entry = slots[at] = len(hashes)
        hashes.append(h)
        bodies.append(body)
        self.bytes += len(body)
        if 2 * entry > self.mask:
            self._grow()
        return entry

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry

    def __len__(self) -> int:
        return len(self.hashes)


def rank(chars: int, low: int | None, row: int) -> tuple:
    """The least one stays."""
    return -chars, low is None, low or 0, row


class Classes:
    """A table with the count and the best row of each entry."""

    def __init__(self):
        self.table, self.counts, self.best = Table(), [], []

    def add(self, h: int, body: bytes, n: int, chars: int, low: int | None, row: int) -> int:
        entry, own = self.table.place(h, body), rank(chars, low, row)
        if entry == len(self.counts):
            self.counts.append(n)
            self.best.append((own, chars, low, row))
        else:
            self.counts[entry] += n
            if own < self.best[entry][0]:
                self.best[entry] = (own, chars, low, row)
        return entry


def file_rows(path: str) -> Iterator[tuple]:
    with opened(path, "rb") as file, pa.ipc.open_stream(file) as stream:
        for batch in stream:
            yield from zip(*[c.to_pylist() for c in batch.columns])


def stored_rows(docs: DataFrame, doc_id: str, text: str, carry: list[str], lot_bytes: int) -> DataFrame:
    """Rows (carried columns, rec, row, sha) and records (``RECORD``) in one stored table; rec is null for neither, n for rows."""
    kept = [docs.schema[c] for c in carry]
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]
    schema = T.StructType([*fields, T.StructField("sha", T.StringType()), *T.StructType.fromDDL(RECORD).fields])
    source = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(doc_id).cast("long").alias("__id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__body"),
        F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("__chars"))
    record = arrow(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << SHIFT
        base = at = first  # of records, of rows
        lot = Classes()

        def records() -> pa.RecordBatch:
            best = lot.best
            columns = [
                pa.array(range(base, base + len(best)), pa.int64()), pa.array(lot.table.hashes, pa.int64()), pa.array(lot.counts, pa.int64()),
                pa.array([b[1] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.int64()),
                pa.array([b[3] for b in best], pa.int64()), pa.array(lot.table.bodies, pa.binary())]
            nulls = [pa.nulls(len(best), t) for t in kinds]
            return pa.RecordBatch.from_arrays([*nulls, *columns], names=schema.names)

        kinds = [pa.string()]
        for batch in batches:
            kinds = [*[c.type for c in batch.columns[:len(carry)]], pa.string()]
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids, bodies, chars = (part.column(len(carry) + k).to_pylist() for k in range(3))
                recs, shas = [], []
                for i, raw, n in zip(ids, bodies, chars):
                    body = raw.translate(None, BLANK)
                    sha = hashlib.sha256(body)
                    h = int.from_bytes(sha.digest()[:8], "little", signed=True)
                    recs.append(base + lot.add(h, body, 1, n, i, at))
                    shas.append(sha.hexdigest())
                    at += 1
                rows = pa.array(range(at - part.num_rows, at), pa.int64())
                empty = [pa.nulls(part.num_rows, record.field(f).type) for f in FIELDS[1:]]
                empty[FIELDS.index("row") - 1] = rows
                yield pa.RecordBatch.from_arrays([*part.columns[:len(carry)], pa.array(shas), pa.array(recs, pa.int64()), *empty], names=schema.names)
                if lot.table.bytes >= lot_bytes:
                    yield records()
                    base, lot = base + len(lot.table), Classes()
        if len(lot.table):
            yield records()

    stored = scratch_dir(docs.sparkSession, "grace-rows")
    source.mapInArrow(run, schema).write.option("compression", "zstd").parquet(stored)
    return docs.sparkSession.read.schema(schema).parquet(stored)


def spill(records: DataFrame, level: int, bucket_bytes: int, within: str | None = None) -> DataFrame:
    """Deal records by hash into spill files; the manifest (bucket, path, n, bytes), a row per file.

    ``within``: the bucket of the level before, each of which is split by itself.
    """
    spark = records.sparkSession
    size = F.octet_length("body") + F.lit(64)
    if within is None:
        total = records.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        split, number = F.lit(max(1, -(-2 * total // bucket_bytes))), F.lit("")
    else:
        totals = records.groupBy(within).agg((F.greatest(F.lit(2), F.ceil(2 * F.sum(size) / bucket_bytes))).cast("long").alias("__split"))
        records = records.join(F.broadcast(totals), within)  # a row per bucket that is too large
        split, number = F.col("__split"), F.concat(F.col(within), F.lit("."))
        total = None
    bucket = F.concat(number, F.pmod(F.xxhash64("h", F.lit(level)), split).cast("string"))
    dealt = records.select(bucket.alias("bucket"), *FIELDS)
    folder, record = scratch_dir(spark, f"grace-spill-{level}"), arrow(RECORD)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if total is not None:
        parts = max(1, min(parts, -(-2 * total // bucket_bytes)))
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, held = [], None, []  # of one file: batches
        path = file = sink = None
        n = size_ = 0

        def close() -> None:
            nonlocal file, n, size_
            if file:
                sink.close()
                file.close()
                out.append({"bucket": now, "path": path, "n": n, "bytes": size_})
            file, n, size_ = None, 0, 0

        def put(rows: list[tuple]) -> None:
            nonlocal path, file, sink
            if not rows:
                return
            if file is None:
                path = f"{folder}/{uuid.uuid4().hex}.arrows"
                file = opened(path, "wb")
                sink = pa.ipc.new_stream(file, record, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            sink.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), record)], schema=record))

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for bucket_, *row in zip(*[c.to_pylist() for c in part.columns]):
                    full = size_ >= bucket_bytes and n > 1  # two records at least, so that each level leaves fewer
                    if bucket_ != now or full:
                        put(held)
                        close()
                        held, now = [], bucket_
                    held.append(row)
                    n, size_ = n + 1, size_ + len(row[-1]) + 64
                put(held)
                held = []
        close()
        yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.string()), ("path", pa.string()), ("n", pa.int64()), ("bytes", pa.int64())]))

    return materialize(dealt.mapInArrow(write, "bucket string, path string, n long, bytes long"), "grace-manifest")


def decide(files: DataFrame) -> DataFrame:
    """Buckets (paths) that fit, each in one table: rec, keep_row, keep_id, size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths in batch.column(0).to_pylist():
                classes, recs, entries = Classes(), [], []
                for path in paths:
                    for rec, h, n, chars, low, row, body in file_rows(path):
                        recs.append(rec)
                        entries.append(classes.add(h, body, n, chars, low, row))
                yield pa.RecordBatch.from_arrays([
                    pa.array(recs, pa.int64()), pa.array([classes.best[e][3] for e in entries], pa.int64()),
                    pa.array([classes.best[e][2] for e in entries], pa.int64()), pa.array([classes.counts[e] for e in entries], pa.int64())],
                    names=["rec", "keep_row", "keep_id", "size"])

    return files.mapInArrow(run, "rec long, keep_row long, keep_id long, size long")


def shrink(files: DataFrame) -> DataFrame:
    """Files of buckets that do not fit, each put together in one table: links (rec, to) and, with n, the records left."""
    record = arrow(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, path in zip(*[c.to_pylist() for c in batch.columns]):
                classes, recs, entries, firsts = Classes(), [], [], []
                for rec, h, n, chars, low, row, body in file_rows(path):
                    entry = classes.add(h, body, n, chars, low, row)
                    if entry == len(firsts):
                        firsts.append(rec)
                    recs.append(rec)
                    entries.append(entry)
                links = [pa.array(recs, pa.int64()), *[pa.nulls(len(recs), record.field(f).type) for f in FIELDS[1:]]]
                names = ["bucket", "to", *FIELDS]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(recs)), pa.array([firsts[e] for e in entries], pa.int64()), *links], names=names)
                best = classes.best
                left = [firsts, classes.table.hashes, classes.counts, [b[1] for b in best], [b[2] for b in best], [b[3] for b in best], classes.table.bodies]
                yield pa.RecordBatch.from_arrays([
                    pa.array([bucket] * len(firsts)), pa.nulls(len(firsts), pa.int64()), *[pa.array(c, f.type) for c, f in zip(left, record)]], names=names)

    return files.mapInArrow(run, f"bucket string, to long, {RECORD}")


def answers(records: DataFrame, bucket_bytes: int) -> DataFrame:
    """rec, keep_row, keep_id, size of every record."""
    decided, links, within = [], [], None
    for level in range(LEVELS):
        manifest = spill(records, level, bucket_bytes, within)
        per = manifest.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.collect_list("path").alias("paths"))
        fits = (F.col("bytes") <= bucket_bytes) | (F.col("n") == 1)
        parts = max(1, manifest.count())  # a row per file
        decided.append(materialize(decide(per.where(fits).select("paths").repartition(parts)), "grace-answers"))
        large = per.where(~fits).select("bucket", F.explode("paths").alias("path"))
        if large.isEmpty():
            break
        shrunk = materialize(shrink(large.repartition(parts)), "grace-shrunk")
        links.append(shrunk.where("n IS NULL").select("rec", "to"))
        records, within = shrunk.where("n IS NOT NULL").withColumnRenamed("bucket", "within"), "within"
    else:
        raise RuntimeError(f"buckets do not fit after {LEVELS} levels")
    found = decided[-1]
    for link, own in zip(reversed(links), reversed(decided[:-1])):
        found = own.unionByName(link.join(found.withColumnRenamed("rec", "to"), "to").drop("to"))
    return found


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
                 bucket_bytes: int = 32 << 20, lot_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` (its columns ``carry``) with keep_id, group_size, kept and the hash of the normalised text; every row comes back."""
    carry = docs.columns if carry is None else carry
    name = free_name(docs.select(*carry), "copies")
    stored = stored_rows(docs, doc_id, text, carry, lot_bytes)
    found = answers(stored.where("n IS NOT NULL").select(*FIELDS), bucket_bytes)
    rows = stored.where("n IS NULL").select(*[f"c{i}" for i in range(len(carry))], "sha", "rec", "row")
    return rows.join(found, "rec").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.struct(
        F.col("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("sha256")).alias(name))
