"""Token ids in files of canonical, length-limited Huffman codes.

Ids are counted over the whole corpus (summed in each task, then per id), the code lengths follow from
the counts by package-merge, at most ``limit`` bits, and the codes from the lengths alone, so a file
carries just those. Documents are encoded where they lie and dealt out by ranges of doc_id; each range
becomes one file in ascending doc_id order:

    magic "TIDH", version, limit, vocabulary size, length of what follows, zlib of one byte a length
    blocks: number of documents, of ids, of checkpoints, of payload bytes; doc_ids; ids per document;
            bit offset of every ``STRIDE``-th id of each document; payload, a document starting on a byte

A table of 2^limit entries decodes an id in one look-up. A block is read by itself, all its checkpoints
side by side. A manifest row per block (file, place, documents, ids), which only tasks that succeeded
leave, says what belongs to the data set: a task run twice leaves an unnamed file and no harm.

Cases: null text is empty, and has the end id alone. Null doc_ids come first; rows with equal doc_id are
in an undefined order among themselves, each with its own ids. No documents give no files and no rows.
Ids unseen in the counts have no code; there are none, as the counts are of all documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outings.llm.common import materialize, parts
from outings.llm.files import opened
from outings.llm.tokens import ids_of, tokenize

MAGIC = b"TIDH"
VERSION = 1
STRIDE = 128
BLOCK = 1 << 20  # payload bytes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    # per level: for each item of the merged list, which leaf it is, or -1 for a package of two items below
    levels, row = [np.arange(len(order))], weights
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        levels.append(np.where(place < len(order), place, -1))
        row = both[place]
    bits = np.zeros(len(order), np.int64)
    take = 2 * len(order) - 2
    for level in reversed(levels):
        chosen = level[:take]
        leaves = chosen[chosen >= 0]
        bits[leaves] += 1  # a leaf occurs once in a level
        take = 2 * (len(chosen) - len(leaves))
    lengths[order] = bits
    return lengths


class Codes:
    """Canonical codes: by length, then by id."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.lengths, self.limit = lengths.astype(np.int64), limit
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = np.int64(1) << (limit - self.lengths[order])  # entries of the table a code takes
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (limit - self.lengths[order])).astype(np.uint64)
        self.order, self.spans = order, spans
        self.table = None

    def encode(self, docs: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
        """Each document's payload, and the bit offsets of its checkpoints in it."""
        count = np.array([len(d) for d in docs], np.int64)
        ids = np.concatenate(docs) if docs else np.empty(0, np.int64)
        size = self.lengths[ids]
        stops = np.concatenate([[0], np.cumsum(size)])
        edges = np.concatenate([[0], np.cumsum(count)])
        room = -(-(stops[edges[1:]] - stops[edges[:-1]]) // 8)
        begin = np.concatenate([[0], np.cumsum(room)])
        at = stops[:-1] + np.repeat(8 * begin[:-1] - stops[edges[:-1]], count)
        words = np.zeros(int(begin[-1]) // 8 + 2, np.uint64)
        code, used = self.codes[ids], (at & 63) + size
        word = at >> 6
        over = used > 64
        left = np.where(over, code >> (used - 64).clip(0).astype(np.uint64), code << (64 - used).clip(0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] = np.bitwise_or.reduceat(left, first)
            words[word[over] + 1] |= code[over] << (128 - used[over]).astype(np.uint64)
        data = words.astype(">u8").tobytes()
        out = []
        for i in range(len(docs)):
            marks = at[edges[i]:edges[i + 1]:STRIDE] - 8 * begin[i]
            out.append((data[begin[i]:begin[i + 1]], marks))
        return out

    def decode(self, payload: bytes, marks: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The ids after each checkpoint (``runs`` of them, at most STRIDE), one after the other."""
        if self.table is None:
            entry = (self.order << 5 | self.lengths[self.order]).astype(np.uint32)  # an id and the length of its code
            self.table = np.zeros(1 << self.limit, np.uint32)  # a single code leaves part of the table free
            self.table[:int(self.spans.sum())] = np.repeat(entry, self.spans)
        b = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        four = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        order = np.argsort(-runs, kind="stable")  # long runs first: those still read are the first ``n``
        left = np.count_nonzero(runs[:, None] > np.arange(STRIDE), axis=0) if len(runs) else np.zeros(STRIDE, np.int64)
        at, out = marks.astype(np.int64)[order], np.zeros((STRIDE, len(marks)), np.uint32)
        drop, mask = np.uint32(32 - self.limit), np.uint32((1 << self.limit) - 1)
        for k in range(STRIDE):
            n = int(left[k])
            if not n:
                break
            p = at[:n]
            entry = self.table[(four[p >> 3] >> (drop - (p & 7).astype(np.uint32))) & mask]
            out[k, :n] = entry >> 5
            p += entry & 31
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out.T[back][np.arange(STRIDE) < runs[:, None]]


def head(lengths: np.ndarray, limit: int) -> bytes:
    body = zlib.compress(lengths.astype(np.uint8).tobytes())
    return MAGIC + np.array([VERSION, limit, len(lengths), len(body)], "<u4").tobytes() + body


def read_head(file) -> tuple[bytes, int, bytes]:
    """Magic, limit and the packed lengths at the start of an open file."""
    file.seek(0)
    start = file.read(20)
    version, limit, _, size = np.frombuffer(start[4:], "<u4").tolist()
    if start[:4] != MAGIC or version != VERSION:
        raise ValueError("not a file of this format")
    return start, limit, file.read(size)


def block(rows: list[tuple[int, int, bytes, bytes]]) -> bytes:
    """Documents (doc_id, number of ids, marks, payload) as one block; a null doc_id is the least number."""
    counts = np.array([r[1] for r in rows], "<u4")
    begin = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])
    marks = np.concatenate([np.frombuffer(r[2], "<u4").astype("<u8") + 8 * int(b) for r, b in zip(rows, begin)])
    return b"".join([
        np.array([len(rows), counts.sum(), len(marks), begin[-1]], "<u8").tobytes(), np.array([r[0] for r in rows], "<i8").tobytes(),
        counts.tobytes(), marks.astype("<u8").tobytes(), *[r[3] for r in rows]])


NONE = -(1 << 63)


def read_block(data: bytes, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and all ids."""
    docs, _, marks, size = np.frombuffer(data, "<u8", 4).astype(int).tolist()
    at = 32
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u4", docs, at + 8 * docs).astype(np.int64)
    begin = np.frombuffer(data, "<u8", marks, at + 12 * docs).astype(np.int64)
    at += 12 * docs + 8 * marks
    lanes = -(-counts // STRIDE)
    runs = np.full(marks, STRIDE, np.int64)
    last = np.cumsum(lanes)[counts > 0] - 1
    runs[last] = ((counts - 1) % STRIDE + 1)[counts > 0]
    return doc_ids, counts, codes.decode(data[at:at + size], begin, runs)


_codes: dict[bytes, Codes] = {}


def _codes_of(limit: int, packed: bytes) -> Codes:
    key = bytes([limit]) + packed
    if key not in _codes:
        _codes.clear()
        _codes[key] = Codes(np.frombuffer(zlib.decompress(packed), np.uint8), limit)
    return _codes[key]


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: summed in each task, then over all; bounded by the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for part in parts(batches):
            lot = [ids_of(data, width) for width, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            own = np.bincount(np.concatenate([np.empty(0, np.uint16), *lot]))
            if len(own) > len(sums):
                sums = np.pad(sums, (0, len(own) - len(sums)))
            sums[:len(own)] += own
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["id", "n"])

    found = tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (found.column(c).to_numpy() for c in ("id", "n"))
    out = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    out[ids] = n
    return out


def write_ids(tokens: DataFrame, folder: str, limit: int = 20, file_bytes: int = 16 << 20) -> DataFrame:
    """Write the ids of ``tokens`` (see ``tokenize``) to files of about ``file_bytes``; the manifest, a row per block.

    Files are ranges of ids. Rows without id come first, in files of their own that they are dealt to in turn, so
    they may be any share of the rows; ``tokens`` must be a stored table for that (a task run again deals the same).
    """
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens), limit)
    start = head(lengths, limit)
    shared = spark.sparkContext.broadcast((limit, start[20:]))  # a byte per id of the vocabulary at most
    total = tokens.agg(F.sum("n").alias("n"), F.count("doc_id").alias("rows"), F.count("*").alias("all")).first()
    files = max(1, -(-(total.n or 0) * 2 // file_bytes))
    nameless = -(-files * (total.all - total.rows) // total.all) if total.all else 0  # files of rows without id; they come first
    bounds = [] if files - nameless < 2 or not total.rows else tokens.agg(F.percentile_approx(
        "doc_id", [i / (files - nameless) for i in range(1, files - nameless)], 100 * files)).first()[0]
    bounds = sorted(set(bounds))
    edges = spark.sparkContext.broadcast(np.array(bounds, np.int64))  # 8 bytes a file

    def buckets(ids: pa.Array, turn: int) -> np.ndarray:
        """The file of each row: by ranges of the id; rows without one go round theirs, from ``turn`` on."""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        at = nameless + np.searchsorted(edges.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
        return np.where(known, at, (turn + np.cumsum(~known)) % max(1, nameless)).astype(np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, turn = _codes_of(*shared.value), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [ids_of(d, w) for d, w in zip(part.column(3).to_pylist(), part.column(2).to_pylist())]
                done = codes.encode(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(buckets(part.column(0), turn)), part.column(0), part.column(1),
                    pa.array([m.astype("<u4").tobytes() for _, m in done], pa.binary()), pa.array([p for p, _ in done], pa.binary())],
                    names=["bucket", "doc_id", "n", "marks", "payload"])
                turn += part.column(0).null_count

    coded = tokens.select(F.col("doc_id").cast("long"), "n", "width", "ids").mapInArrow(
        encode, "bucket int, doc_id long, n int, marks binary, payload binary")
    dealt = coded.repartitionById(nameless + len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "n", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, place, rows, size, out, number = None, "", 0, [], 0, [], 0
        now = None

        def close_block() -> None:
            nonlocal rows, size, place, number
            if rows:
                data = block(rows)
                file.write(data)
                out.append({"bucket": now, "block": number, "path": path, "place": place, "size": len(data), "n_docs": len(rows),
                            "n_ids": sum(r[1] for r in rows)})
                rows, size, place, number = [], 0, place + len(data), number + 1

        for batch in batches:
            for bucket_, doc, n, marks, payload in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket_ != now:
                    if file:
                        close_block()
                        file.close()
                    now, number, path = bucket_, 0, f"{folder}/ids-{bucket_:08d}-{uuid.uuid4().hex[:8]}.tidh"
                    file = opened(path, "wb")
                    file.write(start)
                    place = len(start)
                rows.append((NONE if doc is None else doc, n, marks, payload))
                size += len(payload)
                if size >= BLOCK:
                    close_block()
        if file:
            close_block()
            file.close()
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("bucket", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("place", pa.int64()), ("size", pa.int64()),
            ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return materialize(dealt.mapInArrow(write, "bucket int, block int, path string, place long, size long, n_docs long, n_ids long"), "ids-manifest")


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian, 32 bits) of each document, decoded from the files."""
    per_file = manifest.groupBy("bucket").agg(F.sum("n_ids").alias("all"))
    before = per_file.select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("block")
    blocks = manifest.join(F.broadcast(before), "bucket").select(  # a row per file
        "path", "place", "size", (F.col("base") + F.sum("n_ids").over(inside) - F.col("n_ids")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, place, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                with opened(path, "rb") as file:
                    _, limit, packed = read_head(file)
                    file.seek(place)
                    doc_ids, counts, ids = read_block(file.read(size), _codes_of(limit, packed))
                stops = np.cumsum(counts)
                data = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if d == NONE else d for d in doc_ids.tolist()], pa.int64()), pa.array(start + stops - counts), pa.array(counts),
                    pa.array([data[b - n:b].tobytes() for b, n in zip(stops.tolist(), counts.tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def encode_corpus(docs: DataFrame, tokenizer: str, end: int, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize ``docs``, write the ids under ``folder``; the manifest that ``read_ids`` takes."""
    return write_ids(tokenize(docs, tokenizer, end, doc_id, text), folder)
