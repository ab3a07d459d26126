"""Alignment of two tokenizers' ids over a corpus.

A byte-level tokenizer A reads a space and the text, a piece tokenizer B the text, to which it adds that space. Byte
offsets where tokens of both end cut a text into groups. A token pair is linked where both end together, so each
group links its last A token with its last B token. How often a pair is linked in the corpus is its count.

Fast path: an array gives for each A id the B id of the same bytes (``-1``: none). A group of one A token and the B
token that the array names is told by the A id alone, and is counted in a vector of A's vocabulary; all other groups
are irregular. Only they give pairs (a, b), which are summed in each task and then per pair, in a shuffle.

Texts are cut at single spaces between other characters. No token of either reaches over such a space (checked on
the files: a B piece holds its spaces at its start, A splits before a space that a word follows), so a chunk has the
same tokens wherever it stands, and its groups and links are worked out once a worker; of more than ``MOST`` chunks
the half that came most often is kept.

Per document come counts, the groups' digest, and sums over its links. Those of regular groups are looked up in
vectors as long as a vocabulary. Those of irregular pairs are looked up in the ``head`` pairs linked most often, which
are sent to all tasks (16 bytes each, at most ``head`` of them); the others are joined, and as any pair of more than
1 / head of all links is among the former, no key of that join is large.

Cases: texts that are null or empty, or whose joined A or B bytes differ from a space and the text, have no tokens:
zeros, and '' as digest. Marks of special tokens inside texts are plain text. Equal rows and rows without id count
each for itself. Columns named in ``carry`` are passed on; one struct column more, last, ``alignment`` (underscores
are added while that name is taken). No rows give none, and no pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.common import free_name, materialize
from outings.llm.tokens import byte_level, bytes_of_ids, chunks_of, grown, ids_of_chunks, ranges

MOST = 300_000
HEAD = 1 << 17


class Aligner:
    """Two tokenizer files, and the chunks seen so far."""

    def __init__(self, a_path: str, b_path: str, most: int = MOST):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        if not byte_level(self.a):
            raise ValueError("A is no byte-level tokenizer")
        self.a_bytes = bytes_of_ids(self.a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space after another character; texts of this model can't be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.same = identity_map(self.a_bytes, self.b_bytes, [self.b.is_byte(i) for i in range(len(pieces))])
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        longest = max(len(self.a_bytes), len(self.b_bytes))
        self.words = {mark: np.array([f"{i}{mark}" for i in range(longest)], object) for mark in ",|;"}
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        # per chunk: A tokens, B tokens, groups, whether the bytes are the text's; where its links start, the irregular ones start, and all end
        self.numbers, self.spans, self.hits = np.zeros((0, 4), np.int64), np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.uint64)  # of a chunk: a ids of regular links, then pairs of irregular ones
        self.size = self.ends = 0

    def _trim(self) -> None:
        """Keep the half of the chunks that came most often since the last time."""
        keep = np.sort(np.argsort(-self.hits[:self.size], kind="stable")[:self.most // 2])
        spans = self.spans[keep]
        codes, sizes = self.codes[ranges(spans[:, 0], spans[:, 2])], spans[:, 2] - spans[:, 0]
        starts = np.cumsum(sizes) - sizes
        names, groups, numbers = list(self.place), self.groups, self.numbers[keep]
        self._forget()
        self.place = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.groups = [groups[k] for k in keep.tolist()]
        self.numbers, self.spans, self.hits = numbers, spans + (starts - spans[:, 0])[:, None], np.zeros(len(keep), np.int64)
        self.codes, self.size, self.ends = codes, len(keep), len(codes)

    def _learn(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 512):
            lot = parts[at:at + 512]
            ids, counts = ids_of_chunks(self.a, lot, self.a_sizes)
            ids, edges = ids.tolist(), np.cumsum(counts).tolist()
            a = [ids[i:j] for i, j in zip([0, *edges], edges)]
            b = self.b.encode(lot, num_threads=1)
            want = [b" " + p.encode() for p in lot]
            good = [i for i in range(len(lot)) if self._joined(self.a_bytes, a[i]) == want[i] == self._joined(self.b_bytes, b[i])]
            numbers, sizes, codes, text = self._links([a[i] for i in good], [b[i] for i in good])
            for i, own in zip(good, text):
                self.place[lot[i]] = len(self.groups)
                self.groups.append(own)
            for p in set(lot).difference([lot[i] for i in good]):  # other bytes: no tokens, no links
                self.place[p] = len(self.groups)
                self.groups.append("")
            start, stop, ends = self.size, self.size + len(lot), self.ends + len(codes)
            self.numbers, self.spans, self.hits, self.codes = (grown(x, n) for x, n in (
                (self.numbers, stop), (self.spans, stop), (self.hits, stop), (self.codes, ends)))
            middle = start + len(good)
            self.numbers[start:middle], self.numbers[middle:stop], self.hits[start:stop] = numbers, 0, 0
            last = self.ends + np.cumsum(sizes.sum(axis=1))
            first = last - sizes.sum(axis=1)
            self.spans[start:middle] = np.stack([first, first + sizes[:, 0], last], axis=1)
            self.spans[middle:stop] = ends
            self.codes[self.ends:ends] = codes
            self.size, self.ends = stop, ends

    @staticmethod
    def _joined(table: list[bytes], ids: list[int]) -> bytes:
        return b"".join([table[i] for i in ids])

    def _links(self, a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of chunks whose A and B tokens have the same bytes, laid end to end: counts, the numbers of regular and
        irregular links, the links' codes (a chunk's regular ones first), and the groups as text, each with ';' after it."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        if not len(a):
            return np.zeros((0, 4), np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.uint64), []
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.a_sizes[flat_a]), np.cumsum(self.b_sizes[flat_b])
        place = np.searchsorted(ends_b, ends_a)
        common = ends_b[place] == ends_a
        last_a = np.flatnonzero(common)  # a group's last A and B token
        last_b = place[last_a]
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        x, y = flat_a[last_a], flat_b[last_b]
        regular = (size_a == 1) & (size_b == 1) & (self.same[x] == y)
        chunk = np.repeat(np.arange(len(a)), n_a)[last_a]
        codes = np.where(regular, x, x << 32 | y)[np.lexsort((~regular, chunk))].astype(np.uint64)
        sizes = np.stack([np.bincount(chunk[regular == r], minlength=len(a)) for r in (True, False)], axis=1)
        # the words of the text: a group's A tokens, then its B tokens
        words = np.empty(len(flat_a) + len(flat_b), object)
        words[np.arange(len(flat_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = np.where(common, self.words["|"][flat_a], self.words[","][flat_a])
        closes = np.zeros(len(flat_b), bool)
        closes[last_b] = True
        words[np.arange(len(flat_b)) + np.repeat(np.cumsum(size_a), size_b)] = np.where(closes, self.words[";"][flat_b], self.words[","][flat_b])
        words, edges = words.tolist(), np.cumsum(n_a + n_b).tolist()
        text = ["".join(words[i:j]) for i, j in zip([0, *edges], edges)]
        return np.stack([n_a, n_b, sizes.sum(axis=1), np.ones(len(a), np.int64)], axis=1), sizes, codes, text

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """Per text: A tokens, B tokens, groups, digest, regular a ids and their counts, irregular pairs and theirs."""
        if self.size > self.most:
            self._trim()
        split = [chunks_of(t) if t else [] for t in texts]
        flat, known = list(chain.from_iterable(split)), self.place
        at = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([flat[i] for i in missing])))
            at[missing] = [known[flat[i]] for i in missing]
        self.hits[:self.size] += np.bincount(at, minlength=self.size)
        out, stops = [], np.cumsum([len(s) for s in split])
        for begin, stop in zip([0, *stops], stops):
            own = at[begin:stop]
            sums = self.numbers[own]
            if not len(own) or not sums[:, 3].all():
                out.append((0, 0, 0, "", *[np.empty(0, np.uint64)] * 4))
                continue
            digest = hashlib.sha256("".join(map(self.groups.__getitem__, own.tolist()))[:-1].encode()).hexdigest()
            first, middle, last = self.spans[own].T
            regular, pairs = (np.unique(self.codes[ranges(x, y)], return_counts=True) for x, y in ((first, middle), (middle, last)))
            out.append((*sums[:, :3].sum(axis=0).tolist(), digest, *regular, *pairs))
        return out


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes], b_is_byte: list[bool]) -> np.ndarray:
    """For each A id the B id of the same bytes, a piece rather than a byte, then the smallest; -1 where there is none."""
    by_bytes: dict[bytes, int] = {}
    for i in sorted(range(len(b_bytes)), key=lambda i: (b_is_byte[i], i), reverse=True):
        by_bytes[b_bytes[i]] = i
    return np.array([by_bytes.get(x, -1) if x else -1 for x in a_bytes], np.int64)


_aligners: dict[tuple, Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One in a worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


@dataclass
class Alignment:
    """A row per document, and the linked pairs of the corpus: a, b, n."""

    documents: DataFrame
    pairs: DataFrame


FOUND = "row long, n_a long, n_b long, n_groups long, digest string, regular binary, regular_n binary, pairs binary, pairs_n binary"


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", carry: list[str] | None = None, head: int = HEAD) -> Alignment:
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    name = free_name(docs.select(*carry), "alignment")
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)], *T.StructType.fromDDL(FOUND).fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = own(part.column(len(carry) + 1).to_pylist())
                columns = [*part.columns[:len(carry) + 1], *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[3] for r in rows], pa.string()),
                           *[pa.array([r[k].astype(t).tobytes() for r in rows], pa.binary()) for k, t in ((4, "<u4"), (5, "<u4"), (6, "<u8"), (7, "<u4"))]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    found = materialize(source.mapInArrow(encode, schema), "alignment")
    own = aligner(a_path, b_path)
    same = own.same
    counts, pairs = corpus_counts(found, len(same))
    regular = np.where(same >= 0, counts, 0)
    best = np.zeros(len(own.b_bytes), np.int64)  # the highest count of a pair with a B id
    np.maximum.at(best, same[same >= 0], regular[same >= 0])
    for row in pairs.groupBy("b").agg(F.max("n").alias("n")).collect():  # a row per id of B's vocabulary at most
        best[row.b] = max(best[row.b], row.n)
    documents = sums(found, pairs, same, regular, best, head)
    spark = docs.sparkSession
    at = np.flatnonzero(regular)
    exact = spark.createDataFrame(list(zip(at.tolist(), same[at].tolist(), regular[at].tolist())), "a int, b int, n long")  # a row per id of A's vocabulary at most
    told = F.struct("n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
    return Alignment(documents.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], told.alias(name)),
                     exact.unionByName(pairs.select("a", "b", "n")))


def corpus_counts(found: DataFrame, size: int) -> tuple[np.ndarray, DataFrame]:
    """How often each A id is in a regular link (a vector of the vocabulary), and a, b, n of irregular pairs; stored."""
    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids, n in zip(*[c.to_pylist() for c in batch.columns]):
                total[np.frombuffer(ids, "<u4")] += np.frombuffer(n, "<u4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["a", "n"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, place = np.unique(np.concatenate([codes, np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")]), return_inverse=True)
            held = np.concatenate([counts, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4")])
            counts = np.bincount(place, held, len(codes)).astype(np.int64)
            if len(codes) > 1 << 20:
                yield rows(codes, counts)
                codes, counts = codes[:0], counts[:0]
        yield rows(codes, counts)

    def rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((codes >> np.uint64(32)).astype(np.int32)), pa.array((codes & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(counts)],
                                          names=["a", "b", "n"])

    summed = found.select("regular", "regular_n").mapInArrow(vector, "a int, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[summed.column("a").to_numpy()] = summed.column("n").to_numpy()
    pairs = found.select("pairs", "pairs_n").mapInArrow(several, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts, materialize(pairs, "alignment-pairs")


def sums(found: DataFrame, pairs: DataFrame, same: np.ndarray, regular: np.ndarray, best: np.ndarray, head: int) -> DataFrame:
    """``found`` with n_best and count_sum."""
    spark = found.sparkSession
    common = pairs.orderBy(F.col("n").desc(), "a", "b").limit(head).toArrow()
    a, b, n = (common.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    order = np.argsort(a << 32 | b)
    codes, n, b = (a << 32 | b)[order].astype(np.uint64), n[order], b[order]
    top = np.zeros(len(same), bool)
    top[same >= 0] = regular[same >= 0] == best[same[same >= 0]]
    shared = spark.sparkContext.broadcast((codes, n, n == best[b], regular, top))
    kept = [c for c in found.columns if c.startswith("c") or c in ("row", "n_a", "n_b", "n_groups", "digest")]
    schema = T.StructType([*[found.schema[c] for c in kept], *T.StructType.fromDDL("n_best long, count_sum long, rare array<struct<a int, b int, k long>>").fields])
    rare_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("k", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, hit, regular, top = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, times, pairs_, often = (part.column(len(kept) + k).to_pylist() for k in range(4))
                n_best, total, rare = [], [], []
                for i, k, p, m in zip(ids, times, pairs_, often):
                    i, k, p, m = np.frombuffer(i, "<u4"), np.frombuffer(k, "<u4").astype(np.int64), np.frombuffer(p, "<u8"), np.frombuffer(m, "<u4").astype(np.int64)
                    place = np.searchsorted(codes, p)
                    near = np.minimum(place, max(0, len(codes) - 1))
                    known = codes[near] == p if len(codes) else np.zeros(len(p), bool)
                    near, mine = near[known], m[known]
                    n_best.append(int(k[top[i]].sum() + mine[hit[near]].sum()))
                    total.append(int((k * regular[i]).sum() + (mine * n[near]).sum()))
                    rare.append([{"a": int(c) >> 32, "b": int(c) & 0xFFFFFFFF, "k": int(x)} for c, x in zip(p[~known], m[~known])])
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(rare, rare_type)], names=schema.names)

    told = materialize(found.select(*kept, "regular", "regular_n", "pairs", "pairs_n").mapInArrow(run, schema), "alignment-sums")
    highest = spark.sparkContext.broadcast(best)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = batch.column(2).to_numpy() == highest.value[batch.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top)], names=["a", "b", "n", "top"])

    others = told.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(
        pairs.select("a", "b", "n").mapInArrow(mark, "a int, b int, n long, top boolean"), ["a", "b"])
    late = others.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("k")).otherwise(0)).alias("__best"), F.sum(F.col("k") * F.col("n")).alias("__sum"))
    return told.drop("rare").join(late, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))})
