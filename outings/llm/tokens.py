"""Token ids of many texts with a public tokenizer.

The tokenizers split a text into pieces before they merge anything, and merge each piece by itself.
So a piece's ids are asked of the library once, many at a time, and kept for the first ``most`` pieces, and a text's ids are
put together from those. It holds where this module's patterns split as the library does: texts of
the characters in ``PLAIN`` and without the marks of special tokens. All other texts go to the library
whole. ``tests/llm`` compares both ways.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that both sides certainly class alike: ASCII, Latin letters, common punctuation.
LETTER = "A-Za-zÀ-ÖØ-öø-įı-ſ"
SPACE = "\t-\r "
PLAIN = re.compile(f"[\t-\r -~¡«»¿À-ÖØ-öø-įı-ſ‐-‧€]*")
#: The splitting patterns of the two kinds of tokenizer, over those characters; fixed by their files.
SPLIT = {
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^{SPACE}{LETTER}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{SPACE}{LETTER}0-9]+"),
}
#: A word as the pattern of bytes has it, in the language of Arrow's expressions, and signs that are a piece of their own after it.
WORD = f"^ ?[{LETTER}]+$"
ENDS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
LOT = {"byte": 1 << 22, "word": 1 << 21}  # characters put together at once
#: What ends a word's letters, as the pattern of words has it, in the language of Arrow's expressions.
SIGNS = f"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^{SPACE}{LETTER}0-9]+)"
ROWS = 2000  # texts, at most
CUT = re.compile(r"(?<=\S) (?=\S)")
LOOSE = f"^ | $|[{SPACE}] | [{SPACE}]"  # where a space is no such cut
JOINED = {True: 256, False: 16}  # chunks in one text, where the ids alone tell them apart and where offsets are asked for
MARK = " "  # between pieces that stand in one text; byte-level letters have none


def chunks_of(text: str) -> list[str]:
    """The parts between single spaces that stand between other characters than white space."""
    parts = text.split(" ")
    return parts if "" not in parts and list(map(str.strip, parts)) == parts else CUT.split(text)


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """``array`` with room for ``size`` rows, doubled as often as needed."""
    if len(array) >= size:
        return array
    more = np.zeros((max(size, 2 * len(array)), *array.shape[1:]), array.dtype)
    more[:len(array)] = array
    return more


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The places from first to last (excluded) of each pair, one after the other."""
    sizes = last - first
    stops = np.cumsum(sizes)
    return np.repeat(first - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)


def strings(data: pa.Buffer, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The texts from first to last (excluded) of each pair in ``data``."""
    stops = np.concatenate([[0], np.cumsum(last - first)])
    return pa.Array.from_buffers(pa.large_string(), len(first), [
        None, pa.py_buffer(stops), pa.py_buffer(np.frombuffer(data or b"", np.uint8)[ranges(first, last)])])


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def bytes_of_ids(library) -> list[bytes]:
    """What each id of a byte-level vocabulary stands for."""
    letters, vocabulary = byte_letters(), library.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        if all(c in letters for c in piece):
            out[i] = bytes(letters[c] for c in piece)
    return out


def byte_level(library) -> bool:
    """Whether every id stands for bytes of the text as it is."""
    return type(library.pre_tokenizer).__name__ == "ByteLevel" and library.normalizer is None


def closing_ids(library) -> np.ndarray | None:
    """Of each id whether it ends a word, for a vocabulary that marks the ends of words."""
    mark = getattr(library.model, "end_of_word_suffix", None)
    if not mark:
        return None
    vocabulary = library.get_vocab(with_added_tokens=False)
    out = np.zeros(library.get_vocab_size(), bool)
    out[[i for piece, i in vocabulary.items() if piece.endswith(mark)]] = True
    return out


def plain_words(path: str):
    """The tokenizer of a file for words in small letters that are split already: without the steps that leave those as they are."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    library = Tokenizer.from_file(path)
    library.normalizer = normalizers.Sequence([])
    library.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return library


def plain_pieces(path: str):
    """The tokenizer of a file of a byte-level vocabulary for pieces that are split and in byte-level letters already, with ``MARK`` between them."""
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_file(path)
    library.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(MARK)
    return library


def ids_of_pieces(library, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each of ``pieces`` by a library of ``plain_pieces``, end to end, and how many each has; ``sizes``: bytes per id.

    Pieces are not empty and have no zero byte, which stands between them until all are in byte-level letters.
    """
    step = JOINED[True]
    letters = np.zeros(256, "<u2")
    for letter, byte in byte_letters().items():
        letters[byte] = ord(letter)
    letters[0] = ord(MARK)
    data = np.frombuffer("\0".join(pieces).encode(), np.uint8)
    stops = np.append(np.flatnonzero(data == 0), len(data))[:len(pieces)]
    text = letters[data].tobytes().decode("utf-16-le")
    last = stops[step - 1::step].tolist()  # of the texts of ``step`` pieces
    if len(stops) % step:
        last.append(int(stops[-1]))
    texts = [text[a:b] for a, b in zip([0, *[b + 1 for b in last]], last)]
    ids = [np.empty(0, np.int64)]
    for at in range(0, len(texts), 8):
        ids += [np.array(e.ids, np.int64) for e in library.encode_batch_fast(texts[at:at + 8], add_special_tokens=False)]
    found = np.concatenate(ids)
    return found, np.diff(np.searchsorted(np.cumsum(sizes[found]), stops - np.arange(len(stops)), "right"), prepend=0)


def ids_of_chunks(library, chunks: list[str], sizes: np.ndarray | None, closing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each of ``chunks`` after a space, end to end, and how many each has.

    ``sizes``: bytes per id, where ids have them; ``closing``: which ids end a word, where each chunk is a word of the
    vocabulary's own splitting. With neither the library is asked for offsets.
    """
    step = JOINED[sizes is not None or closing is not None]
    texts = [" " + " ".join(chunks[at:at + step]) for at in range(0, len(chunks), step)]
    encode = library.encode_batch if sizes is None and closing is None else library.encode_batch_fast
    ids, counts = [], []
    for at in range(0, len(texts), 8):
        for k, found in enumerate(encode(texts[at:at + 8], add_special_tokens=False)):
            own = np.array(found.ids, np.int64)
            parts = chunks[(at + k) * step:(at + k + 1) * step]
            if sizes is not None:
                stops, ends = np.cumsum([len(p.encode()) + 1 for p in parts]), np.cumsum(sizes[own])
                n = np.diff(np.searchsorted(ends, stops, "right"), prepend=0)
            elif closing is not None and np.count_nonzero(closing[own]) == len(parts):
                n = np.diff(np.flatnonzero(closing[own]), prepend=-1)
            else:
                if closing is not None:  # an id of no known end
                    found = library.encode(texts[at + k], add_special_tokens=False)
                begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
                place = np.searchsorted(begins, [a for a, _ in found.offsets], "right") - 1
                n = np.bincount(place, minlength=len(parts)) if len(own) else np.zeros(len(parts), np.int64)
            ids.append(own)
            counts.append(n)
    return np.concatenate([np.empty(0, np.int64), *ids]), np.concatenate([np.empty(0, np.int64), *counts])


class Encoder:
    """A tokenizer file with the ids of the pieces seen so far."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = type(self.library.pre_tokenizer).__name__
        self.split = SPLIT["byte" if kind == "ByteLevel" else "word"] if self._known() else None
        self.lower = self.library.normalizer is not None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bytes = np.array([len(b) for b in bytes_of_ids(self.library)], np.int64) if byte_level(self.library) else None
        self.closing = closing_ids(self.library)
        self.words = self.library
        if self.bytes is not None:
            self.pieces = plain_pieces(path)
        elif self.split is not None:
            probe = ["it", "'s", "1", "x", "!?", "quote", "ça", "œuvre", "«", "zzyzxq"]
            words = plain_words(path)
            if [e.ids for e in words.encode_batch_fast(probe, add_special_tokens=False)] == [e.ids for e in self.library.encode_batch_fast(probe, add_special_tokens=False)]:
                self.words = words
        self.lot = LOT["word" if self.bytes is None else "byte"]
        self.most = most
        self.place = {"": 0}
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ends = 0  # of the ids

    def _known(self) -> bool:
        """Whether the file splits by one of the two patterns."""
        probe = "It's  A 12\n\nx!? 'quote"
        want = self.library.encode(probe, add_special_tokens=False).ids
        for pattern in SPLIT.values():
            parts = pattern.findall(probe.lower() if self.library.normalizer else probe)
            if [i for p in parts for i in self.library.encode(p, add_special_tokens=False).ids] == want:
                return True
        return False

    def _learn(self, pieces: list[str]) -> None:
        """Ask the library for the ids of ``pieces``, of many in one text."""
        if self.bytes is None:  # no piece holds a space
            ids, counts = ids_of_chunks(self.words, pieces, None, self.closing)
        else:
            ids, counts = ids_of_pieces(self.pieces, pieces, self.bytes)
        start, stop, ends = len(self.place), len(self.place) + len(pieces), self.ends + len(ids)
        self.ids, self.starts, self.sizes = grown(self.ids, ends), grown(self.starts, stop), grown(self.sizes, stop)
        self.ids[self.ends:ends], self.sizes[start:stop], self.starts[start:stop] = ids, counts, self.ends + np.cumsum(counts) - counts
        self.place.update(zip(pieces, range(start, stop)))
        self.ends = ends

    def _together(self, lot: list[str]) -> list[np.ndarray]:
        """The ids of texts; each distinct part between single spaces is worked out once."""
        if self.lower:
            lot = [t.lower() for t in lot]
        column = pa.array(lot, pa.large_string())
        if self.bytes is None:  # no piece holds a space
            parts = pc.split_pattern(column, " ")
            flat, count = parts.flatten(), np.diff(parts.offsets.to_numpy())
        else:
            loose = pc.match_substring_regex(column, LOOSE)
            parts = pc.split_pattern(pc.if_else(loose, "", column), " ")
            flat, count = parts.flatten(), np.diff(parts.offsets.to_numpy())
            odd = np.flatnonzero(loose.to_numpy(zero_copy_only=False))
            if len(odd):
                cut = [CUT.split(lot[i]) for i in odd.tolist()]
                row, more = np.repeat(np.arange(len(lot)), count), np.repeat(odd, list(map(len, cut)))
                stays = ~loose.to_numpy(zero_copy_only=False)[row]
                flat = pa.concat_arrays([flat.filter(pa.array(stays)), pa.array(chain.from_iterable(cut), pa.large_string())])
                row = np.concatenate([row[stays], more])
                flat, count = flat.take(pa.array(np.argsort(row, kind="stable"))), np.bincount(row, minlength=len(lot))
        coded = flat.dictionary_encode()
        at, texts = coded.indices.to_numpy(), coded.dictionary
        del column, parts, flat
        stops = np.cumsum(count)
        if self.bytes is not None:  # a part has the space before it, but for the first of a text
            first, at = stops - count, at.copy()
            heads = texts.take(pa.array(at[first]))
            at[first] = len(texts) + np.arange(len(heads))
            space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
            texts = pa.concat_arrays([pc.binary_join_element_wise(space, texts, nothing), heads])
        texts = texts.to_numpy(zero_copy_only=False).tolist()
        each = self._ids_of(texts).take(pa.array(at))
        ids, edges = np.frombuffer(each.buffers()[2] or b"", np.uint32), np.frombuffer(each.buffers()[1], np.int64)[np.concatenate([[0], stops])] >> 2
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def _ids_of(self, texts: list[str]) -> pa.Array:
        """The ids of each of ``texts`` as bytes; a text may be of several pieces."""
        known, held = self.place, self.ends
        if self.bytes is None:
            at = np.fromiter(map(known.get, texts, repeat(-1)), np.int64, len(texts))
        else:  # words come with many signs after them: they are looked up without
            at = np.full(len(texts), -1)
        missing = np.flatnonzero(at < 0)
        pieces, order, count = self._pieces_of([texts[i] for i in missing.tolist()] if len(missing) < len(texts) else texts)
        per = np.ones(len(texts), np.int64)
        per[missing] = count
        place = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(place < 0)
        new = [pieces[i] for i in unknown.tolist()]
        if new:
            place[unknown] = len(known) + np.arange(len(new))
            self._learn(new)
        all_ = np.repeat(at, per)
        all_[np.repeat(at < 0, per)] = place[order]
        sizes = self.sizes[all_]
        flat = self.ids[ranges(self.starts[all_], self.starts[all_] + sizes)]
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per)])] << 2
        if len(known) > self.most:  # full: what this lot brought goes again
            for p in new:
                del known[p]
            self.ends = held
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(edges), pa.py_buffer(flat)])

    def _pieces_of(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pieces of ``texts``, which of them come one after the other, and how many a text has."""
        if self.bytes is None:
            parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pa.array(texts, pa.large_string()), SIGNS, r" \1 "))
            coded = parts.flatten().dictionary_encode()
            return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.diff(parts.offsets.to_numpy())
        column = pa.array(texts, pa.large_string())
        words = pc.utf8_rtrim(column, characters=ENDS)
        plain = pc.match_substring_regex(words, WORD).to_numpy(zero_copy_only=False)
        last = np.frombuffer(column.buffers()[1], np.int64)[1:len(texts) + 1]
        signs = strings(column.buffers()[2], (last - (pc.binary_length(column).to_numpy() - pc.binary_length(words).to_numpy()))[plain], last[plain])
        other = np.flatnonzero(~plain)
        split = [self.split.findall(texts[i]) for i in other.tolist()]
        some = pc.binary_length(signs).to_numpy() > 0  # words with signs after them
        coded = pa.concat_arrays([
            words.filter(pa.array(plain)), signs.filter(pa.array(some)), pa.array(chain.from_iterable(split), pa.large_string())]).dictionary_encode()
        count = np.empty(len(texts), np.int64)
        count[plain], count[other] = 1 + some, np.fromiter(map(len, split), np.int64, len(split))
        begin = np.cumsum(count) - count
        order = np.empty(int(count.sum()), np.int64)
        order[np.concatenate([begin[plain], begin[plain][some] + 1, ranges(begin[other], begin[other] + count[other])])] = coded.indices.to_numpy()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), order, count

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        lot: list[int] = []
        size = 0

        def flush() -> None:
            for i, ids in zip(lot, self._together([texts[i] for i in lot])):
                out[i] = ids

        for i, t in enumerate(texts):
            if self.split is None or not PLAIN.fullmatch(t) or any(s in t for s in self.special):
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            lot.append(i)
            size += len(t)
            if size >= self.lot:
                flush()
                lot, size = [], 0
        flush()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one in a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop the encoders of this worker and what they keep."""
    _encoders.clear()


def tokenize(docs, path: str, end: int | None, doc_id: str = "doc_id", text: str = "text", leaf=None):
    """doc_id, n, ids of each document, stored: the texts' ids and ``end``, as little-endian numbers of 16 bits (32 where the vocabulary needs it).

    Null text is empty. The ids are written to the shared folder once and read from there. ``leaf`` gives a number for
    the ids of each of a list of documents, stored beside them as the column leaf; each row then has a number of its own, the column row.
    """
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    from outings.llm.common import release
    from outings.session import scratch_dir

    def run(batches):
        own = encoder(path)
        kind = np.dtype("<u2" if own.library.get_vocab_size() <= 1 << 16 else "<u4")
        tail = np.array([] if end is None else [end], kind)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [np.concatenate([i.astype(kind), tail]) for i in own([t or "" for t in part.column(1).to_pylist()])]
                columns = {
                    "doc_id": part.column(0), "n": pa.array([len(i) for i in ids], pa.int32()),
                    "width": pa.array([kind.itemsize] * len(ids), pa.int8()), "ids": pa.array([i.tobytes() for i in ids], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns if leaf is None else columns | {
                    "leaf": pa.array(leaf(ids), pa.int64()), "row": pa.array(range(number, number + len(ids)), pa.int64())})
                number += len(ids)
        release()

    spark = docs.sparkSession
    stored = scratch_dir(spark, "tokens")
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n int, width byte, ids binary" + ("" if leaf is None else ", leaf long, row long"))
    out.write.option("compression", "zstd").parquet(stored)
    return spark.read.schema(out.schema).parquet(stored)


def ids_of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4")
