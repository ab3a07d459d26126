"""Language identification with a small convolutional network over bytes.

A text is read as UTF-8 in fixed-length windows, all of it, the last one filled with spaces. Bytes are
embedded, filters of several widths run over each window, the largest answer of each filter goes to a
softmax over the languages, and a text's probabilities are the mean of its windows', by bytes. The
network is trained here, in numpy, on a bounded sample: ``per_language`` documents of each language,
chosen by a hash of their id, and ``per_document`` windows spread over the whole of each. The sample is
all that reaches the driver. In tasks embedding and filters are folded into tables of byte pairs, so a
filter's answer is one or two look-ups; windows are answered in lots of fixed size.

Cases: null text, or text without a letter, is ``und`` with score 0. Where nothing could be learned, all
texts are. Documents without label, id or letters are not learned from. Repeated rows are answered alike;
ties go to the language that sorts first. Other columns are passed on; the result is one more struct
column, last, named ``language`` (underscores are added while that name is taken).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.llm.common import append, free_name, texts

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
#: Case, digits and white space don't tell languages apart.
FOLD = bytes((b | 0x20) if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else 0x20 if b < 0x21 else b for b in range(256))
LOT = 256  # windows answered at once


def has_letter(data: bytes) -> bool:
    """Whether any character is a letter; digits, fractions and powers are none."""
    return any(map(str.isalpha, data.decode(errors="replace")))


def windows_of(data: bytes) -> np.ndarray:
    """A text's windows, one a row."""
    count = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.translate(FOLD).ljust(count * WINDOW), np.uint8).reshape(count, WINDOW)


class ByteCNN:
    """Byte embedding, filters of several widths, max pooling and softmax."""

    def __init__(self, languages: list[str], filters: int = 16, size: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embedding": r.normal(0, 0.5, (256, size)), "out": r.normal(0, 0.1, (len(WIDTHS) * filters, len(languages))),
                  "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"conv{w}"] = r.normal(0, (w * size) ** -0.5, (w, size, filters))
            self.p[f"shift{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.id, self.tables = uuid.uuid4().hex, None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def _gradients(self, codes: np.ndarray, wanted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n = self.p, len(codes)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        pooled, places = [], []
        for w in WIDTHS:
            answer = sum((p["embedding"] @ p[f"conv{w}"][k])[codes[:, k:WINDOW - w + 1 + k]] for k in range(w))
            place = answer.argmax(axis=1)
            pooled.append(np.take_along_axis(answer, place[:, None], 1)[:, 0] + p[f"shift{w}"])
            places.append(place)
        pooled = np.concatenate(pooled, axis=1)
        hidden = np.maximum(pooled, 0)
        chance = softmax(hidden @ p["out"] + p["bias"])
        loss = float(-np.log(chance[np.arange(n), wanted] + 1e-9).mean())
        d = chance
        d[np.arange(n), wanted] -= 1
        d /= n
        g["out"], g["bias"] = hidden.T @ d, d.sum(axis=0)
        dh = (d @ p["out"].T) * (pooled > 0)
        for i, (w, place) in enumerate(zip(WIDTHS, places)):
            own = dh[:, i * place.shape[1]:(i + 1) * place.shape[1]]
            g[f"shift{w}"] = own.sum(axis=0)
            for k in range(w):
                seen = np.take_along_axis(codes, place + k, 1)
                g[f"conv{w}"][k] = np.einsum("nf,nfe->ef", own, p["embedding"][seen])
                np.add.at(g["embedding"], seen, own[:, :, None] * p[f"conv{w}"][k].T[None])
        return loss, g

    def fit(self, codes: np.ndarray, wanted: np.ndarray, steps: int = 600, lot: int = 64, rate: float = 0.01, seed: int = 11) -> float:
        """Adam over random lots in which languages are even; the last loss."""
        r = np.random.default_rng(seed)
        rows = [np.flatnonzero(wanted == k) for k in range(len(self.languages))]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            kinds = r.integers(0, len(rows), lot)
            at = np.array([r.choice(rows[k]) for k in kinds])
            loss, g = self._gradients(codes[at], wanted[at])
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                self.p[k] -= (rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step))
                              / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss

    def _fold(self) -> dict[str, np.ndarray]:
        """Per width: a table of the first two bytes, and of the third, or of the third and fourth."""
        if self.tables is None:
            part = {(w, k): self.p["embedding"] @ self.p[f"conv{w}"][k] for w in WIDTHS for k in range(w)}
            pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, -1), np.float32)
            self.tables = {(w, k): pair(part[w, k], part[w, k + 1]) if k + 1 < w else part[w, k] for w in WIDTHS for k in range(0, w, 2)}
        return self.tables

    def chances(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for windows (rows of bytes)."""
        tables, out = self._fold(), []
        for at in range(0, len(codes), LOT):
            c = codes[at:at + LOT].astype(np.int32)
            pairs = c[:, :-1] * 256 + c[:, 1:]
            pooled = []
            for w in WIDTHS:
                size = WINDOW - w + 1
                answer = np.take(tables[w, 0], pairs[:, :size], axis=0)
                for k in range(2, w, 2):
                    answer += np.take(tables[w, k], (pairs if k + 1 < w else c)[:, k:k + size], axis=0)
                pooled.append(answer.max(axis=1) + self.p[f"shift{w}"])
            out.append(softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["out"] + self.p["bias"]))
        return np.concatenate(out)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = 400, per_document: int = 8, steps: int = 600) -> ByteCNN | None:
    """A network that knows the labels of the ``usable`` documents; None where there are none.

    ``per_language`` and ``per_document`` bound what is learned from: at most so many documents of each
    label and windows of each document.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), usable.alias("ok")).where(
        "ok and lang is not null and id is not null and text is not null")
    # the chosen ids first, so that no text is sorted: those of the lowest hashes. About twice as many as are wanted lie
    # below a bound that follows from the label's count; of these few the exact ones are cut
    hashed = rows.select("lang", F.struct(F.xxhash64("id").alias("h"), "id").alias("i"))
    counts = hashed.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n"))
    low = hashed.join(F.broadcast(counts), "lang").where(F.col("i.h") <= F.lit(-2.0 ** 63) + share * F.lit(2.0 ** 64))  # a row per label
    first = F.slice(F.sort_array(F.collect_list("i")), 1, per_language)
    chosen = low.groupBy("lang").agg(first.alias("i")).select("lang", F.explode("i.id").alias("id"))
    # at most per_language rows a label: small whatever the corpus holds
    sample = rows.join(F.broadcast(chosen.select(F.col("lang").alias("l"), F.col("id").alias("i")).distinct()), F.expr("id = i and lang = l"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, name in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                if has_letter(data):
                    own = windows_of(data)
                    for at in np.unique(np.linspace(0, len(own) - 1, per_document).astype(int)):
                        out.append({"lang": name, "codes": own[at].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("codes", pa.binary())]))

    found = sample.select("text", "lang").mapInArrow(windows, "lang string, codes binary").toArrow()
    pairs = sorted(zip(found.column("lang").to_pylist(), found.column("codes").to_pylist()))
    if not pairs:
        return None
    languages = sorted({name for name, _ in pairs})
    place = {name: i for i, name in enumerate(languages)}
    model = ByteCNN(languages)
    codes = np.frombuffer(b"".join(c for _, c in pairs), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    model.fit(codes, np.array([place[name] for name, _ in pairs]), steps)
    return model


_models: dict[str, ByteCNN] = {}


def identify(docs: DataFrame, model: ByteCNN | None, text: str = "text") -> DataFrame:
    """``docs`` with ``language`` (lang, score): the likeliest language of the whole text and its probability."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model and model.id
    at = docs.columns.index(text)

    def rows(batch: pa.RecordBatch) -> list[dict]:
        if key not in _models:
            _models.clear()
            _models[key] = shared.value
        net = _models[key]
        out = [{"lang": UNKNOWN, "score": 0.0} for _ in range(batch.num_rows)]
        held: list[tuple[int, np.ndarray, int]] = []
        size = 0

        def answer() -> None:
            chance = net.chances(np.concatenate([w for _, w, _ in held]))
            start = 0
            for row, w, length in held:
                weight = np.full(len(w), WINDOW, np.float64)
                weight[-1] = length - (len(w) - 1) * WINDOW
                mean = weight @ chance[start:start + len(w)] / weight.sum()
                start += len(w)
                out[row] = {"lang": net.languages[int(mean.argmax())], "score": min(1.0, float(mean.max()))}
            held.clear()

        for row, data in enumerate(texts(batch.column(at))):
            if net is None or not data or not has_letter(data):
                continue
            held.append((row, windows_of(data), len(data)))
            size += len(held[-1][1])
            if size >= 4 * LOT:
                answer()
                size = 0
        if held:
            answer()
        return out

    return append(docs, free_name(docs, "language"), "lang string, score double", rows)
