"""Alignment against whole texts given to both libraries, with every pair of tokens compared."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from outings.llm import alignment as al
from outings.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KIND = "doc_id long, text string, alignment int"


def invented(seed=1, count=120):
    r = random.Random(seed)
    known = ["word", "Wörter", "l'eau", "don't", "x12", "…", "日本語", "\t", "\n", "", "<|endoftext|>", "<s>", "é", "́", "½", "a_b", "Überraschung,", "▁", "end.\nNext",
             " ", "\x1f", "\x00", "🙂", "''ll", "᠎", "ﬁ", "Σας", "　"]
    texts = [r.choice(["", " ", "\n"]) * r.randint(0, 2) + r.choice([" ", " ", " ", "  ", "\n "]).join(r.choice(known) for _ in range(r.randint(1, 14))) for _ in range(count)]
    texts = [t if i % 4 else t.replace("▁", "") for i, t in enumerate(texts)]
    texts += ["the cat sat on the mat and the dog sat on the cat"] * 40 + [None, "", " ", "same", "same", "x " * 3000]
    return [(i if i % 17 else None, t, i) for i, t in enumerate(texts)]


def brute(texts):
    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    letters = byte_letters()
    names = {i: p for p, i in a_lib.get_vocab().items()}
    out, counts = [], Counter()
    for t in texts:
        want = (" " + (t or "")).encode()
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        a_bytes = [bytes(letters[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            out.append(([], [], [], []))
            continue
        ends_a = [sum(map(len, a_bytes[:i + 1])) for i in range(len(a))]
        ends_b = [sum(map(len, b_bytes[:i + 1])) for i in range(len(b))]
        links = [(x, y) for x, p in zip(a, ends_a) for y, q in zip(b, ends_b) if p == q] if len(a) < 200 else [
            (x, dict(zip(ends_b, b))[p]) for x, p in zip(a, ends_a) if p in set(ends_b)]
        groups, start = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append("%s|%s" % tuple(",".join(str(i) for i, e in zip(ids, ends) if start < e <= end) for ids, ends in ((a, ends_a), (b, ends_b))))
            start = end
        out.append((a, b, groups, links))
        counts.update(links)
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(a), len(b), len(g), len(ln), sum(counts[k] == best[k[1]] for k in ln), sum(counts[k] for k in ln),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, ln in out], counts


@pytest.mark.parametrize("head", [al.HEAD, 3, 0])
def test_against_brute_force(spark, head):
    rows = invented()
    found = al.align(spark.createDataFrame(rows, KIND).repartition(4), A, B, carry=["doc_id", "alignment"], head=head)
    want, counts = brute([t for _, t, _ in rows])
    assert found.documents.columns == ["doc_id", "alignment", "alignment_"]
    got = {r.alignment: (r.doc_id, *r.alignment_) for r in found.documents.collect()}
    assert got == {k: (i, *w) for (i, _, k), w in zip(rows, want)}
    assert {(r.a, r.b): r.n for r in found.pairs.collect()} == dict(counts)


def test_forgotten_chunks_change_nothing():
    small, large = al.Aligner(A, B, most=5), al.Aligner(A, B)
    texts = [t for _, t, _ in invented(2)]
    for i in range(0, len(texts), 7):
        for x, y in zip(small(texts[i:i + 7]), large(texts[i:i + 7])):
            assert x[:4] == y[:4] and all((p == q).all() for p, q in zip(x[4:], y[4:]))


def test_identity_map_names_equal_bytes():
    own = al.Aligner(A, B)
    for a, b in enumerate(own.same.tolist()):
        assert b < 0 or own.a_bytes[a] == own.b_bytes[b]
    assert (own.same >= 0).sum() > 5000


def test_no_rows(spark):
    found = al.align(spark.createDataFrame([], KIND), A, B)
    assert found.documents.count() == 0 and found.pairs.count() == 0
