import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from outings.llm.huffman import Codes, block, code_lengths, encode_corpus, id_counts, read_block, read_ids, write_ids
from outings.llm.packing import Index, Packer, document_frequencies, pack, pack_documents
from outings.llm.tokens import Encoder, ids_of, ids_of_pieces, tokenize

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["", " ", "\n\n a\n \nb\t\tc  d ", "It's  A 12\n\nx!?   'quote ", "²³ªµ é́ \xa0 x", "Σας ΟΔΟΣ", "<|endoftext|> a", "don't 'll '' 's!!'s  ",
       "İstanbul ŉ ſ", "“Quote” – it’s €5…", "a\x1cb \x85 c", "日本語 текст 12３", "a" * 3000, "😀😀 x"]


def test_pieces_give_the_ids_of_the_library():
    r = random.Random(1)
    signs = list("abcXYZ éÉüß'’“-–!?.,;:012 \n\t\"sdmtrevl€") + ["<|", "'s", "  ", "\n "]
    texts = ODD + ["".join(r.choice(signs) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    for path in (BYTE, WORD):
        library = Tokenizer.from_file(path)
        for own in (Encoder(path), Encoder(path, most=50)):
            for _ in range(2):
                assert [i.tolist() for i in own(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def frame(spark, seed=2, count=120):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdeéüñ") for _ in range(r.randint(1, 9))) for _ in range(300)]
    rows = [(i * 3 - 50, " ".join(r.choice(known) for _ in range(int(r.paretovariate(0.7)) % 4000))) for i in range(count)]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)] + [(20_000, None), (None, "no id")]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows


def expected(rows, path, end):
    library = Tokenizer.from_file(path)
    return {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for i, t in rows}


def test_files_give_back_every_id(spark, tmp_path):
    docs, rows = frame(spark)
    tokens = tokenize(docs, BYTE, 2)
    from outings.llm.huffman import write_ids

    for size in (1 << 24, 3000):  # one file, and many
        got = read_ids(spark, write_ids(tokens, f"{tmp_path}/{size}", file_bytes=size)).collect()
        want = expected(rows, BYTE, 2)
        assert len(got) == len(rows)
        start = 0
        for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id)):
            assert (r.start, r.n_tokens) == (start, len(want[r.doc_id])) and bytes(r.ids) == want[r.doc_id].tobytes()
            start += r.n_tokens


def test_no_documents_give_no_files(spark, nothing, tmp_path):
    assert read_ids(spark, encode_corpus(nothing, BYTE, 2, str(tmp_path))).count() == 0
    assert pack_documents(nothing, WORD, 1).count() == 0


def test_counts_are_of_all_ids(spark):
    docs, rows = frame(spark)
    got = id_counts(tokenize(docs, BYTE, 2))
    want = np.bincount(np.concatenate(list(expected(rows, BYTE, 2).values())))
    assert got.tolist() == want.tolist()


def optimal(counts, limit):
    """The least total of code lengths under a limit, by trying how many leaves each depth has."""
    from functools import cache

    c = sorted((x for x in counts if x), reverse=True)

    @cache
    def best(i, depth, free):
        if i == len(c):
            return 0
        if depth > limit or not free:
            return float("inf")
        total, least = 0, float("inf")
        for leaves in range(min(free, len(c) - i) + 1):
            if leaves:
                total += c[i + leaves - 1] * depth
            least = min(least, total + best(i + leaves, depth + 1, 2 * (free - leaves)))
        return least

    return best(0, 1, 2)


def test_code_lengths_are_optimal_and_limited():
    r = random.Random(3)
    for limit in (4, 5, 8):
        for _ in range(20):
            counts = np.array([int(r.paretovariate(0.4)) % 10**6 * (r.random() < 0.9) for _ in range(r.randint(2, 14))])
            lengths = code_lengths(counts, limit).astype(int)
            used = lengths[counts > 0]
            assert (lengths[counts == 0] == 0).all() and used.max(initial=0) <= limit and sum(2.0**-used) <= 1
            if len(used) > 1:
                assert int((lengths * counts).sum()) == optimal(counts.tolist(), limit)
    assert code_lengths(np.array([0, 7, 0]), 20).tolist() == [0, 1, 0]


def test_blocks_round_trip():
    r = np.random.default_rng(4)
    for vocabulary, limit in ((1, 20), (2, 20), (300, 9), (50_000, 20)):
        docs = [r.zipf(1.3, n) % vocabulary for n in (0, 1, 127, 128, 129, 5000)]
        codes = Codes(code_lengths(np.bincount(np.concatenate(docs), minlength=vocabulary), limit), limit)
        rows = [(k, len(d), m.astype("<u4").tobytes(), p) for k, (d, (p, m)) in enumerate(zip(docs, codes.encode(docs)))]
        ids, counts, back = read_block(block(rows), codes)
        assert ids.tolist() == list(range(6)) and counts.tolist() == [len(d) for d in docs] and back.tolist() == np.concatenate(docs).tolist()


def test_packing_uses_every_id_once_and_wastes_little(spark):
    docs, rows = frame(spark, 5, 400)
    want = expected(rows, WORD, 1)
    tokens = tokenize(docs, WORD, 1)
    for shard in (2 << 20, 5000):
        pieces = pack(tokens, 256, shard).collect()
        by, sequences = defaultdict(list), defaultdict(list)
        for p in pieces:
            by[p.doc_id].append(p)
            sequences[p.sequence_id].append(p)
        assert by.keys() == want.keys()
        for i, ids in want.items():
            at = 0
            for p in sorted(by[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and bytes(p.ids) == ids[at:at + p.length].tobytes()
                at += p.length
            assert at == len(ids)
        short = 0
        for ps in sequences.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 256
            short += at < 256
        assert short <= tokens.rdd.getNumPartitions()


def test_neighbours_share_their_words(spark):
    """Two kinds of documents with words of their own: windows hold one kind, but where it runs out."""
    r = random.Random(6)
    kinds = [[f"{a}{b}{k}" for a in "bcdfg" for b in "aeiou"] for k in ("x", "z")]
    rows = [(i, " ".join(r.choice(kinds[i % 2]) for _ in range(40))) for i in range(200)]
    pieces = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORD, 1, window=512).collect()
    windows = defaultdict(set)
    for p in pieces:
        windows[p.sequence_id].add(p.doc_id % 2)
    assert sum(len(w) == 2 for w in windows.values()) <= 2


def test_neighbours_stored_far_apart_meet(spark):
    """Eight kinds of documents, dealt over 4 partitions and many more shards than one."""
    r = random.Random(7)
    kinds = [[f"{a}{b}{k}" for a in "bcdfg" for b in "aeiou"] for k in "xzqjvwkh"]
    rows = [(i, " ".join(r.choice(kinds[i % 8]) for _ in range(40))) for i in range(1600)]
    tokens = tokenize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD, 1)
    windows = defaultdict(set)
    for p in pack(tokens, 512, tokens.agg({"n": "sum"}).first()[0] // 16).collect():
        windows[p.sequence_id].add(p.doc_id % 8)
    assert sum(len(w) > 1 for w in windows.values()) < len(windows) / 3


def test_scores_are_of_all_ids():
    r = np.random.default_rng(8)
    docs = [(r.pareto(0.6, r.integers(1, 400)) * 5 % 900).astype(np.uint32) for _ in range(60)]
    frequencies = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=900)
    mean = np.mean([len(d) for d in docs])
    index = Index(docs, frequencies, 60, mean)
    for row in range(60):
        want = []
        for d in docs:
            tf = np.array([np.sum(d == t) for t in np.unique(docs[row])])
            df = frequencies[np.unique(docs[row])]
            want.append(np.sum(np.log1p((60 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))))
        assert np.allclose(index.scores(row), want)


def test_stored_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, None, "y")], "doc_id long, text string, ids string")
    got = sorted((r.n, ids_of(bytes(r.ids), r.width).tolist()) for r in tokenize(docs, WORD, None).collect())
    assert got[0] == (0, []) and got[1][0] == 2
    assert zlib.crc32(b"") == 0


def test_rows_without_id_fill_files_of_their_own(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i, f"text number {i} " * (i % 7)) for i in range(3000)] + [(None, None), (None, "")]
    tokens = tokenize(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, 2)
    manifest = write_ids(tokens, str(tmp_path), file_bytes=4000)
    per_file = manifest.groupBy("path").agg({"n_docs": "sum"}).collect()
    assert len(per_file) > 10 and max(r[1] for r in per_file) < 4 * (len(rows) / len(per_file))
    got = sorted(read_ids(spark, manifest).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == [None] * 1002 + sorted(i for i, _ in rows if i is not None)
    want = sorted((str(r.doc_id), ids_of(bytes(r.ids), r.width).astype("<u4").tobytes()) for r in tokens.collect())
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want


def test_packed_documents_leave_the_index():
    """Scores of those that stay are the same as in the whole index."""
    r = np.random.default_rng(9)
    docs = [(r.pareto(0.6, r.integers(1, 400)) * 5 % 900).astype(np.uint32) for _ in range(80)]
    frequencies = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=900)
    whole, part = (Index(docs, frequencies, 80, 200.0) for _ in range(2))
    rows = np.arange(80)
    while len(rows) > 1:
        stay = np.sort(r.permutation(len(rows))[:len(rows) * 2 // 3])
        part.keep(stay)
        rows = rows[stay]
        for k, row in enumerate(rows):
            assert np.array_equal(part.scores(k), whole.scores(row)[rows])


def greedy(docs, window, frequencies, count, mean):
    """The fill by brute force: (document, start, length, window) of each piece."""
    def score(a, b):
        terms = np.unique(a)
        tf = np.array([np.sum(b == t) for t in terms])
        df = frequencies[terms]
        return np.sum(np.log1p((count - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean)))

    left, at, out, number, room, row = list(range(len(docs))), [0] * len(docs), [], 0, window, None
    seed = None
    while left:
        if row is None:
            row = left[0] if seed is None else max(left, key=lambda d: (round(score(docs[seed], docs[d]), 9), -d))
        seed = row if seed is None else seed
        take = min(room, len(docs[row]) - at[row])
        out.append((row, at[row], take, number))
        at[row], room = at[row] + take, room - take
        if at[row] == len(docs[row]):
            left.remove(row)
        if room == 0:
            number, room, seed, row = number + 1, window, None, row if row in left else None
        else:
            row = None
    return out


def test_the_fill_is_greedy():
    for start in range(6):
        r = np.random.default_rng(start)
        docs = [(r.pareto(0.5, r.integers(1, 150)) * 9 % 700).astype(np.uint32) for _ in range(90)]
        frequencies = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=700)
        mean = float(np.mean([len(d) for d in docs]))
        packer = Packer(128, 0)
        packer.shard(list(enumerate(docs)), frequencies, 90, mean)
        assert [(p["doc_id"], p["start"], p["length"], p["sequence_id"]) for p in packer.rows] == greedy(docs, 128, frequencies, 90, mean)


def replayed(pieces, docs, window, frequencies, mean):
    """Follow the windows in their order: each neighbour is the best open document of the whole corpus for its seed."""
    terms = [np.unique(d, return_counts=True) for d in docs]
    weights = np.zeros((len(docs), len(frequencies)))
    for row, (ids, tf) in enumerate(terms):
        df = frequencies[ids]
        weights[row, ids] = np.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[row]) / mean))
    at, open_, neighbours, short, before = [0] * len(docs), np.ones(len(docs), bool), 0, 0, None
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for number in sorted(windows):
        place, score = 0, None
        for p in sorted(windows[number], key=lambda p: p.offset):
            assert p.offset == place and p.start == at[p.doc_id] and open_[p.doc_id] and p.doc_tokens == len(docs[p.doc_id])
            assert bytes(p.ids) == docs[p.doc_id][p.start:p.start + p.length].astype("<u4").tobytes()
            if score is None:
                score = weights[:, terms[p.doc_id][0]].sum(axis=1)
            else:
                assert score[p.doc_id] >= score[open_].max() - 1e-9
                neighbours += 1
            at[p.doc_id], place = at[p.doc_id] + p.length, place + p.length
            open_[p.doc_id] = at[p.doc_id] < len(docs[p.doc_id])
        assert place <= window
        short += place < window
    assert not open_.any() and short <= 1
    return neighbours


def test_neighbours_are_the_best_of_the_whole_corpus(spark, monkeypatch):
    """Many shards and rounds: a seed sees every document that is open, wherever it is stored, also those that share no word with it."""
    from outings.llm import packing

    monkeypatch.setattr(packing, "FEWEST", 1000, raising=False)
    r = random.Random(21)
    for kinds, shard in ((1, 1500), (12, 700)):
        known = [["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) + str(k) for _ in range(60)] for k in range(kinds)]
        rows = [(i, " ".join(r.choice(known[i % kinds][: r.randint(5, 60)]) for _ in range(int(r.paretovariate(0.8)) % 300 + 1))) for i in range(300)]
        tokens = tokenize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD, None)
        frequencies, count, total = document_frequencies(tokens)
        docs = [ids_of(bytes(t.ids), t.width) for t in sorted(tokens.collect(), key=lambda t: t.doc_id)]
        assert total > 5 * shard
        assert replayed(pack(tokens, 128, shard).collect(), docs, 128, frequencies, total / count) > 100


def test_seeds_whose_answers_are_taken_ask_again(spark, monkeypatch):
    """One answer at first, small batches of all kinds, copies and very long documents: every id lies in one piece, one window is short."""
    from outings.llm import packing

    for name, value in (("FEWEST", 1), ("ANSWERS", 64), ("PLACES", 50), ("SCORES", 2000), ("CELLS", 2000), ("TRAVEL", 40)):
        monkeypatch.setattr(packing, name, value)
    r = random.Random(22)
    known = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(80)]
    rows = [(i, " ".join(r.choice(known) for _ in range(r.choice([0, 3, 20, 60, 700])))) for i in range(150)]
    rows += [(200 + i, rows[i % 4][1] if i % 2 else "one text, many times") for i in range(100)] + [(None, "no id"), (None, "no id"), (400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(t.doc_id), ids_of(bytes(t.ids), t.width).astype("<u4").tobytes()) for t in tokenize(docs, WORD, 1).collect())
    pieces = pack_documents(docs, WORD, 1, window=64, shard_tokens=900).collect()
    by, length = defaultdict(list), Counter()
    for p in pieces:
        by[p.doc_id].append(p)
        length[p.sequence_id] += p.length
    twice = [p for p in by.pop(None)]
    assert sorted(p.doc_tokens for p in twice if p.start == 0) == sorted(len(i) // 4 for d, i in want if d == "None")
    assert sum(p.length for p in twice) == sum(len(i) // 4 for d, i in want if d == "None")
    for doc_id, i in want:
        if doc_id != "None":
            own = sorted(by[int(doc_id)], key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in own) == i and [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    assert sum(n < 64 for n in length.values()) <= 1 and max(length.values()) == 64
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:]))


def test_copies_fill_many_partitions(spark):
    """A third of the corpus is one text: its leaf is spread, and every id still lies in one piece."""
    rows = [(i, "the same words again " * 10 if i % 3 == 0 else f"document {i} of its own {i * 7 % 101}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    pieces = pack_documents(docs, WORD, 1, window=128, shard_tokens=3000).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows}
    assert sum(p.length for p in pieces) == sum(r.n for r in tokenize(docs, WORD, 1).select("n").collect())
    hot = defaultdict(int)
    for p in pieces:
        hot[p.sequence_id >> 33] += p.doc_id % 3 == 0
    assert max(hot.values()) < 1000


def test_parts_between_spaces_are_worked_out_once(monkeypatch):
    """Words with signs, other white space, repeats over lots and a full store: ids are the library's, and each distinct part is split once a lot."""
    r = random.Random(8)
    words = ["it's", "ça", "L'ÉTÉ", "a\nb", "x,y.z", "12a3", "", "\t", "«oui»", "'scene", "'s", "End.", "<|endoftext|>", "日本"]
    texts = [" ".join(r.choice(words[:-2] if r.random() < 0.9 else words) for _ in range(r.randint(0, 40))) for _ in range(400)]
    own = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in own(texts)] == want == [i.tolist() for i in own(texts)]
    small = Encoder(public_tokenizers.path("word_bpe_49k.json"), most=3)
    assert [i.tolist() for at in range(0, 400, 50) for i in small(texts[at:at + 50])] == want and len(small.place) <= 3

    asked = []
    found = Encoder._ids_of
    monkeypatch.setattr(Encoder, "_ids_of", lambda self, parts, *more: asked.append(len(parts)) or found(self, parts, *more))
    again = own(["one two, two, one"] * 1000)
    assert asked == [2] and len({i.tobytes() for i in again}) == 1


def test_document_frequencies_of_wide_ids(spark):
    """Ids beyond 16 bits, documents without ids and repeats against sets."""
    r = random.Random(9)
    docs = [[r.choice([1, 7, 70_000, 400_000, r.randrange(300_000)]) for _ in range(r.choice([0, 1, 30]))] for _ in range(300)]
    rows = [(i, len(d), 4, bytearray(np.array(d, "<u4").tobytes())) for i, d in enumerate(docs)]
    counts, n, total = document_frequencies(spark.createDataFrame(rows, "doc_id long, n int, width byte, ids binary"))
    want = Counter(i for d in docs for i in set(d))
    assert {i: c for i, c in enumerate(counts.tolist()) if c} == want and (n, total) == (300, sum(map(len, docs)))


def test_distinct_parts_of_a_byte_vocabulary_are_split_once(monkeypatch):
    """Spaces beside other white space, at the ends and none at all: ids are the library's, and a known part is not split again."""
    r = random.Random(10)
    words = ["it's", "ça", "a\nb", "x,y.z", "12a3", "", " ", "\t", "\n", "«oui»", "'s", "End."]
    texts = [r.choice(["", " ", "\n"]) + " ".join(r.choice(words) for _ in range(r.randint(0, 30))) + r.choice(["", " "]) for _ in range(400)]
    texts += ["one two", "one", ""]
    own = Encoder(BYTE)
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in own(texts)] == want == [i.tolist() for i in own(texts)]

    asked = []
    found = Encoder._ids_of
    monkeypatch.setattr(Encoder, "_ids_of", lambda self, parts: asked.extend(parts) or found(self, parts))
    again = own(["one two, two, one"] * 1000)
    assert sorted(set(asked)) == [" one", " two,", "one"] and asked.count(" two,") == 1 and len({i.tobytes() for i in again}) == 1


def test_forgotten_encoders_are_made_again():
    """What a worker keeps of the texts can go between two tasks; the ids stay the library's."""
    from outings.llm import tokens
    from outings.llm.common import release

    first = tokens.encoder(WORD)
    ids = first(["one two, three"])[0].tolist()
    tokens.forget()
    release()
    assert not tokens._encoders
    assert tokens.encoder(WORD) is not first and tokens.encoder(WORD)(["one two, three"])[0].tolist() == ids


def test_words_of_a_byte_vocabulary_are_looked_up_without_the_signs_after_them(monkeypatch):
    """Signs, white space and letters of all kinds around words: ids are the library's; a word is one piece whatever signs follow, over three million characters."""
    r = random.Random(11)
    words = ["one", "ÉTÉ", "ſtraße", "x", "it", "12", "3a", "«oui»", "", "\n", "\t\r", "a\nb"]
    signs = ["", "", ",", "!!", "'s", "'", "''", "’s", "…", "€", ".\n", "$$$", "\n", "'ll.", "-é"]
    texts = ["".join(r.choice(["", " ", " ", "  "]) + r.choice(words) + r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(600)]
    want = [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    for own in (Encoder(BYTE), Encoder(BYTE, most=30)):
        assert [i.tolist() for i in own(texts)] == want == [i.tolist() for i in own(texts)]

    own, looked, split = Encoder(BYTE), [], Encoder._pieces_of
    monkeypatch.setattr(Encoder, "_pieces_of", lambda self, parts: looked.append(split(self, parts)[0]) or split(self, parts))
    own(["one two, two. one! two"] * 140_000)
    assert [sorted(pieces) for pieces in looked] == [[" one", " two", "!", ",", ".", "one"]]


def test_pieces_in_one_text_keep_their_ids():
    """More pieces than one text takes, with spaces, white space and letters of two bytes; none at all."""
    r = random.Random(12)
    pieces = ["".join(r.choice("ab é\n ß€'!") for _ in range(r.randint(1, 9))) for _ in range(1030)]
    own, library = Encoder(BYTE), Tokenizer.from_file(BYTE)
    library.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    for some in (pieces, pieces[:256], pieces[:1], []):
        ids, counts = ids_of_pieces(own.pieces, some, own.bytes)
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
