import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from outings.llm.common import components
from outings.llm.simhash import Index, choices, fingerprint_links, gray_rank, links, near_duplicates


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_print(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clustered(seed, centres, each, bits):
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(r.randint(0, bits)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)


def test_documents_like_brute_force(documents):
    rows = near_duplicates(documents(3, 80)).collect()
    for r in rows:
        assert r.fingerprint & (1 << 64) - 1 == brute_print(r.text)
    ids = {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in rows}
    pairs = [(a, b) for a in ids for b in ids if a < b and (ids[a] ^ ids[b]).bit_count() <= 4]
    assert {r.doc_id: r.component for r in rows} == roots(ids, pairs)


def test_links_join_what_brute_force_joins(spark):
    prints = clustered(5, 40, 30, 5)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if (a ^ b).bit_count() <= 4]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "p long")
    for segment in (4096, 7):  # files of one segment, and of many
        found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in fingerprint_links(frame, 4, segment).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in found)
        assert roots(prints, found) == roots(prints, pairs)


def test_index_finds_every_pair_once():
    prints = np.array(clustered(6, 20, 40, 6), np.uint64)
    prints = prints[np.argsort(gray_rank(prints))]
    index = Index(prints)
    found = [p for x, y in links(index, index, 4, most=1 << 12) for p in zip(x.tolist(), y.tolist())]
    want = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    assert sorted(found) == want


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_choices_always_leave_an_equal_block():
    r = random.Random(2)
    for count in (10, 10**6, 10**9, 10**11):
        masks = choices(count, 4)
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_components_of_a_path_a_star_and_a_ring(spark):
    r = random.Random(3)
    names = r.sample(range(10**6), 300)
    pairs = list(zip(names[:99], names[1:100])) + [(names[100], n) for n in names[101:200]] + list(zip(names[200:], names[201:] + names[200:201]))
    pairs += pairs[:5] + [(names[0], names[0])]
    got = {x.node: x.label for x in components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()}
    assert got == roots(names, pairs)
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_null_ids_repeated_rows_names_and_no_rows(spark):
    rows = [(None, "a b c d e", 1), (7, "a b c d e", 2), (7, "a b c d e", 2), (None, "zz", 3), (3, None, None), (2, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = near_duplicates(docs)
    assert got.columns == ["doc_id", "text", "fingerprint", "fingerprint_", "component"] and got.count() == 6
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert by[None, "a b c d e"].component == 7 and by[None, "zz"].component is None
    assert by[3, None].component == by[2, ""].component == 2 and by[2, ""].fingerprint_ == 0
    assert near_duplicates(docs.where(F.lit(False))).count() == 0
