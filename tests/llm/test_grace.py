"""Classes of equal texts against a dictionary; tiny buckets make many levels."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from outings.llm.grace import Table, exact_copies

KIND = "doc_id long, text string, copies int"


def invented(seed=3, count=400):
    r = random.Random(seed)
    known = ["".join(r.choice("ab é\n") for _ in range(r.randint(0, 40))) for _ in range(60)]
    rows = [(i, "hot text " * 30 if i % 3 == 0 else r.choice(known) + r.choice(["", " ", "\t\n"]), i) for i in range(count)]
    rows += [(count + i, " \r\x0b\x0c" if i % 2 else None, i) for i in range(6)]
    rows += [(None, known[0], 1), (None, known[0], 2), (5, known[1], 3), (5, known[1], 4), (count + 9, "z" * 50_000, 5), (count + 8, "z" * 50_000, 6)]
    r.shuffle(rows)
    return rows


def expected(rows):
    classes = defaultdict(list)
    for i, t, _ in rows:
        classes[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = defaultdict(list)
    for body, group in classes.items():
        keep = min(group)[3]
        for _, _, _, i in group:
            out[i].append((keep, len(group), hashlib.sha256(body.encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("sizes", [dict(), dict(bucket_bytes=3000, lot_bytes=200), dict(bucket_bytes=300, lot_bytes=1)])
def test_against_a_dictionary(spark, sizes):
    rows = invented()
    found = exact_copies(spark.createDataFrame(rows, KIND).repartition(5), **sizes)
    assert found.columns == ["doc_id", "text", "copies", "copies_"]
    got = defaultdict(list)
    kept = defaultdict(int)
    held = found.collect()
    for row in held:
        c = row.copies_
        got[row.doc_id].append((c.keep_id, c.group_size, c.sha256))
        kept[c.sha256] += c.kept
        assert not c.kept or row.doc_id == c.keep_id
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in expected(rows).items()}
    assert set(kept.values()) == {1} and len(held) == len(rows)
    assert sorted((r.doc_id, r.text, r.copies) for r in held if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None) or \
        sorted(map(str, [(r.doc_id, r.text, r.copies) for r in held])) == sorted(map(str, rows))


def test_no_rows(spark):
    assert exact_copies(spark.createDataFrame([], KIND), carry=["doc_id"]).count() == 0


def test_equal_hashes_do_not_make_texts_equal():
    table = Table()
    places = [table.place(7, str(i % 50).encode()) for i in range(200)]
    assert places == [i % 50 for i in range(200)] and len(table) == 50


def test_hot_texts_shrink_before_they_are_dealt(spark, monkeypatch):
    """A text that all rows have is one record a lot, and goes through more levels where it doesn't fit."""
    from outings.llm import grace

    levels = []
    own = grace.spill
    monkeypatch.setattr(grace, "spill", lambda *a, **k: levels.append(a[1]) or own(*a, **k))
    same = spark.range(0, 600, 1, 12).selectExpr("id AS doc_id", "repeat('abc ', 100) AS text")
    found = exact_copies(same, lot_bytes=1, bucket_bytes=1000).collect()
    assert {(r.copies.keep_id, r.copies.group_size) for r in found} == {(0, 600)} and sum(r.copies.kept for r in found) == 1
    assert len(levels) > 2
