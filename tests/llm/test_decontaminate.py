import random
import re

from outings.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    wins = []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        wins += [(str(item), w[i:i + n]) for i in range(len(w) - n + 1)] if w else []
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        out[key] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def case(seed, short=False):
    r = random.Random(seed)
    known = ["Ab", "c1", "été", "x", "yy"]
    items = [(i, " ".join(r.choice(known) for _ in range(r.randint(1 if short else 5, 12)))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "--"), (3, items[3][1])]
    docs = []
    for i in range(60):
        parts = [items[r.randrange(12)][1] if r.random() < 0.3 else " ".join(r.choice(known + ["q", "Z"]) for _ in range(9)) for _ in range(r.randint(0, 6))]
        docs.append((i, "; ".join(parts).replace("ab", "AB")))
    return docs + [(70, None), (71, ""), (72, "...")], items


def run(spark, docs, items, **more):
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **more)
    return {r.doc_id: r.contamination for r in found.collect()}


def test_like_brute_force(spark):
    for seed, window, short in ((1, 5, False), (2, 7, True), (3, 13, True)):
        docs, items = case(seed, short)
        got, want = run(spark, docs, items, window=window), brute(docs, items, window)
        assert {k: (c.n_words, c.n_hit, c["items"], c.contaminated) for k, c in got.items()} == want


def test_benchmark_in_many_lots_gives_the_same(spark):
    docs, items = case(4)
    one, many = run(spark, docs, items, window=5), run(spark, docs, items, window=5, shard_words=20)
    assert {k: c.asDict(True) for k, c in one.items()} == {k: c.asDict(True) for k, c in many.items()}


def test_cut_text_keeps_what_is_not_hit(spark):
    passage = " ".join(f"t{i}" for i in range(13))
    filler = " ".join(f"f{i}" for i in range(300))
    got = run(spark, [(1, f"{filler}, {passage.upper()}! end"), (2, f"a {passage}"), (3, filler)], [(5, passage)])
    assert got[1].cut == f"{filler}, ! end" and not got[1].contaminated and got[1].n_hit == 13
    assert got[2].contaminated and got[2].cut == "a "
    assert got[3].cut is None and got[3].spans == []


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", None)], "doc_id long, text string, contamination string, n_words long")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate(docs, none).first()
    assert (row.contamination, row.n_words, row.contamination_.n_words, row.contamination_.n_hit) == ("x", None, 2, 0)
    assert decontaminate(docs.limit(0), none).count() == 0


def test_long_text(spark):
    passage = " ".join(f"t{i}" for i in range(13))
    text = " ".join(["t1 t2 t3 t4"] * 200_000 + [passage])
    got = run(spark, [(1, text)], [(5, passage)])[1]
    assert (got.n_words, got.n_hit, got.contaminated) == (800_013, 13, False)
