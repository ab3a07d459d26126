import re

from pyspark.sql import functions as F

from outings.llm.substrings import remove_repeats


def brute(rows, window):
    words = {(i, k): re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (i, t) in enumerate(rows)}
    lowest = {}
    for (i, _), w in words.items():
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if i is not None:
                lowest[key] = min(i, lowest.get(key, i))
    out = []
    for (i, _), w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and lowest.get(tuple(w[p:p + window]), i) < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(frame, **more):
    name = remove_repeats(frame, **more).columns[-1]
    found = remove_repeats(frame, **more).select("doc_id", f"{name}.*").collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str)


def test_like_brute_force(documents):
    for seed, window, more in ((1, 13, {}), (2, 5, {"batch_bytes": 500}), (3, 8, {"batch_bytes": 300, "shard_words": 50}), (4, 1, {})):
        docs = documents(seed, 70)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert run(docs, window=window, **more) == brute(rows, window)


def test_a_passage_in_every_document(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs, batch_bytes=2000) == brute(rows, 13)


def test_null_ids_repeated_ids_and_negative_ones(spark):
    text = " ".join(f"p{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (-3, text + " x"), (9, text), (9, "short")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows, 13)
    assert [g[2] for g in got if g[0] is None] == [0] and [g[2] for g in got if g[0] == -3] == [0]


def test_spans_and_other_columns(spark):
    text = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, text, 1.5, 2), (2, f"a {text} b", None, 3)], "doc_id long, text string, repeats double, batch int")
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert [(s.start, s.stop) for s in got[2].repeats_.spans] == [(1, 14)] and got[2].repeats_.kept == "a b"
    assert got[1].repeats == 1.5 and got[1].batch == 2 and got[1].repeats_.spans == []


def test_no_rows_and_long_texts(spark, nothing):
    assert remove_repeats(nothing).count() == 0
    long = " ".join(f"w{i % 977} v{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long), (2, "x " + long)], "doc_id long, text string")
    got = {r.doc_id: r.repeats for r in remove_repeats(docs).select("doc_id", F.col("repeats").alias("repeats")).collect()}
    assert got[1].n_removed == 0 and (got[2].n_words, got[2].n_removed, got[2].kept) == (300_001, 300_000, "x")


def test_a_third_without_id_and_a_third_of_one_id(spark):
    """No batch holds more than its share of either."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(f"w{k % 977}x{j}" for j in range(20))) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs, batch_bytes=20_000)
    assert sorted(((r.doc_id, r.repeats.n_words, r.repeats.n_removed, r.repeats.kept) for r in got.collect()), key=str) == brute(rows, 13)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isnull(doc_id" in plan and "isnotnull(doc_id" in plan
    count = -(-sum(len(t) for _, t in rows) // 20_000)
    sizes = docs.where("doc_id is not null").groupBy(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count))).count()
    assert sizes.agg(F.max("count")).first()[0] < 5 * len(rows) / count
