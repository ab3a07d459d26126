import random

import numpy as np
from pyspark.sql import functions as F

from outings.llm.langid import UNKNOWN, WINDOW, ByteCNN, identify, softmax, train, windows_of

SOUNDS = {"aa": ["ta", "ki", "no", "shi"], "bb": ["sch", "ung", "ver", "ich"], "cc": ["eau", "é", "qu", "ment"]}


def invented(seed, count):
    r = random.Random(seed)
    rows = []
    for i in range(count):
        lang = r.choice(list(SOUNDS))
        rows.append((i, " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(2, 4))) for _ in range(r.randint(4, 300))), lang))
    return rows


def test_held_out_accuracy_and_the_same_again(spark):
    docs = spark.createDataFrame(invented(1, 400), "doc_id long, text string, lang string")
    learn = F.col("doc_id") % 4 != 2
    first, second = (train(docs, learn, per_language=60, steps=200) for _ in range(2))
    assert all((first.p[k] == second.p[k]).all() for k in first.p)
    got = identify(docs.where(~learn), first).collect()
    assert np.mean([r.language.lang == r.lang for r in got]) > 0.97
    assert all(0 <= r.language.score <= 1 for r in got)


def test_only_usable_rows_are_learned(spark):
    docs = spark.createDataFrame(invented(2, 200), "doc_id long, text string, lang string")
    model = train(docs, F.col("lang") != "bb", per_language=20, steps=5)
    assert model.languages == ["aa", "cc"]


def test_the_folded_tables_give_the_network_itself():
    model = ByteCNN(["a", "b", "c"])
    codes = np.concatenate([windows_of(t.encode()) for t in ("Hello wörld 12\n" * 60, "x", "")])
    want = []
    for c in codes.astype(np.int64):
        pooled = []
        for w in (2, 3, 4):
            conv = np.stack([sum(model.p["embedding"][c[i + k]] @ model.p[f"conv{w}"][k] for k in range(w)) for i in range(WINDOW - w + 1)])
            pooled.append(conv.max(axis=0) + model.p[f"shift{w}"])
        want.append(np.maximum(np.concatenate(pooled), 0) @ model.p["out"] + model.p["bias"])
    assert np.allclose(model.chances(codes), softmax(np.array(want)), atol=1e-5)


def test_gradients_are_those_of_the_loss():
    model = ByteCNN(["a", "b"])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    codes = np.concatenate([windows_of(t.encode()) for t in ("one two three", "vier fünf")]).astype(np.int64)
    wanted = np.array([0, 1])
    _, g = model._gradients(codes, wanted)
    r = np.random.default_rng(1)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        hot = np.flatnonzero(g[name].reshape(-1))
        for at in r.choice(hot, min(4, len(hot)), replace=False):
            old, step = flat[at], 1e-5
            losses = []
            for x in (old + step, old - step):
                flat[at] = x
                losses.append(model._gradients(codes, wanted)[0])
            flat[at] = old
            assert abs((losses[0] - losses[1]) / (2 * step) - g[name].reshape(-1)[at]) < 1e-4


def test_whole_texts_count(spark):
    """The end of a long text decides when it is the larger part."""
    docs = spark.createDataFrame(invented(1, 300), "doc_id long, text string, lang string")
    model = train(docs, F.lit(True), per_language=60, steps=200)
    long = "schungver " * 2000 + "takinoshi " * 60_000
    row = identify(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()
    assert row.language.lang == "aa" and 0.9 < row.language.score < 0.98


def test_nulls_letterless_texts_names_and_no_rows(spark, nothing):
    rows = [(1, None, "aa", 1), (2, "", None, 2), (3, "12 !?", "bb", 3), (None, "takino", "aa", 4), (4, "schung", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    assert train(docs, F.lit(True)) is None and train(nothing, F.lit(True)) is None
    more = docs.drop("language").unionByName(spark.createDataFrame(invented(3, 60), "doc_id long, text string, lang string"))
    got = {r.language: r.language_ for r in identify(docs, train(more, F.lit(True), steps=40)).collect()}
    assert [got[k].lang for k in (1, 2, 3)] == [UNKNOWN] * 3 and got[1].score == 0
    assert got[4].lang in SOUNDS and got[5].lang in SOUNDS
    assert {r.language_.lang for r in identify(docs, None).collect()} == {UNKNOWN}
    assert identify(nothing, None).count() == 0


def test_digits_and_fractions_are_no_letters(spark):
    model = train(spark.createDataFrame(invented(3, 60), "doc_id long, text string, lang string"), F.lit(True), steps=5)
    texts = ["½ ² ¾", "²", "12 ½", "_", "٣", None, "", "½ a", "ª"]
    got = identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.language.lang == UNKNOWN for r in got] == [True] * 7 + [False] * 2


def test_the_sample_needs_no_window(spark, monkeypatch):
    """Of many documents of a label exactly ``per_language`` are learned from, and none is ranked in a window of its label."""
    from pyspark.sql import Window

    monkeypatch.setattr(Window, "partitionBy", None)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort "), F.col("id")).alias("text"),
                                    F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("lang"))
    seen = []
    monkeypatch.setattr(ByteCNN, "fit", lambda self, codes, labels, steps: seen.append(np.bincount(labels)))
    train(docs, F.lit(True), per_language=50, per_document=1)
    assert seen[0].tolist() == [50, 50]
