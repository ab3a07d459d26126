import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outings.llm.embeddings import near_vectors
from tests.llm.test_simhash import roots


def vectors(seed, size, centres, each, spread):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(centres):
        c = r.normal(size=size)
        out += [(c + spread * r.normal(size=size)).astype(np.float32).tolist() for _ in range(r.integers(1, each))]
    random.Random(seed).shuffle(out)
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, threshold):
    good = [(i, np.array(v, np.float64)) for i, v in rows if usable(v)]
    size = max((len(v) for _, v in good), default=0)
    full = [(i, np.pad(v, (0, size - len(v)))) for i, v in good]
    n, pairs = {i: 0 for i, _ in rows}, []
    for k, (i, a) in enumerate(full):
        for j, b in full[k + 1:]:
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                n[i] += 1
                n[j] += 1
                pairs.append((i, j))
    label = roots([i for i, _ in rows], pairs)
    return {i: (n[i], label[i], label[i] == i) for i in n}


def run(spark, rows, **more):
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **more).collect()
    assert len(got) == len(rows)
    return {r.vec_id: (r.links.n_links, r.links.component, r.links.kept) for r in got}


@pytest.mark.parametrize("size,spread,more", [(16, 0.15, {}), (16, 0.2, {"block": 20}), (3, 0.3, {"block": 16, "axes": 2}), (1, 1.0, {}), (40, 0.18, {"block": 33, "axes": 12})])
def test_like_brute_force(spark, size, spread, more):
    rows = list(enumerate(vectors(size, size, 40, 12, spread)))
    rows += [(1000 + k, rows[k % 7][1]) for k in range(30)]  # copies
    assert run(spark, rows, **more) == brute(rows, 0.95)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [3.0]), (10, [-1.0, 0.0])]
    got = run(spark, rows)
    assert got == brute(rows, 0.95)
    assert got[7] == (2, 7, True) and got[9] == (2, 7, False) and got[4] == (0, 4, True)


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.links.n_links, r.links.component or 0, r.links.kept) for r in got) == [
        (0, 0, 0, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_names_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0], 5, "x", 2)], "vec_id long, embedding array<float>, links int, component string, n_links int")
    got = near_vectors(rows)
    assert got.columns[:5] == rows.columns and got.columns[5] == "links_"
    assert (got.first().links_.component, got.first().component, got.first().n_links) == (1, "x", 2)
    assert near_vectors(rows.where(F.lit(False))).count() == 0


def test_a_large_group_is_never_paired_out(spark):
    base = [1.0, 2.0, 3.0]
    rows = [(i, base) for i in range(3000)] + [(5000, [1.0, 2.0, 3.1])]
    got = run(spark, rows)
    assert got[7] == (3000, 0, False) and got[5000] == (3000, 0, False) and got[0] == (3000, 0, True)
