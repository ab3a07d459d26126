"""Whitened vectors against numpy over all rows, with no classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outings.llm.whitening import BASE, whiten

KIND = "vec_id long, embedding array<double>, whitening string"


def invented(seed=1, rows=300, size=6):
    r = np.random.default_rng(seed)
    own = r.normal(size=(rows, size)) @ r.normal(size=(size, size)) * 0.3
    own[rows // 3:2 * rows // 3] = own[0]  # a third are copies
    out = [(i, v.tolist(), "kept") for i, v in enumerate(own)]
    return out + [(None, own[5].tolist(), None), (7, own[5].tolist(), None), (rows, None, None), (rows + 1, [1.0, None], None),
                  (rows + 2, [float("nan")] * size, None), (rows + 3, [float("inf")] * size, None), (rows + 4, [0.5], None), (rows + 5, [], None)]


def usable(rows, size):
    good = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    x = [[int(np.floor(64 * c)) + BASE for c in r[1]] + [BASE] * (size - len(r[1])) for r in good]
    return good, x


@pytest.mark.parametrize("weights", ["count", "one"])
def test_against_numpy(spark, weights):
    rows = invented()
    found = whiten(spark.createDataFrame(rows, KIND), weights=weights, most=4).orderBy("vec_id").collect()
    good, x = usable(rows, 6)
    fit = x if weights == "count" else [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(v[d] for v in fit) for d in range(6)]
    centred = np.array(fit, float) - np.array(sums) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert len(found) == len(good)
    signs = None
    key = {(r[0], tuple(r[1])): v for r, v in zip(good, x)}
    for row in found:
        v, w = key[row.vec_id, tuple(row.embedding)], row.whitening_
        assert w.n == n and w.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
        want = (np.array(v) - np.array(sums) / n) @ axes / np.sqrt(values)
        if signs is None:
            signs = np.sign(np.array(w.whitened) * want)
        np.testing.assert_allclose(np.array(w.whitened) * signs, want, atol=1e-8)
        np.testing.assert_allclose(w.explained, values / np.trace(covariance), rtol=1e-9)
        assert w.identity_error < 1e-9
    assert {r.whitening for r in found} == {"kept", None}  # the column of that name is passed on


def test_directions_without_variance(spark):
    flat = whiten(spark.createDataFrame([(i, [float(i % 3), 2.0, 0.0]) for i in range(30)], "vec_id long, embedding array<float>"))
    assert {len(r.whitening.whitened) for r in flat.collect()} == {1}
    copies = whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert len(copies) == 5 and all(r.whitening.whitened == [] and r.whitening.deviation == 0 for r in copies)


def test_no_rows(spark):
    assert whiten(spark.createDataFrame([], KIND)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, None)], KIND)).count() == 0


def test_wide_entries(spark):
    """What no long holds is null, nothing overflows."""
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 0.25]), (2, [0.5, 1.0])]
    found = {r.vec_id: r.whitening for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(found) == 3 and found[0].deviation is None and all(np.isfinite(w.whitened).all() for w in found.values())


def test_large_classes_are_not_shuffled(spark):
    """Each of the classes with many rows is met by broadcast, the rest by the shuffle; every row comes once."""
    many = spark.range(4000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(
        F.array(F.col("id") / 64, F.sin("id"))).alias("embedding"))
    found = whiten(many)
    assert found.count() == 4000 and found.select("vec_id").distinct().count() == 4000
