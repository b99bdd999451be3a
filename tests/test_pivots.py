"""Farthest pairs and nearest earlier turns of large units against all pairs in numpy, and how many pairs pivots leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pivots, vectors


def clustered(spark, n, centres, spread, dims=16, seed=5):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    v = c[r.integers(0, centres, n)] / np.linalg.norm(c, axis=1).mean() + spread * r.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([("u", i, x.tolist()) for i, x in enumerate(v)], "unit string, turn_index long, v array<double>")


def nearest(v, step=2000):
    m = np.full(len(v), -2.0)
    for i in range(0, len(v), step):
        c = v[i : i + step] @ v.T
        c[np.arange(len(v))[None, :] >= np.arange(i, i + len(c))[:, None]] = -2
        m[i : i + step] = c.max(axis=1)
    return m[1:]


@pytest.mark.parametrize("centres,spread", [(1, 5.0), (12, 0.03)])
def test_same_as_all_pairs(spark, centres, spread):
    v, df = clustered(spark, 1500, centres, spread)
    b = pivots.blocks(df, 16, 64)
    assert b.agg(F.sum(F.size("turns"))).first()[0] == 1500 and b.agg(F.max(F.size("turns"))).first()[0] <= 64
    assert pivots.farthest(b).first().least == pytest.approx((v @ v.T).min(), abs=1e-12)
    got = {r.turn_index: r.m for r in pivots.nearest_earlier(b).collect()}
    want = nearest(v)
    assert sorted(got) == list(range(1, 1500))
    assert [got[i] for i in range(1, 1500)] == pytest.approx(want.tolist(), abs=1e-12)


def test_a_large_unit_of_clusters_compares_few_pairs(spark):
    n = 50_000
    v, df = clustered(spark, n, 50, 0.01)
    b = pivots.blocks(df.repartition(8))
    rows = pivots.nearest_earlier(b).agg(F.sum("compared").alias("c"), F.avg("m").alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert rows.n == n - 1 and rows.c < 0.1 * n * n / 2
    assert rows.m == pytest.approx(nearest(v).mean(), abs=1e-9)
    far = pivots.farthest(b).first()
    assert far.compared < 0.1 * n * n / 2
    assert far.least == pytest.approx(min((v[i : i + 2000] @ v.T).min() for i in range(0, n, 2000)), abs=1e-12)


def test_small_and_large_units_together(spark):
    df = spark.createDataFrame(
        [("a", 1, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("b", 2, [-1.0, 0.0]), ("c", 1, [1.0, 0.0]), ("c", 2, [2.0, 0.0]), ("c", 3, [0.0, 3.0]), ("c", 4, [0.0, 1.0])],
        "unit string, turn_index long, v array<double>",
    )
    for small in (0, 3, 100):
        assert {r.unit: r.greatest for r in vectors.dispersion(df.where("unit <> 'b' or turn_index = 2 or v[0] = 1"), small, 2).collect()} == {"a": None, "b": 2.0, "c": 1.0}
        assert {r.unit: (r.turns, r.mean_max, r.redundant) for r in vectors.redundancy(df, 0.7, small, 2).collect()} == {"b": (1, 0.0, 0.0), "c": (3, pytest.approx(2 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))}
    assert vectors.redundancy(df.where("false"), small=0).count() == 0
