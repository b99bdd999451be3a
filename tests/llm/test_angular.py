"""Hard negatives against scoring everything."""

import math
import random

import numpy as np
import pytest

from tessera.llm import angular

SCHEMA = "vec_id long, embedding array<float>, label int, label2 string, block string, q int"


def brute(rows, every=50, move=True):
    seen = {}
    for vec_id, x, label, *_ in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if move and vec_id % 7 == 0 else label
        seen[vec_id, label, tuple(math.floor(256 * float(np.float32(c))) for c in x)] = None
    out = []
    for a, la, xa in seen:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(xa, x)), v, la == lv) for v, lv, x in seen if v != a)  # noqa: B905
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            fit = [(-ns, v) for ns, v, same in scored if not same and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out += [(a, p, k, v, -ps, ns) for k, (ns, v) in enumerate(fit, 1)]
    return sorted(out)


def table(n, d, seed, near=0.3):
    rng = random.Random(seed)
    centers, rows = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(12)], []
    for k in range(n):
        c = centers[rng.randrange(12)]
        x = [v + rng.gauss(0, near) for v in c]
        size = math.sqrt(sum(v * v for v in x)) / rng.choice([0.5, 1, 1, 1, 3])
        rows.append((k, [v / size for v in x], rng.randrange(10), "m", "b", 1))
    return rows


ODD = [
    (50, None, 1, "m", "b", 1), (51, [1.0, None, 0.5], 1, "m", "b", 1), (52, [1.0, float("nan"), 0.0], 1, "m", "b", 1), (53, [float("inf"), 0.0, 0.0], 1, "m", "b", 1), (54, [1.0, 0.0, 0.0], None, "m", "b", 1), (None, [1.0, 0.0, 0.0], 1, "m", "b", 1),
    (100, [1.0, 0.0, 0.0], 1, "m", "b", 1), (100, [1.0, 0.0, 0.0], 1, "m", "b", 2), (100, [0.9, 0.1, 0.0], 1, "m", "b", 1), (100, [1.0, 0.0, 0.0], 3, "m", "b", 1),
    *((101 + k, [1.0, 0.0, 0.0], 1, "m", "b", 1) for k in range(9)), *((121 + k, [0.9, 0.0, 0.0], 2, "m", "b", 1) for k in range(9)),
    (200, [0.0, 0.0, 0.0], 1, "m", "b", 1), (201, [0.0], 1, "m", "b", 1), (202, [], 2, "m", "b", 1), (250, [-1.0, 0.0], 5, "m", "b", 1), (251, [1.0], 5, "m", "b", 1), (300, [3e4, 2e4, -1e4], 4, "m", "b", 1), (301, [3e4, 2e4, 1.0], 4, "m", "b", 1), (302, [2e4, 2e4, 1.0], 6, "m", "b", 1),
]


@pytest.mark.parametrize(("rows", "blocks"), [(table(1500, 8, 1), 32), (table(700, 8, 2, near=0.05), 3), (ODD, 32), (ODD + table(400, 3, 3), 1)])
def test_same_as_scoring_everything(spark, monkeypatch, rows, blocks):
    monkeypatch.setattr(angular, "LEAST_BLOCKS", blocks)
    monkeypatch.setattr(angular, "WINDOW", 32)
    monkeypatch.setattr(angular, "TOGETHER", 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = angular.mined(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert sorted(map(tuple, angular.hard_negatives(df, every=25).collect())) == brute(rows, 25, False)


def test_empty(spark):
    assert angular.mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert angular.mined(spark.createDataFrame([(1, [1.0, 2.0], 3, "m", "b", 1)], SCHEMA)).count() == 0


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(2)
    refs = angular.directions(rng.normal(size=(60, 6)))
    assert np.allclose(np.linalg.norm(refs, axis=1), 1)
    for size in (1, 40):
        q = np.floor(256 * rng.normal(size=(30, 6))).astype(np.int64)
        center = rng.normal(size=6)
        x = np.floor(256 * (center + 0.05 * rng.normal(size=(size, 6)))).astype(np.int64)
        norm, own = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        a, b = angular.angles(q, norm, refs), angular.angles(x, own, refs)
        low, high = angular.bounds(a, norm, b.min(axis=0)[None], b.max(axis=0)[None], own.min()[None], own.max()[None])
        s = q @ x.T
        assert (s >= low).all() and (s <= high).all()
        assert (high[:, 0] < 0.9 * norm * own.max()).mean() > 0.5  # most pairs are far from the greatest score


def test_most_windows_of_clustered_vectors_are_not_scored():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(16, 32))
    x = np.floor(256 * (centers[np.arange(4096) // 256] + 0.02 * rng.normal(size=(4096, 32)))).astype(np.int64)
    refs = angular.directions(x[::16])
    block = angular._Block(32)
    norm = np.linalg.norm(x, axis=1)
    a = angular.angles(x, norm, refs)
    for k in range(0, 4096, 256):
        s = slice(k, k + 256)
        block.add({"n": 256, "ids": np.arange(k, k + 256).tobytes(), "q": angular._pack(x[s]), "label": 1, "lo": a[s].min(axis=0).tobytes(), "hi": a[s].max(axis=0).tobytes(), "norm_lo": norm[s].min(), "norm_hi": norm[s].max()})
    block.close()
    rows = [{"q": angular._pack(x[k : k + 1]), "lo": a[k].tobytes(), "norm_lo": norm[k], "label": 1, "ids": np.array([k]).tobytes(), "ord": k} for k in range(0, 4096, 64)]
    got = block.best(rows, True).to_pydict()
    for k in range(0, 4096, 64):
        s = x @ x[k]
        want = sorted((-int(v), j) for j, v in enumerate(s) if j != k)[:5]
        assert sorted((-v, o) for i, o, v in zip(got["anchor_id"], got["other"], got["score"], strict=True) if i == k) == want
    assert block.scored < 0.25 * block.met


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (200, 2**15, 2**25):
        x, y = (rng.integers(-top, top, (5, 7)) for _ in range(2))
        most = float(np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max())
        assert (angular.products(x, y, most) == x.astype(object) @ y.astype(object).T).all()
