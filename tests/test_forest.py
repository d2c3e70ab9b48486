"""Trees grown by tasks against plain loops, over all rows in one task or level by level."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from postsieve.operators import forest as G, study as Y


def points(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 5)).astype(float)
    y = (x[:, 1] > 5) * 1 + ((x[:, 3] > 8) & (x[:, 1] > 5)) * 1
    y = np.where(rng.random(n) < 0.15, rng.integers(0, 3, n), y)
    return x, y, spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(x.tolist(), y.tolist(), strict=True)], ["features", "y"])


def gini(y):
    return len(y) - (np.bincount(y, minlength=3) ** 2).sum() / len(y) if len(y) else 0.0


def loop(x, y, depth, gains):
    """Predictions of a tree for its own rows, and gains by feature."""
    found = []
    for j in range(x.shape[1]):
        for t in sorted(set(x[:, j]))[:-1]:
            left = x[:, j] <= t
            found.append((round(gini(y) - gini(y[left]) - gini(y[~left]), 9), -j, -t))
    gain, j, t = max(found, default=(0, 0, 0))
    if not depth or gain <= 1e-9:
        return np.tile(np.bincount(y, minlength=3) / len(y), (len(y), 1))
    gains[-j] += gain
    left, out = x[:, -j] <= -t, np.zeros((len(y), 3))
    out[left], out[~left] = loop(x[left], y[left], depth - 1, gains), loop(x[~left], y[~left], depth - 1, gains)
    return out


@pytest.mark.parametrize("local", [1 << 15, 20])
def test_a_tree(spark, monkeypatch, local):
    monkeypatch.setattr(G, "LOCAL_ROWS", local)
    monkeypatch.setattr(G, "CELLS", 2000)
    x, y, rows = points(spark, 150)
    gains = np.zeros(5)
    want = loop(x, y, 6, gains)
    values, got = G.forest(rows, rows, 1, 6, bagged=False, use=lambda v, made: (v, made.collect()))
    assert np.allclose(values, gains / gains.sum())
    assert np.allclose(sorted((r.y, *r.probability) for r in got), sorted((float(c), *p) for c, p in zip(y, want.round(9), strict=True)))


def test_a_forest_wherever_it_grows(spark, monkeypatch):
    x, y, rows = points(spark, 300)
    _, truth, held = points(spark, 200, 1)
    take = lambda v, made: (v, sorted(map(tuple, made.collect())))
    a = G.forest(rows, held, 20, use=take)
    assert a[0].argmax() == 1 and abs(a[0].sum() - 1) < 1e-9 and sum(r[0] == r[2] for r in a[1]) > 140
    monkeypatch.setattr(G, "LOCAL_ROWS", 30)
    b = G.forest(rows, held, 20, use=take)
    assert np.allclose(a[0], b[0]) and a[1] == b[1]


def test_queries_grow_no_spark_trees(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("grown by Spark")

    monkeypatch.setattr(Y.RandomForestClassifier, "fit", fail)
    monkeypatch.setattr(Y.DecisionTreeClassifier, "fit", fail)
    _, _, rows = points(spark, 60)
    assert len(Y.importances(rows, list("abcde")).collect()) == 5
    assert {r.model for r in Y.accuracies(rows, rows, ["tree", "forest"]).collect()} == {"tree", "forest"}
