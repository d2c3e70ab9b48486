"""The k-means tree against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsieve.llm import vector_tree
from postsieve.llm.shared import Scratch

EXTRA = "rank int, score double, width int, cell int, at string"


def plain(rows, queries, k):
    """Every (query_id, vec_id, score) by rank, over rows (id, vector) that differ."""
    ok = [r for r in dict.fromkeys(rows) if r[0] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    out = {}
    for q in dict.fromkeys(r for r in queries if r in ok):
        scores = []
        for r in ok:
            if r != q and len(r[1]) == len(q[1]):
                s = 0.0
                for a, b in zip(r[1], q[1], strict=True):
                    s += a * b
                scores.append((-s, r[0]))
        out.setdefault(q[0], []).append([(i, -s) for s, i in sorted(scores)[:k]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(v), 1, 0.5, 2, 3, "x") for i, v in rows], f"vec_id long, embedding array<float>, {EXTRA}")


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [x[n] for n in range(1, len(x) + 1)] for q, x in out.items()}


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)
    return [tuple(map(float, v)) for v in x]


def test_all_leaves_are_exact(spark):
    """Copies, ties, repeated rows and ids, odd vectors, two lengths: with every leaf visited nothing is lost."""
    vectors = clustered(300, 6, 1)
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[5]) for i in range(60)] + [(5, vectors[5]), (7, vectors[9]), (7, vectors[9])]
    rows += [(2000, None), (2020, ()), (2040, (0.0,) * 6), (2060, (1.0, None, 1.0, 1.0, 1.0, 1.0)), (2080, (float("nan"),) * 6), (2100, (float("inf"),) * 6), (None, vectors[3])]
    rows += [(3000 + i, v) for i, v in enumerate(clustered(30, 3, 2))] + [(4000, (1.0,) * 9), (4020, (-1.0, *[0.0] * 5)), (4021, (-2.0, *[0.0] * 5))]
    df = frame(spark, rows).repartition(5)
    got = answers(vector_tree.nearest(df, df.where("vec_id % 5 = 0 or vec_id = 7"), 4, least=1.0, shard_rows=64))
    want = plain(rows, [r for r in rows if r[0] is not None and (r[0] % 5 == 0 or r[0] == 7)], 4)
    # audited with every query, so a recall of 1 means all; id 7 names two queries
    assert {q for q, w in want.items() if any(w)} == set(got)
    for q, w in want.items():
        if q != 7 and w[0]:
            assert got[q] == [(i, pytest.approx(s, abs=1e-12)) for i, s in w[0]], q
    assert 4000 not in got


def test_recall_and_cells(spark):
    """Many cells and leaves: recall of all queries, also those that were not audited."""
    rows = list(enumerate(clustered(6000, 16, 3)))
    df = frame(spark, rows)
    scratch = Scratch(spark, "test")
    index = vector_tree.Index.fit(df, 10, scratch, 500, 64 << 20)
    assert index.cells.count() > 8
    assert index.dealt.count() == 6000
    queries = df.where("vec_id % 6 = 0")
    got = answers(vector_tree.nearest(df, queries, 10, shard_rows=500))
    x = np.array([v for _, v in rows])
    hit = 0
    for q in range(0, 6000, 6):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10].tolist()) & {i for i, _ in got[q]})
    assert hit / 10_000 >= 0.9
    distinct = vector_tree.usable(queries).select("width", "k1", "k2", "embedding")
    cells, leaves = vector_tree.widen(index.audit(distinct), 0.95)
    assert cells * leaves < 8 * 12, "visits stay below a comparison with all"


def test_tree_and_queue():
    x = np.array(clustered(2000, 8, 4))
    tree, own = vector_tree.Tree.fit(x, 50)
    assert set(own.tolist()) == set(range(tree.leaves))
    assert (tree.place(x) == own).mean() > 0.9
    q = x[:20]
    order = tree.visits(q, tree.leaves)
    assert all(sorted(o) == list(range(tree.leaves)) for o in order)
    assert [o[:7] for o in order] == tree.visits(q, 7)
    same = np.ones((100, 3))
    one, own = vector_tree.Tree.fit(same, 10)
    assert one.leaves == 1 and not own.any()


def test_widen():
    places = [(1, 1)] * 90 + [(3, 2)] * 5 + [(8, 9)] * 5
    assert vector_tree.widen(places, 0.9) == (1, 1)
    assert vector_tree.widen(places, 0.95) == (4, 2)
    assert vector_tree.widen(places, 1.0) == (8, 9)
    assert vector_tree.widen([], 0.9) == (1, 1)


def test_empty_and_bounds(spark):
    df = frame(spark, list(enumerate(clustered(50, 4, 5))))
    assert vector_tree.nearest(df.where("false"), df).count() == 0
    assert vector_tree.nearest(df, df.where("false")).count() == 0
    few = answers(vector_tree.nearest(df.where("vec_id < 3"), df.where("vec_id < 3"), 20))
    assert {q: len(x) for q, x in few.items()} == {0: 2, 1: 2, 2: 2}
    # a bound in bytes makes shards small
    index = vector_tree.Index.fit(df, 3, Scratch(spark, "test"), 1000, 10 * 8 * 4)
    assert index.shards.count() >= 4 and index.shards.agg(F.max(F.octet_length("vectors"))).first()[0] <= 50 * 8 * 4
