import math
import random

import numpy as np
import pytest

from postsieve.operators import quantiles as Q, study as Y


@pytest.mark.parametrize("edges", [3, 512])
def test_against_sorted_values(spark, monkeypatch, edges):
    """Ties, one value, nulls, NaN and infinities, values of all sizes, few rows and none; with few edges many rounds."""
    monkeypatch.setattr(Q, "EDGES", edges)
    rng = random.Random(edges)
    n = 300 if edges == 3 else 2000
    columns = {
        "ties": [float(rng.choice([1, 1, 1, 1, 2, 7])) for _ in range(n)],
        "spread": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "one": [5.0] * n,
        "gaps": [None if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(n)],
        "odd": [rng.choice([math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-320]) for _ in range(n)],
        "few": [3.0, 1.0] + [None] * (n - 2),
        "none": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` double" for c in columns)).repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.quantiles(df, list(columns), shares)
    for c, values in columns.items():
        v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
        for p, x in zip(shares, got[c], strict=True):
            if not v:
                assert x is None
                continue
            at = p * (len(v) - 1)
            a, b = v[math.floor(at)], v[math.ceil(at)]
            want = a if a == b or at == int(at) else a + (at - math.floor(at)) * (b - a)
            assert x == want or (math.isnan(x) and math.isnan(want)), (c, p)


def test_whole_numbers_and_description(spark):
    df = spark.range(1001).selectExpr("id", "if(id % 2 = 0, null, id) odd")
    assert Q.quantiles(df, ["id", "odd"], [0.5]) == {"id": [500.0], "odd": [500.0]}
    got = {r["name"]: r for r in Y.describe(df, ["id", "odd"]).collect()}
    assert (got["id"].q1, got["id"].q3, got["odd"].missing, got["odd"].n) == (250.0, 750.0, 501, 500)
    assert got["id"].mean == np.mean(range(1001))
    empty = Y.describe(df.where("false"), ["id"]).first()
    assert empty.n == 0 and empty.q2 is None
