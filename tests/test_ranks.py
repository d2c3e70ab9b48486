"""Running sums in two levels against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from postsieve.operators import dedupe, evaluate, ranks


@pytest.mark.parametrize("values", [[], [3.0], [random.Random(1).choice([1.0, 2.0, 2.5, 9.0]) for _ in range(500)], [float(i) for i in range(700)]])
def test_running(spark, values):
    rows = [(i, [None, "a", "b"][i % 3], v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i long, g string, v double")
    got = {r.i: (r.s, r.all_s, r.c) for r in ranks.running(df, [-F.col("v"), F.col("i")], {"s": F.col("v"), "c": F.lit(1)}, within=["g"]).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        mine, s = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 0.0
        for c, (i, _, v) in enumerate(mine, 1):
            s += v
            want[i] = (s, sum(r[2] for r in mine), c)
    assert got == want


def test_folds_take_turns(spark):
    df = spark.createDataFrame([(f"h{i // 2 if i < 40 else i}", ["spam", "ham", None][i % 7 % 3]) for i in range(300)], "norm_body_hash string, label string")
    found = dedupe.folds(df, 5).groupBy("label", "fold").count().collect()
    for label in ("spam", "ham", None):
        sizes = [r["count"] for r in found if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_one_instant(spark):
    df = spark.range(1000).select(F.timestamp_seconds(F.lit(0)).alias("t"), F.col("id").alias("seq"))
    got = {r.seq: r.part for r in dedupe.split_time(df, "t", ["seq"]).collect()}
    assert all(p == ("test" if i >= 800 else "val" if i >= 680 else "train") for i, p in got.items())


def test_threshold_with_ties(spark):
    rng = random.Random(5)
    rows = [(0, float(rng.randrange(50))) for _ in range(1000)]
    top = sorted((s for _, s in rows), reverse=True)
    for target in (0.0, 0.005, 0.3):
        cut = evaluate.threshold_for_fpr(spark.createDataFrame(rows, "y int, score double"), target)
        assert top[int(target * 1000)] < cut <= top[int(target * 1000)] + 1e-9
