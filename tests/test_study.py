import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postsieve.operators import blocks as B, study as Y, training as R
from postsieve.streaming import scoring


def test_class_report(spark):
    rows = spark.createDataFrame([(0.0, 0.0)] * 3 + [(0.0, 1.0), (1.0, 1.0), (2.0, 0.0)], "y double, prediction double")
    got = {r.label: r for r in Y.class_report(rows).collect()}
    assert (got[0.0].precision, got[0.0].recall, got[0.0].f1, got[0.0].support) == (0.75, 0.75, 0.75, 4)
    assert (got[1.0].precision, got[1.0].recall, got[2.0].f1, got[2.0].precision) == (0.5, 1.0, 0.0, 0.0)


def test_scaling_uses_training_rows_alone(spark):
    make = lambda *x: spark.createDataFrame([(Vectors.dense([v]), 0.0) for v in x], ["features", "y"])
    _, held = Y.scaled(make(1.0, 3.0), make(2.0))
    assert held.first().features[0] == 0.0


def test_ranges_by_training_rows_alone(spark):
    make = lambda *x: spark.createDataFrame([(Vectors.dense([v]), 0.0) for v in x], ["features", "y"])
    _, held = Y.ranged(make(1.0, 3.0), make(2.0, 4.0))
    assert [r.features[0] for r in held.collect()] == [0.5, 1.5]


def test_kernel_models_part_rings(spark):
    rng = np.random.default_rng(0)
    at, y = rng.uniform(0, 2 * np.pi, 400), np.arange(400) % 2
    x = np.stack([np.cos(at), np.sin(at)], 1) * np.where(y, 2.0, 0.5)[:, None]
    df = spark.createDataFrame([(i, Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x.tolist(), y, strict=True))], ["id", "features", "y"])
    train, held = df.where("id < 300"), df.where("id >= 300")
    assert Y.rbf_svm(train, held).where("y = prediction").count() >= 97
    a, b = np.array([1.0, 0.5]), np.array([0.3, -0.2])
    made = [np.array(r.features.toArray()) for r in Y.rbf(train, spark.createDataFrame([(Vectors.dense(a),), (Vectors.dense(b),)], ["features"]), width=20_000)[1].collect()]
    gamma = 1 / (2 * x[:300].var())
    assert abs(made[0] @ made[1] - np.exp(-gamma * ((a - b) ** 2).sum())) < 0.03
    best = Y.grid_search(train, "id", ([5], [1, 4], [2])).collect()
    assert [r.depth for r in best] == [4, 1] and best[0].accuracy > best[1].accuracy


def test_neighbours_without_queries(spark):
    rows = spark.createDataFrame([(1, [1.0], 0), (2, None, 1)], "id long, vector array<float>, label int")
    assert Y.neighbours(rows, rows.where("id = 9")).count() == 0
    assert Y.neighbours(rows, rows).count() == 0


def test_stream_of_messages(spark, tmp_path):
    v = B.Vocabulary({"subj": ["win"], "body": []}, {"subj": np.array([1.0]), "body": np.array([])}, np.array([]), np.array([]))
    bundle = R.Bundle(R.Model("cnb", v, np.array([[1.0]] * 3), np.zeros(3), [{"a": 1.0, "b": 0.0}] * 3), 0.6, 0.95)
    raw = [(i, "s", "f", b"From: a@b.example\nSubject: %s\n\nx\n" % w) for i, w in enumerate([b"win", b"hello", b"win"])] + [(9, "s", "f", b"")]
    spark.createDataFrame([(i, s, f, bytearray(r)) for i, s, f, r in raw], "seq long, source string, folder string, raw binary").withColumn("at", F.timestamp_seconds("seq")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, source string, folder string, raw binary, at timestamp").parquet(str(tmp_path / "in"))
    got = []
    scoring.score_stream(stream, bundle, lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "v")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.seq, r.verdict) for r in got} == {(0, "suspicious"), (1, "ham"), (2, "suspicious")}
    scoring.first_copies(stream, "at").writeStream.format("memory").queryName("c").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("c").count() == 3


def test_queries_do_the_whole_job(spark, monkeypatch):
    """The queries run the operators' default candidates, folds and models; trees have no bound of their own."""
    import inspect

    from postsieve.operators import study, training
    from postsieve.plans import catalog

    class Seen(Exception):
        pass

    seen = {}

    def select(*a, **k):
        seen.update(inspect.signature(training_select).bind(*a, **k).arguments)
        raise Seen

    training_select = training.select
    monkeypatch.setattr(catalog, "_framed", lambda s, d: None)
    monkeypatch.setattr(catalog, "_study", lambda s, d: (None, None))
    monkeypatch.setattr(catalog.R, "select", select)
    with pytest.raises(Seen):
        catalog.queries()["cv_select"](None, "")
    assert seen.get("candidates") in (None, training.CANDIDATES) and seen.get("folds", 5) == 5
    monkeypatch.setattr(catalog.Y, "scaled", lambda *rows: rows)
    monkeypatch.setattr(catalog.Y, "accuracies", lambda train, held, names=None: names)
    assert catalog.queries()["study_accuracy"](None, "") is None
    made = study.models()
    assert [made[n].getMaxDepth() for n in ("tree", "forest")] == [30, 30]


def test_neighbours_in_slices(spark, monkeypatch):
    """A task holds few distances at once, whatever the batch; ties, repeated ids and the query's own row are as in one piece."""
    rng = np.random.default_rng(5)
    rows = [(i % 60, [float(x) for x in rng.integers(0, 3, 2)], i % 4) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label long").coalesce(1)
    held, nearer = [], Y._nearer
    monkeypatch.setattr(Y, "CELLS", 60)
    whole = df.toPandas()
    q, at = np.array([r[1] for r in rows[:6]]), np.arange(6)
    want = nearer(None, whole, q, at, 5)
    got = None
    for a in range(0, 70, 10):
        got = nearer(got, whole.iloc[a : a + 10], q, at, 5)
        held.append(got[0].shape[1])
    assert max(held) == 5 and all((a == b).all() for a, b in zip(got[:2], want[:2], strict=True))
    found = {}
    for r in Y.neighbours(df, df.where("id < 6").dropDuplicates(["id"])).collect():
        found.setdefault(r.query, []).append((r.place, r.distance, r.id))
    vectors = {r.id: r.vector for r in df.where("id < 6").dropDuplicates(["id"]).collect()}
    for k, own in found.items():
        all_ = sorted((round(float(np.hypot(v[0] - vectors[k][0], v[1] - vectors[k][1])), 6), i) for i, v, _ in rows if i != k)[:5]
        assert [x[1:] for x in sorted(own)] == all_
