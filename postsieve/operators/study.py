"""Models of the tabular study: nearest neighbours, trees, naive Bayes, logistic regression, and their reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import evaluate as V
from .forest import forest
from .quantiles import quantiles

QUERY_BLOCK = 2000
#: Distances that a task holds at once.
CELLS = 1 << 20
#: The deepest that Spark grows trees; stands for no bound.
DEPTH = 30
#: Trees, depth (30 stands for no bound), rows that a node needs to be split.
GRID = ([100, 200, 400], [30, 10, 20], [2, 5, 10])


def models(seed: int = 42) -> dict:
    return {
        "gaussian_nb": NaiveBayes(labelCol="y", modelType="gaussian"),
        "logistic": LogisticRegression(labelCol="y", maxIter=200),
        "tree": DecisionTreeClassifier(labelCol="y", maxDepth=DEPTH, seed=seed),
        "forest": RandomForestClassifier(labelCol="y", numTrees=100, maxDepth=DEPTH, seed=seed),
    }


def accuracies(train: DataFrame, held: DataFrame, names: list[str] | None = None) -> DataFrame:
    """model, accuracy on held, and roc_auc where held has the classes 0 and 1 alone; the best first.  Inputs have features and y."""
    two = held.where(~F.col("y").isin(0.0, 1.0)).isEmpty()
    found = []
    for name, m in models().items():
        if names and name not in names:
            continue
        if isinstance(m, (DecisionTreeClassifier, RandomForestClassifier)):
            found.append((name, *grown(m, train, held, lambda _, made: judged(made, F.col("probability"), two))))
            continue
        made = m.fit(train).transform(held).persist()
        found.append((name, *judged(made, vector_to_array("probability"), two)))
        made.unpersist()
    return train.sparkSession.createDataFrame(sorted(found, key=lambda r: (-(r[1] or 0.0), r[0])), "model string, accuracy double, roc_auc double")


def judged(made: DataFrame, probability: Column, two: bool) -> tuple[float | None, float | None]:
    """Accuracy, and the area under the ROC curve of two classes."""
    share = made.agg(F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 4)).first()[0]
    return share, V.roc_auc(made.select(F.col("y").cast("int").alias("y"), F.try_element_at(probability, F.lit(2)).alias("score"))).first()["roc_auc"] if two else None


def grown(m, train: DataFrame, held: DataFrame | None, use):
    """use(importances, predictions) of a tree or forest with the settings of m, grown by forest.py."""
    bagged = isinstance(m, RandomForestClassifier)
    return forest(train, held, m.getNumTrees() if bagged else 1, m.getMaxDepth(), m.getMinInstancesPerNode(), bagged, m.getSeed(), use)


def scaled(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Features centred and scaled by the training rows alone."""
    m = StandardScaler(inputCol="features", outputCol="_f", withMean=True).fit(train)
    return [m.transform(d).drop("features").withColumnRenamed("_f", "features") for d in (train, *others)]


def ranged(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Features mapped to 0..1 by the training rows' extremes alone."""
    m = MinMaxScaler(inputCol="features", outputCol="_f").fit(train)
    return [m.transform(d).drop("features").withColumnRenamed("_f", "features") for d in (train, *others)]


def rbf(train: DataFrame, *others: DataFrame, width: int = 512, seed: int = 42) -> list[DataFrame]:
    """features in which inner products approach exp(-g |a - b|^2): width random cosines, g = 1 / (features * their variance).

    A linear SVM on them stands for one with this kernel, whose exact form grows with the square of the rows.
    """
    s = train.agg(Summarizer.mean(F.col("features")).alias("m"), Summarizer.variance(F.col("features")).alias("v"), F.count("*").alias("n")).first()
    d = len(s["m"])
    # the variance over all entries: inside the columns and between their means
    spread = float(s["v"].toArray().mean() * max(s["n"] - 1, 1) / s["n"] + s["m"].toArray().var())
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(0, np.sqrt(2 / (d * (spread or 1.0))), (d, width)), rng.uniform(0, 2 * np.pi, width)

    @F.pandas_udf("array<double>")
    def cosines(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / width) * np.cos(np.array(x.tolist()).reshape(-1, d) @ turn + shift)))

    return [x.withColumn("features", array_to_vector(cosines(vector_to_array("features")))) for x in (train, *others)]


def rbf_svm(train: DataFrame, held: DataFrame, c: float = 1.0, **how) -> DataFrame:
    """held with prediction and rawPrediction; classes 0 and 1."""
    train, held = rbf(train, held, **how)
    train = train.persist()
    out = LinearSVC(labelCol="y", regParam=1 / (c * max(train.count(), 1)), maxIter=100).fit(train).transform(held)
    train.unpersist()
    return out


def grid_search(train: DataFrame, key: str, grid: tuple = GRID, folds: int = 3, seed: int = 42) -> DataFrame:
    """trees, depth, least, accuracy (mean over folds by hash of key) of forests, the best first.

    A node of fewer than `least` rows is not to be split; trees here bound the rows of a
    child, so half of it, rounded up, is that bound.
    """
    f = RandomForestClassifier(labelCol="y", seed=seed)
    sets = ParamGridBuilder().addGrid(f.numTrees, grid[0]).addGrid(f.maxDepth, grid[1]).addGrid(f.minInstancesPerNode, sorted({-(-x // 2) for x in grid[2]})).build()
    rows = train.withColumn("_fold", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)).cast("int"))
    cv = CrossValidator(estimator=f, estimatorParamMaps=sets, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), numFolds=folds, foldCol="_fold", parallelism=4)
    means = cv.fit(rows).avgMetrics
    least = {-(-x // 2): x for x in grid[2]}
    found = [(s[f.numTrees], s[f.maxDepth], least[s[f.minInstancesPerNode]], float(m)) for s, m in zip(sets, means, strict=True)]
    return train.sparkSession.createDataFrame(sorted(found, key=lambda r: (-r[3], r[:3])), "trees int, depth int, least int, accuracy double")


def importances(train: DataFrame, names: list[str], top: int | None = None) -> DataFrame:
    """feature, importance of a forest, the largest first; of equal ones the earlier column."""
    values = grown(models()["forest"], train, None, lambda found, _: found)
    found = sorted(zip(names, map(float, values), strict=True), key=lambda r: -r[1])
    return train.sparkSession.createDataFrame(found[:top], "feature string, importance double")


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, missing, mean, sd, lo, q1, q2, q3, hi per column; the quarters are exact and no task holds all values."""
    quarters, made = quantiles(rows, columns, [0.25, 0.5, 0.75]), []
    for c in columns:
        v = F.col(c).cast("double")
        between = [F.round(F.lit(q).cast("double"), 6) for q in quarters[c]]
        values = [F.lit(c), F.count(v), F.count("*") - F.count(v), F.round(F.avg(v), 6), F.round(F.stddev(v), 6), F.min(v), *between, F.max(v)]
        names = ["name", "n", "missing", "mean", "sd", "lo", "q1", "q2", "q3", "hi"]
        made.append(F.struct(*[x.alias(k) for x, k in zip(values, names, strict=True)]))
    return rows.agg(F.array(*made).alias("a")).select(F.inline("a"))


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, n over equal widths between the extremes; the last bin holds the largest value."""
    edge = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("long")
    # the edges are one row
    return rows.join(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame) -> DataFrame:
    """y, prediction, n."""
    return rows.groupBy("y", "prediction").agg(F.count("*").alias("n"))


def class_report(rows: DataFrame) -> DataFrame:
    """Per class: precision, recall, f1, support; a ratio over nothing is 0, as in the study's report."""
    cells = confusion(rows)
    true = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    both = true.join(said, "label", "full").select("label", p.alias("precision"), r.alias("recall"), F.coalesce("support", F.lit(0)).alias("support"))
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def whole_report(rows: DataFrame) -> DataFrame:
    """class_report with rows for accuracy (under f1), the plain and the support-weighted mean over classes."""
    each = class_report(rows)
    names = ("precision", "recall", "f1")
    n = F.sum("support").alias("support")
    macro = each.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], n)
    weighted = each.agg(F.lit("weighted avg").alias("label"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], n)
    none = F.lit(None).cast("double")
    hit = F.avg((F.col("y") == F.col("prediction")).cast("double"))
    right = rows.agg(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"), hit.alias("f1"), F.count("*").alias("support"))
    out = each.withColumn("label", F.col("label").cast("string"))
    for more in (macro, weighted, right):
        out = out.unionByName(more)
    return out


def _nearer(best: tuple | None, f: pd.DataFrame, q: np.ndarray, at: np.ndarray, k: int) -> tuple:
    """Of each query the k nearest of best and the rows f, as distances, ids, labels and whether it is the query itself, which counts as farthest."""
    x, ids = np.array(f["vector"].tolist(), dtype=float), f["id"].to_numpy()
    d = np.empty((len(at), len(f)))
    for i, one in enumerate(q):
        d[i] = np.round(np.sqrt(((x - one) ** 2).sum(axis=1)), 6)
    made = d, np.broadcast_to(ids, d.shape), np.broadcast_to(f["label"].to_numpy(), d.shape), ids[None] == at[:, None]
    if best is not None:
        made = tuple(np.concatenate(both, axis=1) for both in zip(best, made, strict=True))
    order = np.lexsort((made[1], made[0], made[3]), axis=1)[:, :k]
    return tuple(np.take_along_axis(part, order, axis=1) for part in made)


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, id, label, distance, place: the k nearest of rows (id, vector, label), a row with the query's id left out.

    Distances count to six places, ties go to the smaller id.  Queries come in blocks of
    QUERY_BLOCK; a task keeps k rows a query, so k times the partitions meet in a merge.
    Null vectors and labels take no part.
    """
    rows = rows.where("vector is not null and label is not null").select("id", "vector", "label")
    queries = queries.where("vector is not null").select("id", "vector")
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(n):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).toPandas()
        if block.empty:
            continue
        q, at = np.array(block["vector"].tolist(), dtype=float), block["id"].to_numpy()

        def nearest(frames: Iterator[pd.DataFrame], q=q, at=at) -> Iterator[pd.DataFrame]:
            best = None
            for f in frames:
                step = max(1, CELLS // max(len(at), q.shape[1]))
                for a in range(0, len(f), step):
                    best = _nearer(best, f.iloc[a : a + step], q, at, k)
            if best is not None:
                d, ids, labels, own = best
                row, col = np.nonzero(~own)
                yield pd.DataFrame({"query": at[row], "id": ids[row, col], "label": labels[row, col], "distance": d[row, col]})

        part = rows.mapInPandas(nearest, "query long, id long, label long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query long, id long, label long, distance double, place int")
    return out.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where(F.col("place") <= k)


def vote(near: DataFrame) -> DataFrame:
    """query, predicted: the most frequent label, the smallest of equals."""
    return near.groupBy("query", "label").agg(F.count("*").alias("n")).groupBy("query").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("predicted"))
