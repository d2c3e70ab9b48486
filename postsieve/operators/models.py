"""Text classifiers on Spark ML vectors, and explanations of their scores."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import blocks as B
from .tfidf import words_and_pairs

VOCABULARY = 200_000


def counter(rows: DataFrame, min_df: int = 2) -> CountVectorizerModel:
    """terms -> counts of the VOCABULARY most frequent terms in min_df rows, ties by term."""
    # tokens are counted in runs of rows: one row a term and run is shuffled, and none a token
    seen = B._seen(rows.select("terms", F.lit(0).alias("part")), "part", ("terms",)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    known = seen.where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(VOCABULARY)
    return CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=VOCABULARY).fit(known.select(F.array("term").alias("terms")))


def with_terms(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.withColumn("terms", words_and_pairs(F.lower(column)))


def classifier(algo: str, c: float = 1.0, alpha: float = 0.1, rows: int = 1):
    """logreg and svm (hinge loss) with an L2 penalty of 1 / (c * rows), or complement naive Bayes of VOCABULARY terms (`complement` has no bound)."""
    if algo == "logreg":
        return LogisticRegression(labelCol="y", weightCol="w", regParam=1 / (c * rows), standardization=False, maxIter=50)
    if algo == "svm":
        return LinearSVC(labelCol="y", weightCol="w", regParam=1 / (c * rows), standardization=False, maxIter=50)
    if algo == "cnb":
        return NaiveBayes(labelCol="y", weightCol="w", modelType="complement", smoothing=alpha)
    raise ValueError(f"unknown algorithm {algo!r}: logreg, svm or cnb")


def complement(rows: DataFrame, seen: Column, key: str, alpha: float = 0.1, min_df: int = 2) -> DataFrame:
    """key, y and score of the rows that are not `seen`, by complement Bayes of those that are, over every term in min_df of them.

    All in relations by term and by key: the vocabulary has no bound and stays off the driver.
    """
    dealt = rows.withColumn("seen", seen).repartition(key)
    counts = dealt.select(key, "y", "w", "seen", F.explode("terms").alias("term")).groupBy(key, "y", "w", "seen", "term").agg(F.count("*").alias("tf"))
    n = dealt.where("seen").agg(F.count("*").alias("n"))
    known = counts.where("seen").groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    known = known.join(F.broadcast(n)).select("term", F.log((1 + F.col("n")) / (1 + F.col("df"))).alias("idf"))
    x = counts.join(known, "term").withColumn("x", F.col("tf") * F.col("idf"))
    # parted by `seen` too, so that each use of x reads the rows that it needs
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key, "seen")))
    x = x.withColumn("x", F.try_divide(F.col("x"), length))
    # a class is told by what the other lacks
    of = lambda y: F.coalesce(F.sum(F.when(F.col("seen") & (F.col("y") == y), F.col("x") * F.col("w"))), F.lit(0.0))
    sums = x.groupBy("term").agg(of(1.0).alias("spam"), of(0.0).alias("ham"))
    whole = sums.agg((F.sum("spam") + alpha * F.count("*")).alias("all_spam"), (F.sum("ham") + alpha * F.count("*")).alias("all_ham"))
    share = lambda c: F.log((F.col(c) + alpha) / F.col(f"all_{c}"))
    weights = sums.join(F.broadcast(whole)).select("term", (share("spam") - share("ham")).alias("weight"))
    made = x.where("not seen").join(weights, "term").groupBy(key).agg(F.sum(F.col("x") * F.col("weight")).alias("score"))
    return dealt.where("not seen").select(key, "y").join(made, key, "left").select(key, "y", F.coalesce("score", F.lit(0.0)).alias("score"))


def fit(train: DataFrame, algo: str, **kwargs) -> PipelineModel:
    """terms -> counts -> inverse document frequencies -> rows of length one -> a classifier; counts are made once."""
    counts = counter(train)
    made = counts.transform(train).select("y", "w", "counts").persist(StorageLevel.DISK_ONLY)
    idf, norm = IDF(inputCol="counts", outputCol="idf").fit(made), Normalizer(inputCol="idf", outputCol="features")
    model = classifier(algo, rows=made.count(), **kwargs).fit(norm.transform(idf.transform(made)))
    made.unpersist()
    return PipelineModel(stages=[counts, idf, norm, model])


def scores(model: PipelineModel, rows: DataFrame, *keys: str) -> DataFrame:
    """keys, y and score, the margin of spam over ham."""
    raw = vector_to_array("rawPrediction")
    return model.transform(rows).select(*keys, "y", (raw[1] - raw[0]).alias("score"))


def explain(model: PipelineModel, rows: DataFrame, key: str, top_k: int = 8) -> DataFrame:
    """key, term, contribution: a row's features times the coefficients, largest by absolute value, then by term; from the row's own terms, whatever the size of the vocabulary."""
    counter, idf, *_, last = model.stages
    if not hasattr(last, "coefficients"):
        raise ValueError("only linear models explain themselves")
    # at most VOCABULARY rows
    known = rows.sparkSession.createDataFrame(list(zip(counter.vocabulary, map(float, idf.idf.toArray()), map(float, last.coefficients.toArray()), strict=True)), "term string, idf double, weight double")
    counts = rows.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    value = counts.join(F.broadcast(known), "term").withColumn("x", F.col("tf") * F.col("idf"))
    own = W.partitionBy(key)
    made = value.withColumn("contribution", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(own)) * F.col("weight")).where("weight <> 0")
    place = F.row_number().over(own.orderBy(F.desc(F.abs("contribution")), "term"))
    return made.select(key, "term", "contribution", place.alias("place")).where(F.col("place") <= top_k).drop("place")
