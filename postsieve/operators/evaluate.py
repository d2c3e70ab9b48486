"""Thresholds under a false-positive budget, confusion metrics, ranking metrics and curves.

Inputs are rows (y 0/1, score).  Rankings work on distinct scores, counted first, with
running sums in two levels (ranks.py), so no single task sees all scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import running


class NoHam(ValueError):
    """A threshold needs at least one ham row."""


def threshold_for_fpr(rows: DataFrame, target: float, mask: Column | None = None) -> float:
    """The smallest cut that at most floor(target * ham) ham rows reach."""
    ham = rows.where("y = 0").where(mask if mask is not None else F.lit(True))
    n = ham.count()
    if n == 0:
        raise NoHam("no ham rows")
    allowed = math.floor(target * n)
    if allowed >= n:
        return float(ham.agg(F.min("score")).first()[0])
    # the highest score that more than allowed rows reach
    return math.nextafter(ranked(ham).where(F.col("fp") > allowed).agg(F.max("score")).first()[0], math.inf)


def metrics(y: Column, hit: Column) -> list[Column]:
    """tp, fp, tn, fn and ratios; a ratio over nothing is NULL, f1 also where precision or recall is 0."""
    count = lambda c: F.count_if(c)
    tp, fp, tn, fn = count((y == 1) & hit), count((y == 0) & hit), count((y == 0) & ~hit), count((y == 1) & ~hit)
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r))
    return [tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), F.try_divide(fp, fp + tn).alias("fpr"), F.try_divide(tp + tn, F.count("*")).alias("accuracy")]


def metrics_at(rows: DataFrame, cut: float) -> DataFrame:
    return rows.agg(*metrics(F.col("y"), F.col("score") >= cut))


def report_by_source(rows: DataFrame, cut: float) -> DataFrame:
    """The metrics per source and for all (source NULL, level 1)."""
    level = F.grouping_id().cast("long").alias("level")
    return rows.rollup("source").agg(*metrics(F.col("y"), F.col("score") >= cut), level)


def recall_at_fpr(rows: DataFrame, target: float, mask: Column | None = None) -> DataFrame:
    cut = threshold_for_fpr(rows, target, mask)
    return rows.where("y = 1").agg(F.avg((F.col("score") >= cut).cast("double")).alias("recall"))


def ranked(rows: DataFrame) -> DataFrame:
    """score, p, n (rows of either class with it), tp, fp (rows at or above), place (1 for the highest), pos, neg (all rows of a class)."""
    h = rows.groupBy("score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("n"))
    h = running(h, [-F.col("score")], {"tp": F.col("p"), "fp": F.col("n"), "place": F.lit(1)})
    return h.select("score", "p", "n", "tp", "fp", "place", F.col("all_tp").alias("pos"), F.col("all_fp").alias("neg"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """roc_auc, pr_auc (average precision); NULL unless both classes are there."""
    r = ranked(rows)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / (F.first("pos").cast("double") * F.first("neg"))
    precision = F.sum(F.col("p").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("pos")
    both = (F.first("pos") > 0) & (F.first("neg") > 0)
    return r.agg(F.when(both, area).alias("roc_auc"), F.when(both, precision).alias("pr_auc"))


def rankings(rows: DataFrame, by: list[str], target: float, judged: Column) -> DataFrame:
    """by, pos, neg, recall, pr_auc of every group of rows in one pass; the budget of recall counts judged ham alone.

    recall is that of recall_at_fpr: the spam above the highest score which more than floor(target * ham) judged ham reach.
    """
    ham = 1 - F.col("y")
    h = rows.groupBy(*by, "score").agg(F.sum("y").cast("long").alias("p"), F.sum(ham).cast("long").alias("n"), F.sum(F.when(judged, ham).otherwise(0)).cast("long").alias("j"))
    # ordered by group first, so that a range of the order holds few groups and a large group has many ranges
    h = running(h, [*map(F.col, by), -F.col("score")], {"tp": F.col("p"), "fp": F.col("n"), "jp": F.col("j")}, within=by)
    allowed = F.floor(F.lit(float(target)) * F.col("all_jp"))
    above = F.when(allowed >= F.col("all_jp"), F.col("jp") - F.col("j") < F.col("all_jp")).otherwise(F.col("jp") <= allowed)
    pos, neg = F.first("all_tp"), F.first("all_fp")
    precision = F.sum(F.col("p").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))) / pos
    return h.groupBy(*by).agg(pos.alias("pos"), neg.alias("neg"), F.try_divide(F.sum(F.when(above, F.col("p")).otherwise(0)), pos).alias("recall"), F.when((pos > 0) & (neg > 0), precision).alias("pr_auc"))


def curve(rows: DataFrame, kind: str, points: int = 200) -> DataFrame:
    """x, y, score of every step-th distinct score, step = max(1, scores div points), and the end above all scores (score NULL): (0, 0) of roc, (0, 1) of pr."""
    r = ranked(rows)
    total = r.agg(F.count("*").alias("scores"))
    r = r.join(F.broadcast(total)).where((F.col("place") - 1) % F.greatest(F.lit(1), F.floor(F.col("scores") / points)) == 0)
    recall = F.col("tp") / F.col("pos")
    y = (F.col("fp") / F.col("neg"), recall) if kind == "roc" else (recall, F.col("tp") / (F.col("tp") + F.col("fp")))
    end = total.where("scores > 0").select(F.lit(0.0).alias("x"), F.lit(0.0 if kind == "roc" else 1.0).alias("y"), F.lit(None).cast("double").alias("score"))
    return r.select(y[0].alias("x"), y[1].alias("y"), "score").unionByName(end)
