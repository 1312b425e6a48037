"""Classifier metrics as aggregates and windows over (label, score) rows.

Curves first group rows by distinct score; running sums go range by range of the score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators.running import running


def confusion(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    y, p = F.col("label") == 1, F.col("score") >= threshold
    return rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def precision_recall_f1(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    c = confusion(rows, threshold)
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return c.select("tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-8)), 4).alias("f1"))


def _by_score(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    return running(per, "score", {"tp": F.col("p"), "fp": F.col("n")})


def cumulative_pr(rows: DataFrame) -> DataFrame:
    """score, tp, fp: how many of each kind stand at or above a score."""
    return _by_score(rows).select("score", "tp", "fp")


def roc_auc(rows: DataFrame) -> DataFrame:
    """The chance that a positive outranks a negative, ties half; null with one class only."""
    c = _by_score(rows)
    half = (F.col("fp") - F.col("n") / 2) * F.col("p")  # negatives above each positive, ties half
    out = c.agg(F.sum(half).alias("above"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(F.round(1 - F.col("above") / F.nullif(F.col("p") * F.col("n"), F.lit(0)), 6).alias("roc_auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    c = _by_score(rows)
    out = c.agg(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("p").alias("p"))
    return out.select(F.round(F.col("s") / F.nullif("p", F.lit(0)), 6).alias("average_precision"))


def pr_auc_trapezoid(rows: DataFrame, key: str = "id") -> DataFrame:
    """Trapezoids between row after row in order of score, then key; no anchor at recall 0."""
    y = (F.col("label") == 1).cast("long")
    total = F.coalesce(rows.agg(F.sum(y).alias("y")).scalar(), F.lit(0)) + 1e-10
    c = running(rows, "score", {"tp": y, "fp": 1 - y}, [F.col(key)])
    pr = lambda tp, fp: tp / (tp + fp + 1e-10)
    tp, fp = F.col("tp"), F.col("fp")
    step = y / total * (pr(tp, fp) + pr(tp - y, fp - (1 - y))) / 2  # the row before has this row's counts less its own
    return c.agg(F.round(F.sum(F.when(tp + fp > 1, step)), 6).alias("pr_auc"))


def log_loss_accuracy(rows: DataFrame) -> DataFrame:
    p = F.greatest(F.lit(1e-12), F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score")))
    return rows.agg(F.round(F.avg(-F.log(p)), 6).alias("log_loss"), F.round(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")), 6).alias("accuracy"))
