"""Youden's J, ROC AUC and the precision-recall curve over (label, prediction or score) columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import positive, quoted
from tidemark.operators.running import running


def youden(tp: float, fn: float, tn: float, fp: float) -> float:
    """Sensitivity + specificity - 1; a class without rows adds 0."""
    return (tp / (tp + fn) if tp + fn else 0.0) + (tn / (tn + fp) if tn + fp else 0.0) - 1.0


def weighed(weight: str | None) -> Column:
    """How many rows a row stands for: the column ``weight``, or one."""
    return F.lit(1).cast("long") if weight is None else quoted(weight).cast("long")


def confusion(df: DataFrame, label: str, pred: Column | str, weight: str | None = None) -> DataFrame:
    """One row (tp, fn, tn, fp)."""
    y, p = positive(quoted(label)), positive(quoted(pred) if isinstance(pred, str) else pred)
    total = lambda hit: F.coalesce(F.sum(F.when(hit, weighed(weight))), F.lit(0))
    return df.agg(total(y & p).alias("tp"), total(y & ~p).alias("fn"), total(~y & ~p).alias("tn"), total(~y & p).alias("fp"))


def youden_j(df: DataFrame, label: str, pred: Column | str, weight: str | None = None) -> float:
    """J of predictions."""
    return youden(*confusion(df, label, pred, weight).first())


def youden_table(df: DataFrame, label: str, pred: Column | str) -> DataFrame:
    """One row (tp, fn, tn, fp, j)."""
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return confusion(df, label, pred).withColumn("j", rate("tp", "fn") + rate("tn", "fp") - 1)


def measures(rows: Sequence[tuple[float, float, int, int]]) -> tuple[float, float | None]:
    """J and AUC (None unless both classes occur) of rows (label, score, prediction, number of rows) on the driver."""
    y, score, hit, n = (np.array([r[i] for r in rows], np.float64) for i in range(4))
    pos, hit = y != 0, hit != 0
    j = youden(*(float(n[part].sum()) for part in (pos & hit, pos & ~hit, ~pos & ~hit, ~pos & hit)))
    values, at = np.unique(score, return_inverse=True)
    p, q = np.bincount(at, n * (y == 1), len(values)), np.bincount(at, n * (y == 0), len(values))
    pairs = p.sum() * q.sum()
    return j, float(p @ (np.cumsum(q) - q / 2) / pairs) if pairs else None


def roc_auc_table(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """One row (auc, positives, negatives); auc is NULL unless both classes occur. Ties count half.

    The score histogram is summed first, so the running sums see every score once.
    """
    rows = df.select(quoted(label).cast("double").alias("y"), quoted(score).cast("double").alias("s"), weighed(weight).alias("w"))
    total = lambda y: F.sum(F.when(F.col("y") == y, F.col("w")).otherwise(0))
    hist = rows.groupBy("s").agg(total(1).alias("p"), total(0).alias("n"))
    below = running(hist.filter("s is not null"), "s", {"n_upto": F.col("n")})
    area = F.sum(F.col("p") * (F.col("n_upto") - F.col("n") / 2))
    total = below.agg(area.alias("area"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return total.select(F.when(pairs > 0, F.col("area") / pairs).alias("auc"), F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"))


def roc_auc(df: DataFrame, label: str, score: str) -> float:
    """Area under the ROC curve; raises ValueError unless the labels are 0 and 1 and both occur."""
    other = df.filter(~F.coalesce(quoted(label).cast("double").isin(0, 1), F.lit(False))).limit(1).count()
    area = roc_auc_table(df, label, score).first()["auc"]
    if other or area is None:
        raise ValueError("labels must be 0 and 1, and both must occur")
    return float(area)


def pr_curve(df: DataFrame, label: str, score: str, row_id: str) -> DataFrame:
    """Rows (pos, precision, recall, threshold): first (0, 1, 0, 1), then one for each row, highest score first, ties by row_id."""
    rows = df.select(F.when(positive(quoted(label)), 1).otherwise(0).cast("long").alias("y"), quoted(score).cast("double").alias("threshold"), quoted(row_id).alias("id")).filter("threshold is not null")
    total = rows.agg(F.sum("y").alias("all"))
    ran = running(rows, "threshold", {"pos": F.lit(1).cast("long"), "tp": F.col("y")}, ["id"], descending=True).crossJoin(F.broadcast(total))
    curve = ran.select("pos", (F.col("tp") / F.col("pos")).alias("precision"), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0).alias("recall"), "threshold")
    first = df.sparkSession.sql("SELECT 0L AS pos, 1D AS precision, 0D AS recall, 1D AS threshold")
    return first.unionByName(curve)


def accuracy(df: DataFrame, label: str, pred: str) -> float:
    """The share of rows whose prediction is the label."""
    return float(df.agg(F.avg((quoted(label).cast("double") == quoted(pred).cast("double")).cast("double"))).first()[0])
