"""L1-penalised logistic regression whose penalty is chosen by k-fold log-loss.

Rows are compressed to distinct (features, label) patterns with a count for each fold: one aggregate. All folds and the
final fit then walk the whole penalty path on those patterns, one group each, so the cost of a path doesn't depend on
the number of rows. Beyond ``pattern_limit`` patterns, or CELLS of their numbers, MLlib fits the same patterns with the
counts as weights, each fit a distributed job; folds, objective and choice are the same either way.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.classification import LogisticRegressionModel as LRModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import ship
from tidemark.functions.expr import linear_score, log_loss, quoted, sigmoid
from tidemark.operators import folds
from tidemark.operators.base import Fitted, Learner, numeric_columns, one_of, require
from tidemark.operators.solvers import SOLVERS, Rows

log = logging.getLogger(__name__)

#: Distinct patterns that one group holds, and numbers in them: 64 MB.
PATTERN_LIMIT, CELLS = 200_000, 8_000_000
#: Numbers in a partition of a distributed fit.
PART_CELLS = 1_000_000


def grid(cs: int | Sequence[float]) -> list[float]:
    """The C values in rising order: a list, or so many from 1e-4 to 1e4."""
    values = np.logspace(-4, 4, cs).tolist() if isinstance(cs, int) else [float(c) for c in cs]
    if not values or min(values) <= 0:
        raise ValueError("C values must be positive")
    return sorted(values)


def choose(losses: Sequence[Mapping[str, object]], rule: str) -> int:
    """The path position that the rule picks from rows (fold, path_pos, loss): least mean, or first within one standard error of it."""
    table = pd.DataFrame([dict(r) for r in losses]).pivot(index="fold", columns="path_pos", values="loss")
    mean = table.mean(axis=0)
    if mean.isna().any() or table.isna().any(axis=None):
        raise ValueError("a validation loss is not a number")
    best = int(mean.to_numpy().argmin())
    if rule == "min":
        return int(mean.index[best])
    error = float(table.iloc[:, best].std(ddof=1) / np.sqrt(len(table))) if len(table) > 1 else 0.0
    return int(mean.index[int(np.flatnonzero(mean.to_numpy() <= mean.iloc[best] + error)[0])])


class L1LogisticCV(Learner):
    """Learns coefficients of features for a 0/1 label.

    Cs: values, or their number. cv: folds. foldCol: folds given as a column; else ranks of a seeded hash of rowIdCol,
    NumPy's permutation of rowIdCol (foldMode exact), or, without either, the rows of each pattern dealt out in turn.
    """

    PARAMS = {
        "featureCols": None, "labelCol": "label", "rowIdCol": None, "foldCol": None, "foldMode": "auto", "Cs": 10, "cv": 3, "solver": "cd", "tol": 1e-4,
        "max_iter": 2000, "random_state": 42, "cv_rule": "min", "zero_clamp": 0.0, "penalty": "l1", "scoring": "neg_log_loss", "pattern_limit": PATTERN_LIMIT,
    }

    def _check(self) -> None:
        v = self.values()
        one_of("solver", v.solver, list(SOLVERS))
        one_of("penalty", v.penalty, ["l1"])
        one_of("scoring", v.scoring, ["neg_log_loss"])
        one_of("cv_rule", v.cv_rule, ["min", "1se"])
        one_of("foldMode", v.foldMode, ["auto", "hash", "exact", "pattern"])
        if v.cv < 2:
            raise ValueError("cv must be at least 2")

    def _folded(self, df: DataFrame) -> DataFrame:
        """``df`` with the column __fold, or with none if patterns are dealt out."""
        v = self.values()
        if v.foldCol:
            return df.withColumn("__fold", quoted(v.foldCol).cast("int"))
        mode = v.foldMode if v.foldMode != "auto" else "hash" if v.rowIdCol else "pattern"
        if mode == "hash":
            return folds.hash_folds(df, [v.rowIdCol], v.cv, v.random_state, "__fold")
        if mode == "exact":
            return folds.exact_folds(df, v.rowIdCol, v.cv, v.random_state, "__fold")
        return df

    def _patterns(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Distinct (x, y) with the counts of all folds as an array."""
        v = self.values()
        x = F.array(*(quoted(n).cast("double") for n in names))
        rows = self._folded(df)
        counts = rows.select(x.alias("x"), quoted(v.labelCol).cast("int").alias("y"), *(["__fold"] if "__fold" in rows.columns else []))
        if "__fold" in rows.columns:
            return counts.groupBy("x", "y").agg(F.array(*(F.count_if(F.col("__fold") == f) for f in range(v.cv))).alias("counts"))
        total = counts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
        # Each pattern's rows go to the folds in turn, from a fold that its hash picks.
        first = F.pmod(F.xxhash64(F.lit(v.random_state), "x", "y"), F.lit(v.cv))
        each = F.transform(F.sequence(F.lit(0), F.lit(v.cv - 1)), lambda f: F.floor((F.col("n") + F.pmod(first - 1 - f, F.lit(v.cv))) / v.cv))
        return total.select("x", "y", each.alias("counts"))

    def _fit(self, df: DataFrame) -> L1LogisticModel:
        v = self.values()
        self._check()
        names = list(v.featureCols) if v.featureCols else numeric_columns(df, [v.labelCol, v.rowIdCol, v.foldCol])
        require(df, names)
        path, n_folds = grid(v.Cs), v.cv
        patterns = self._patterns(df, names).persist()
        try:
            seen = patterns.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)), F.count_if(F.col("y").isNull())).first()
            if not seen[3]:
                raise ValueError("no rows to fit")
            if seen[1] not in (0, 1) or seen[2] not in (0, 1) or seen[4]:
                raise ValueError("labels must be 0 or 1")
            if seen[0] > min(v.pattern_limit, CELLS // (len(names) + n_folds + 1)):
                return self._by_mllib(patterns, names, path, seen[0])
            paths, refit = SOLVERS[v.solver]
            tol, max_iter = v.tol, v.max_iter

            def walk(pdf: pd.DataFrame) -> pd.DataFrame:
                fold = int(pdf["fold"].iloc[0])
                # The order of rows fixes the order of sums, so equal tables give equal results.
                x, y, counts = np.array(pdf["x"].tolist(), np.float64), pdf["y"].to_numpy(), np.array(pdf["counts"].tolist(), np.float64)
                order = np.lexsort((y, *x.T))
                x, y, counts = x[order], y[order], counts[order]
                final = fold == n_folds
                held = counts[:, fold] if not final else np.zeros(len(counts))
                train, test = Rows.of(x, y, counts.sum(axis=1) - held), Rows.of(x, y, held)
                if not train.n:
                    raise ValueError("a fold holds all rows")
                out, w, b = [], None, None
                for pos, c in enumerate(path):
                    w, b = (refit if final else paths)(train, 1 / (c * train.n), w, b, tol, max_iter)
                    gap = train.violation(w, b, 1 / (c * train.n))
                    out.append((fold, pos, c, 0.0 if final else test.loss(w, b) if test.n else float("nan"), w.tolist(), b, gap))
                return pd.DataFrame(out, columns=["fold", "path_pos", "C", "loss", "coef", "intercept", "gap"])

            ship(df.sparkSession)
            spread = patterns.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds))))
            found = spread.groupBy("fold").applyInPandas(walk, "fold int, path_pos int, C double, loss double, coef array<double>, intercept double, gap double").collect()
        finally:
            patterns.unpersist()
        losses = [{"fold": r.fold, "path_pos": r.path_pos, "C": r.C, "loss": r.loss} for r in found if r.fold < n_folds]
        best = choose(losses, v.cv_rule)
        final = next(r for r in found if r.fold == n_folds and r.path_pos == best)
        if final.gap > max(tol, 1e-6):
            log.warning("the fit stopped with its optimality conditions off by %g: raise max_iter", final.gap)
        return self._model(names, list(final.coef), final.intercept, path, best, losses)

    def _model(self, names: Sequence[str], coef: list[float], intercept: float, path: list[float], best: int, losses: list[dict]) -> L1LogisticModel:
        v = self.values()
        coef = [0.0 if abs(w) <= v.zero_clamp else w for w in coef]
        return L1LogisticModel(dict(zip(names, coef, strict=True)), intercept, path[best], path, losses, v.solver, v.cv_rule, v.zero_clamp)

    def _by_mllib(self, patterns: DataFrame, names: Sequence[str], path: list[float], n_patterns: int) -> L1LogisticModel:
        """The same by distributed fits on the weighted patterns, in no more partitions than they fill."""
        v = self.values()
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
        held = lambda f: F.get("counts", F.lit(f)) if f is not None else F.lit(0).cast("long")
        data = patterns.select(array_to_vector("x").alias("__x"), F.col("y").cast("double").alias("__y"), "counts", total.alias("__n"))
        data = data.coalesce(1 + n_patterns * (len(names) + v.cv) // PART_CELLS).persist(StorageLevel.MEMORY_AND_DISK)

        def fit(held_out: int | None, c: float) -> tuple[dict[str, float], float, LRModel | None]:
            part = data.withColumn("__w", (F.col("__n") - held(held_out)).cast("double")).filter("__w > 0")
            n, positives = part.agg(F.sum("__w"), F.sum(F.col("__w") * F.col("__y"))).first()
            if not n:
                raise ValueError("a fold holds all rows")
            if positives in (0, n):
                p = min(max(positives / n, 1e-6), 1 - 1e-6)
                return dict.fromkeys(names, 0.0), float(np.log(p / (1 - p))), None
            lr = LogisticRegression(
                featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1 / (c * n), elasticNetParam=1.0, standardization=False,
                tol=min(v.tol, 1e-8), maxIter=v.max_iter, family="binomial",
            )
            m = lr.fit(part)
            return dict(zip(names, m.coefficients.toArray().tolist(), strict=True)), float(m.intercept), m

        try:
            losses = []
            for f in range(v.cv):
                test = data.withColumn("__w", held(f).cast("double")).filter("__w > 0")
                for pos, c in enumerate(path):
                    _, b, m = fit(f, c)
                    logits = m.transform(test).withColumn("z", vector_to_array("rawPrediction")[1]) if m else test.withColumn("z", F.lit(b))
                    total_loss, weight = logits.agg(F.sum(F.col("__w") * log_loss(F.col("__y"), F.col("z"))), F.sum("__w")).first()
                    losses.append({"fold": f, "path_pos": pos, "C": c, "loss": total_loss / weight if weight else float("nan")})
            best = choose(losses, v.cv_rule)
            coef, intercept, _ = fit(None, path[best])
        finally:
            data.unpersist()
        return self._model(names, [coef[n] for n in names], intercept, path, best, losses)


class L1LogisticModel(Fitted):
    """Learned coefficients."""

    def __init__(self, coef: Mapping[str, float], intercept: float, C: float, Cs: Sequence[float], losses: Sequence[Mapping[str, object]] = (), solver: str = "cd", cv_rule: str = "min", zero_clamp: float = 0.0):  # noqa: N803
        super().__init__()
        self.coef, self.intercept, self.C, self.Cs, self.losses = dict(coef), float(intercept), float(C), list(Cs), list(losses)
        self.solver, self.cv_rule, self.zero_clamp = solver, cv_rule, zero_clamp

    def state(self) -> dict[str, object]:
        names = ("coef", "intercept", "C", "Cs", "losses", "solver", "cv_rule", "zero_clamp")
        return {n: getattr(self, n) for n in names}

    def losses_table(self, spark: SparkSession) -> DataFrame:
        """Rows (fold, path_pos, C, val_loss)."""
        rows = [(r["fold"], r["path_pos"], r["C"], r["loss"]) for r in self.losses]
        return spark.createDataFrame(rows, "fold int, path_pos int, C double, val_loss double")

    def mean_losses(self) -> dict[float, float]:
        """The mean validation loss of each C."""
        return {c: float(np.mean([r["loss"] for r in self.losses if r["path_pos"] == i])) for i, c in enumerate(self.Cs)} if self.losses else {}

    def _transform(self, df: DataFrame) -> DataFrame:
        return scored(df, self.coef, self.intercept)


def scored(df: DataFrame, coef: Mapping[str, float], intercept: float, threshold: float = 0.5) -> DataFrame:
    """``df`` with p0, p1, decision (p1 - p0) and prediction (p1 >= threshold): a projection that reads features of weight only."""
    require(df, [n for n, w in coef.items() if w])
    p = sigmoid(linear_score(coef, intercept))
    return df.withColumn("p1", p).withColumns({"p0": 1 - F.col("p1"), "decision": 2 * F.col("p1") - 1, "prediction": (F.col("p1") >= threshold).cast("int")})
