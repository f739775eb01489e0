"""Standardisation by population mean and deviation; NaN is left out of both, and a deviation of 0 counts as 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import clean, is_pm1, quoted
from tidemark.operators.base import Fitted, Learner, numeric_columns, require


def all_pm1(df: DataFrame, names: Sequence[str]) -> dict[str, bool]:
    """Whether every value of each column is -1 or 1, in one aggregate; such columns need no scaling."""
    row = df.agg(*(F.bool_and(F.coalesce(is_pm1(quoted(n)), F.lit(False))).alias(f"c{i}") for i, n in enumerate(names))).first() if names else ()
    return {n: bool(v) for n, v in zip(names, row, strict=True)}


class StandardScaler(Learner):
    """Learns mean and deviation of each feature."""

    PARAMS = {"featureCols": None, "labelCol": None, "with_mean": True, "with_std": True}

    def _fit(self, df: DataFrame) -> StandardScalerModel:
        v = self.values()
        names = list(v.featureCols) if v.featureCols else numeric_columns(df, [v.labelCol])
        require(df, names)
        aggs = [f(clean(quoted(n))) for n in names for f in (F.avg, F.stddev_pop)]
        row = df.agg(*(a.alias(f"c{i}") for i, a in enumerate(aggs))).first() if names else ()
        mean = [float(row[2 * i] or 0.0) if v.with_mean else 0.0 for i in range(len(names))]
        scale = [float(row[2 * i + 1] or 1.0) if v.with_std else 1.0 for i in range(len(names))]
        return StandardScalerModel(names, mean, scale)


class StandardScalerModel(Fitted):
    """Learned means and scales."""

    def __init__(self, features: Sequence[str], mean: Sequence[float], scale: Sequence[float]):
        super().__init__()
        self.features, self.mean, self.scale = list(features), list(mean), list(scale)

    def state(self) -> dict[str, object]:
        return {"features": self.features, "mean": self.mean, "scale": self.scale}

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, self.features)
        new = {n: ((quoted(n).cast("double") - m) / s).alias(n) for n, m, s in zip(self.features, self.mean, self.scale, strict=True)}
        return df.select(*(new.get(c, quoted(c)) for c in df.columns))
