"""Scalar expressions; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logits are clipped here before the exponential.
CLIP = 40.0


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(x: Column) -> Column:
    """As double, NaN as NULL: comparisons with NULL are never true, while NaN is above all numbers in Spark."""
    return F.nullif(x.cast("double"), F.lit(float("nan")))


def positive(label: Column) -> Column:
    """Whether a label counts as the positive class: anything but 0; NULL doesn't."""
    return F.coalesce(label.cast("double") != 0, F.lit(False))


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) with z clipped to +-40."""
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP))))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))


def soft_threshold(w: Column, t: Column | float) -> Column:
    """w moved towards 0 by t, and 0 once there."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.signum(w) * F.greatest(F.abs(w) - t, F.lit(0.0))


def log_loss(y: Column, z: Column) -> Column:
    """The logistic loss of a row with label y and logit z."""
    return softplus(z) - y * z


def linear_score(weights: Mapping[str, float], intercept: float) -> Column:
    """The logit; only columns with a weight are read."""
    terms = [F.lit(float(w)) * quoted(name).cast("double") for name, w in weights.items() if w != 0]
    score = F.lit(float(intercept))
    for term in terms:
        score = score + term
    return score


def is_pm1(x: Column) -> Column:
    """Whether a value is -1 or 1."""
    return x.isin(-1, 1)
