"""Critical ranges: learn [lo, hi] of each feature from the positive class, then mark values inside with +1, outside with -1.

Learning takes three aggregates of one row each: mean and deviation of the positives, the extremes of the positives inside
the deviation band (for quantiles, a few more), and the rows beyond each bound. Applying it is a projection without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import naming
from tidemark.functions.expr import clean, positive, quoted
from tidemark.operators.base import Fitted, Learner, numeric_columns, require
from tidemark.operators.quantiles import exact_quantiles

#: With more features than this, statistics are grouped by feature in long form instead of wide aggregates.
WIDE = 500


@dataclass(frozen=True)
class Limit:
    """The range of a feature; None is an open side."""

    group: str
    feature: str
    pos: int
    lo: float | None
    hi: float | None


def _each(
    df: DataFrame, features: Sequence[str], label: str, build: Callable[[Column, Column, int | None], dict[str, Column]],
    tables: Mapping[str, Sequence] | None = None, wide: int | None = None,
) -> list[dict]:
    """The aggregates that ``build`` makes of (value, is positive, index), for every feature in one pass."""
    y = positive(quoted(label))
    if len(features) <= (WIDE if wide is None else wide):
        wanted = [(i, name, e) for i, f in enumerate(features) for name, e in build(clean(quoted(f)), y, i).items()]
        row = df.agg(*(e.alias(f"c{k}") for k, (_, _, e) in enumerate(wanted))).first()
        out: list[dict] = [{} for _ in features]
        for k, (i, name, _) in enumerate(wanted):
            out[i][name] = row[k]
        return out
    long = df.select(y.alias("y"), F.posexplode(F.array(*(clean(quoted(f)) for f in features))).alias("i", "x"))
    if tables:
        rows = [(i, *values) for i, values in enumerate(zip(*tables.values(), strict=True))]
        schema = ", ".join(["i int", *(f"{t} double" for t in tables)])
        long = long.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), "i")
    found = long.groupBy("i").agg(*(e.alias(n) for n, e in build(F.col("x"), F.col("y"), None).items())).collect()
    by = {r["i"]: r.asDict() for r in found}
    return [by.get(i, {}) for i in range(len(features))]


def learn_limits(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    groups: Mapping[str, Sequence[str]],
    sdfilter: float | None = 3.0,
    snap: float | None = 0.001,
    quantile_bounds: tuple[float, float] | None = None,
    wide: int | None = None,
) -> list[Limit]:
    """Limits of the features, in order. Deviations are of the population; the band is strict on both sides.

    With more than ``wide`` features (by default WIDE), statistics are grouped in long form.
    """
    if quantile_bounds is not None and not 0 <= quantile_bounds[0] < quantile_bounds[1] <= 1:
        raise ValueError("quantile_bounds must rise within [0, 1]")
    low = high = [None] * len(features)
    if sdfilter is not None:
        stats = _each(df, features, label, lambda x, y, i: {"m": F.avg(F.when(y, x)), "s": F.stddev_pop(F.when(y, x))}, None, wide)
        band = [(None, None) if s.get("m") is None else (s["m"] - sdfilter * s["s"], s["m"] + sdfilter * s["s"]) for s in stats]
        low, high = [b[0] for b in band], [b[1] for b in band]

    def inside(x: Column, y: Column, i: int | None) -> Column:
        if sdfilter is not None:
            least, most = (F.col("low"), F.col("high")) if i is None else (F.lit(low[i]).cast("double"), F.lit(high[i]).cast("double"))
            # With an undefined deviation, the lower test alone is false, since NaN is above everything.
            y = y & (x > least) & (x < most)
        return F.when(y, x)

    band_tables = {"low": low, "high": high}
    if quantile_bounds is None:
        found = _each(df, features, label, lambda x, y, i: {"lo": F.min(inside(x, y, i)), "hi": F.max(inside(x, y, i))}, band_tables, wide)
        lo, hi = [f.get("lo") for f in found], [f.get("hi") for f in found]
    else:
        each = lambda build, tables: _each(df, features, label, build, {**band_tables, **tables}, wide)
        found = exact_quantiles(each, inside, quantile_bounds)
        lo, hi = [f[0] for f in found], [f[1] for f in found]
    if snap is not None and snap > 0:

        def tails(x: Column, y: Column, i: int | None) -> dict[str, Column]:
            a, b = (F.col("lo"), F.col("hi")) if i is None else (F.lit(lo[i]).cast("double"), F.lit(hi[i]).cast("double"))
            return {"below": F.count_if(x < a), "above": F.count_if(x > b), "n": F.count(F.lit(1))}

        counts = _each(df, features, label, tails, {"lo": lo, "hi": hi}, wide)
        for i, c in enumerate(counts):
            least = max(1, math.floor(snap * c.get("n", 0)))
            lo[i] = lo[i] if c.get("below", 0) >= least else None
            hi[i] = hi[i] if c.get("above", 0) >= least else None
    member = {f: g for g, fs in groups.items() for f in fs}
    return [Limit(member.get(f, naming.prefix(f)), f, i, lo[i], hi[i]) for i, f in enumerate(features)]


def rectified(x: Column, lo: float | None, hi: float | None) -> Column:
    """-1 outside the range, else +1; bounds, NaN, NULL and open sides count as inside."""
    outside = None
    for bound, test in ((lo, lambda v, b: v < b), (hi, lambda v, b: v > b)):
        if bound is not None:
            part = test(clean(x), F.lit(float(bound)))
            outside = part if outside is None else outside | part
    return (F.lit(1) if outside is None else F.when(outside, -1).otherwise(1)).cast("byte")


class Rectifier(Learner):
    """Learns critical ranges.

    labelCol: the positive class is all but 0. featureCols: columns to learn from, by default all numeric ones but the
    label and idCols. groups: features by group, by default by prefix. sdfilter: half the band's width in deviations.
    snap: a bound that fewer rows than this share lie beyond is opened. add_complements: negated copies after all columns.
    """

    PARAMS = {
        "labelCol": "label", "featureCols": None, "idCols": (), "groups": None, "sdfilter": 3.0, "snap": 0.001, "quantile_bounds": None,
        "add_complements": False, "complement_prefix": "n", "exclude_features": (), "wide": WIDE,
    }

    def _fit(self, df: DataFrame) -> RectifierModel:
        v = self.values()
        names = list(v.featureCols) if v.featureCols else numeric_columns(df, [v.labelCol, *v.idCols])
        names = [n for n in names if n not in set(map(str, v.exclude_features or ()))]
        require(df, names)
        naming.check_names(names)
        groups = dict(v.groups or naming.groups_by_prefix(names))
        features = list(dict.fromkeys(naming.ordered(groups, names)))
        limits = learn_limits(df, features, v.labelCol, groups, v.sdfilter, v.snap, v.quantile_bounds, v.wide)
        return RectifierModel(limits, v.complement_prefix if v.add_complements else None)


class RectifierModel(Fitted):
    """Learned ranges."""

    def __init__(self, limits: Sequence[Limit], complement_prefix: str | None = None):
        super().__init__()
        self.limits, self.complement_prefix = list(limits), complement_prefix

    def state(self) -> dict[str, object]:
        return {"limits": [[v.group, v.feature, v.pos, v.lo, v.hi] for v in self.limits], "complement_prefix": self.complement_prefix}

    @classmethod
    def from_state(cls, state: dict) -> RectifierModel:
        return cls([Limit(*v) for v in state["limits"]], state["complement_prefix"])

    @property
    def features(self) -> list[str]:
        """The features, in order."""
        return [limit.feature for limit in self.limits]

    @property
    def output_features(self) -> list[str]:
        """The columns that :meth:`transform` makes, in order."""
        return self.features + ([f"{self.complement_prefix}{f}" for f in self.features] if self.complement_prefix is not None else [])

    def limits_table(self, spark: SparkSession) -> DataFrame:
        """The limits as rows (group, feature, pos, lo, hi); NULL is an open side."""
        rows = [(v.group, v.feature, v.pos, v.lo, v.hi) for v in self.limits]
        return spark.createDataFrame(rows, "group string, feature string, pos int, lo double, hi double")

    def columns(self) -> list[Column]:
        """The rectified columns as expressions."""
        base = [rectified(quoted(v.feature), v.lo, v.hi) for v in self.limits]
        out = [c.alias(v.feature) for c, v in zip(base, self.limits, strict=True)]
        if self.complement_prefix is not None:
            out += [(-c).cast("byte").alias(f"{self.complement_prefix}{v.feature}") for c, v in zip(base, self.limits, strict=True)]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, self.features)
        new = set(self.output_features)
        return df.select(*(quoted(c) for c in df.columns if c not in new), *self.columns())
