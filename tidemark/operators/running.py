"""Running sums and ranks over a whole table without one task for all of it.

Rows are cut into ranges of the order column at approximate quantiles; a window runs inside each range, and the sums of
the ranges before it, one row for each, are broadcast. A value that is several quantiles at once would make a long range:
its rows are cut by the quantiles of the first tie-breaking column, if that is a number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def running(df: DataFrame, by: str, sums: Mapping[str, Column], ties: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``df`` with inclusive running sums in the order of ``by`` (a numeric column without NULL), then of ``ties`` ascending."""
    grid = [i / RANGES for i in range(1, RANGES)]
    edges = df.agg(F.percentile_approx(by, grid, 10_000).alias("e")).first()["e"] or []
    kinds = dict(df.dtypes)
    literals = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in sorted(set(values)))).cast(f"array<{kind}>")
    cut = F.size(F.filter(literals(edges, kinds[by]), lambda e: e < F.col(by)))
    common, inner = [v for v, n in Counter(edges).items() if n > 1], F.lit(0)
    is_common = F.coalesce(F.col(by).isin(common), F.lit(False))
    if common and ties and kinds[ties[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        parts = df.agg(*(F.percentile_approx(F.when(F.col(by) == F.lit(v), F.col(ties[0])), grid, 10_000).alias(f"e{i}") for i, v in enumerate(common))).first()
        for v, part in zip(common, parts, strict=True):
            place = F.size(F.filter(literals(part or [], kinds[ties[0]]), lambda e: e < F.col(ties[0])))
            inner = F.when(F.col(by) == F.lit(v), place).otherwise(inner)
    # A common value ends a range, so as a range of its own it comes right after the rest of that.
    outer = 2 * cut + is_common.cast("int")
    ranged = df.withColumn("__range", (-outer if descending else outer) * RANGES + inner)
    order = [F.col(by).desc() if descending else F.col(by).asc(), *(F.col(t).asc() for t in ties)]
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    # At most RANGES * RANGES rows, so one task and a broadcast are enough.
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    out = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(offsets), "__range")
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *(f"__{n}" for n in sums))


def ranked(df: DataFrame, by: str, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with the rank of each row from 0, in the order of ``by`` and ``ties``."""
    return running(df, by, {out: F.lit(1).cast("long")}, ties).withColumn(out, F.col(out) - 1)
