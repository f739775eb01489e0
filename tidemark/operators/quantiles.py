"""Exact quantiles of many columns at once, without gathering a column's values in one place.

The value of each wanted rank is sought in an open interval that narrows: approximate quantiles of the values inside, then
an exact count of the rows beside two of them. Once at most SMALL values are left, or the rank falls on a repeated value,
it is read off. Each round takes two aggregates of one row, whatever the number of columns and their distribution.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Approximate quantiles of a round, and values that are read off at once.
GRID, SMALL = 256, 5_000

Each = Callable[[Callable[[Column, Column, "int | None"], dict[str, Column]], Mapping[str, Sequence]], list[dict]]


@dataclass
class _Target:
    """A wanted rank: the open interval that holds it, the rows below that, the rows inside, and the values once found."""

    rank: int
    size: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None
    upto: int = 0
    after: float | None = None

    def narrow(self, p: float, lt: int, le: int) -> None:
        """Takes in that ``lt`` rows are below p, and ``le`` not above it."""
        if self.value is not None:
            return
        if lt <= self.rank < le:
            self.value, self.upto = p, le
        elif self.rank < lt and (self.high is None or p < self.high):
            self.high, self.size = p, lt - self.below
        elif self.rank >= le and (self.low is None or p > self.low):
            self.low, self.size, self.below = p, self.size - (le - self.below), le


def exact_quantiles(each: Each, inside: Callable[[Column, Column, int | None], Column], shares: Sequence[float]) -> list[list[float | None]]:
    """For every column its quantiles, interpolated between neighbouring values; None without values.

    ``each`` aggregates every column as :func:`rectify._each` does; ``inside`` is the value of a row, or NULL.
    """
    sizes = [row.get("n") or 0 for row in each(lambda x, y, i: {"n": F.count(inside(x, y, i))}, {})]
    targets = [[_Target(math.floor((n - 1) * q), n) for q in shares] for n in sizes]
    js = range(len(shares))
    tables: dict[str, list] = {}

    def given(name: str, i: int | None) -> Column:
        return F.col(name) if i is None else F.lit(tables[name][i]).cast("double")

    def within(x: Column, j: int, i: int | None) -> Column:
        low, high = given(f"low{j}", i), given(f"high{j}", i)
        return F.when((low.isNull() | (x > low)) & (high.isNull() | (x < high)), x)

    def intervals(open_only: bool) -> dict[str, list]:
        # An interval above infinity is empty: nothing is gathered for targets that need nothing.
        wanted = lambda t: t.size and t.value is None and (t.size > SMALL) == open_only
        low = {f"low{j}": [row[j].low if wanted(row[j]) else math.inf for row in targets] for j in js}
        return low | {f"high{j}": [row[j].high for row in targets] for j in js}

    while any(t.value is None and t.size > SMALL for row in targets for t in row):
        tables = intervals(True)
        grid = [k / GRID for k in range(GRID + 1)]
        found = each(lambda x, y, i: {f"p{j}": F.percentile_approx(within(inside(x, y, i), j, i), grid, 10_000) for j in js}, tables)
        tables = {f"{side}{j}": [math.inf] * len(targets) for side in "uv" for j in js}
        for i, row in enumerate(targets):
            for j, t in enumerate(row):
                if values := found[i].get(f"p{j}"):
                    k = (t.rank - t.below) * GRID // t.size
                    tables[f"u{j}"][i], tables[f"v{j}"][i] = values[max(0, k - 1)], values[min(GRID, k + 2)]

        def beside(x: Column, y: Column, i: int | None) -> dict[str, Column]:
            x = inside(x, y, i)
            counts = {}
            for j in js:
                for side in "uv":
                    p = given(f"{side}{j}", i)
                    counts |= {f"{side}{j}_lt": F.count_if(x < p), f"{side}{j}_le": F.count_if(x <= p)}
            return counts

        counts = each(beside, tables)
        for i, row in enumerate(targets):
            for j, t in enumerate(row):
                if t.value is None and t.size > SMALL:
                    for side in "uv":
                        t.narrow(tables[f"{side}{j}"][i], counts[i][f"{side}{j}_lt"], counts[i][f"{side}{j}_le"])

    if any(t.value is None and t.size for row in targets for t in row):
        tables = intervals(False)
        found = each(lambda x, y, i: {f"p{j}": F.sort_array(F.collect_list(within(inside(x, y, i), j, i))) for j in js}, tables)
        for i, row in enumerate(targets):
            for j, t in enumerate(row):
                if t.value is None and t.size:
                    values, at = found[i][f"p{j}"], t.rank - t.below
                    t.value, t.upto = values[at], t.below + at + 1
                    t.after = values[at + 1] if at + 1 < len(values) else t.high
    if any(t.value is not None and t.after is None and t.rank + 1 >= t.upto for row in targets for t in row):
        tables = {f"u{j}": [row[j].value if row[j].value is not None else math.inf for row in targets] for j in js}
        found = each(lambda x, y, i: {f"p{j}": F.min(F.when(inside(x, y, i) > given(f"u{j}", i), inside(x, y, i))) for j in js}, tables)
        for i, row in enumerate(targets):
            for j, t in enumerate(row):
                t.after = t.after if t.after is not None else found[i].get(f"p{j}")

    def interpolated(t: _Target, n: int, q: float) -> float | None:
        part = (n - 1) * q - t.rank
        if t.value is None or part == 0 or t.rank + 1 < t.upto or t.after is None:
            return t.value
        return t.value + part * (t.after - t.value)

    return [[interpolated(t, n, q) for t, q in zip(row, shares, strict=True)] for row, n in zip(targets, sizes, strict=True)]
