"""Logical polish: turn a fitted model into a vote of its k strongest features, all with the same magnitude.

For every k, what matters of the rows is how many of each class have each vote, so one aggregate gives a histogram
(k, vote, pos, n), and the intercepts, J and the choice of k follow from it exactly on the driver. Features that aren't
-1/+1 may have a vote of its own for each row; if the histogram is longer than HISTOGRAM_LIMIT, it stays distributed, and
the same rule is found by aggregates and running sums over it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import linear_score, positive, quoted
from tidemark.functions.expr import sigmoid as logistic
from tidemark.operators.base import one_of
from tidemark.operators.metrics import weighed, youden, youden_j
from tidemark.operators.running import running
from tidemark.operators.solvers import sigmoid

#: Rows of the histogram that come to the driver; with -1/+1 features, k features need k (k + 3) / 2.
HISTOGRAM_LIMIT = 500_000
#: Intercepts are sought from minus to plus this.
BRACKET = 40.0


@dataclass
class Policy:
    """How votes become a rule. scale: the weight of a vote. target: a J that must be reached; without it, J may fall by
    rel_tol of the model's. maxk: most features. k_policy: global or premin. intercept: mean, mofk or maxj."""

    scale: float = 10.0
    target: float | None = None
    maxk: int | None = None
    rel_tol: float = 0.01
    k_policy: str = "global"
    smooth_k: int = 3
    firstmin_drop: float = 0.05
    firstmin_frac: float = 0.5
    intercept: str = "mean"
    m: int | None = None
    m_frac: float | None = None

    def check(self) -> None:
        """Raises ValueError for names of policies that there aren't."""
        one_of("k_policy", self.k_policy, ["global", "premin"])
        one_of("intercept", self.intercept, ["mean", "mofk", "maxj"])


@dataclass
class Polished:
    """The rule, or the model as it was if the rule wasn't adopted, and how it was found."""

    coef: dict[str, float]
    intercept: float
    adopted: bool
    diag: dict[str, object] = field(default_factory=dict)

    def curve_table(self, spark: SparkSession) -> DataFrame:
        """Rows (k, feature, J, J_smooth, b)."""
        d = self.diag
        rows = [(i + 1, *r) for i, r in enumerate(zip(d["order"], d["J_k"], d["J_k_smooth"], d["b_k"], strict=True))]
        return spark.createDataFrame(rows, "k int, feature string, J double, J_smooth double, b double")

    def scales_table(self, spark: SparkSession) -> DataFrame:
        """Rows (scale, J): the best J of each scale that was asked for."""
        return spark.createDataFrame(list(zip(self.diag["Ks_plot"], self.diag["bestJ_vs_K"], strict=True)), "scale double, J double")


def strongest(coef: Mapping[str, float], maxk: int | None) -> list[tuple[str, int]]:
    """Features with their signs by falling weight, ties as in the mapping; zeros are left out."""
    used = [(n, w) for n, w in coef.items() if w != 0]
    used.sort(key=lambda x: -abs(x[1]))
    return [(n, 1 if w > 0 else -1) for n, w in used[: maxk if maxk and maxk > 0 else None]]


def vote_histogram(df: DataFrame, order: Sequence[tuple[str, int]], label: str, weight: str | None = None) -> DataFrame:
    """Rows (k, vote, pos, n): the rows and positive rows whose first k features have each signed sum."""
    votes = F.array(*((quoted(n).cast("double") * s) for n, s in order))
    rows = df.select(votes.alias("v"), positive(quoted(label)).cast("long").alias("y"), weighed(weight).alias("w"))
    patterns = rows.groupBy("v").agg(F.sum(F.col("y") * F.col("w")).alias("pos"), F.sum("w").alias("n"))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    sums = F.aggregate("v", start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")))["all"]
    return patterns.select("pos", "n", F.posexplode(sums).alias("k", "vote")).groupBy((F.col("k") + 1).alias("k"), "vote").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def _j(t: np.ndarray, b: float, pos: np.ndarray, n: np.ndarray) -> float:
    hit = t + b >= 0
    tp, fp = float(pos[hit].sum()), float((n - pos)[hit].sum())
    return youden(tp, float(pos.sum()) - tp, float((n - pos).sum()) - fp, fp)


def matched_intercept(moments: Callable[[float], tuple[float, float]], rate: float, start: float) -> tuple[float, bool]:
    """The intercept at which the mean probability is the rate, and whether the bracket of +-40 was too narrow for it.

    ``moments`` gives the means of p and of p (1 - p) at an intercept.
    """
    b = float(start)
    for _ in range(8):
        mean, bend = moments(b)
        if bend < 1e-12:
            break
        step = (mean - rate) / bend
        b -= step
        if abs(step) < 1e-8:
            return b, False
    b, half = 0.0, BRACKET / 2
    for _ in range(32):
        b += -half if moments(b)[0] > rate else half
        half /= 2
    return b, abs(b) > BRACKET - 1e-6


def mean_intercept(t: np.ndarray, pos: np.ndarray, n: np.ndarray, start: float) -> tuple[float, bool]:
    """:func:`matched_intercept` for the base rate of a histogram."""
    total = float(n.sum())

    def moments(b: float) -> tuple[float, float]:
        p = sigmoid(t + b)
        return float(n @ p) / total, float(n @ (p * (1 - p))) / total

    return matched_intercept(moments, float(pos.sum()) / total, start)


def mofk_intercept(k: int, scale: float, m: int | None, m_frac: float | None) -> float:
    """The intercept of "at least m of k": m itself, a share of k rounded up, or all."""
    if m is not None and m >= 1:
        m = min(int(m), k)
    elif m_frac is not None and 0 < m_frac <= 1:
        m = max(1, math.ceil(m_frac * k))
    else:
        m = k
    return -scale * (2 * m - k - 1)


def maxj_intercept(t: np.ndarray, pos: np.ndarray, n: np.ndarray) -> float:
    """The intercept of the lowest threshold with the highest J, among midpoints of neighbouring votes and both ends."""
    order = np.argsort(t)
    t, pos, neg = t[order], pos[order].astype(float), (n - pos)[order].astype(float)
    cuts = np.concatenate([[t[0] - 1e-9], (t[:-1] + t[1:]) / 2, [t[-1] + 1e-9]])
    above = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    tp, fp = above(pos), above(neg)
    j = (tp / pos.sum() if pos.sum() else 0.0) + ((neg.sum() - fp) / neg.sum() if neg.sum() else 0.0) - 1
    return 0.0 - float(cuts[int(np.argmax(j))])


def smoothed(values: Sequence[float], window: int) -> list[float]:
    """A centred moving average over an odd window of 3 or more; the ends, and series shorter than it, stay."""
    size = max(3, int(window)) | 1
    half = size // 2
    y = list(map(float, values))
    return [sum(y[i - half : i + half + 1]) / size if half <= i < len(y) - half and len(y) >= size else v for i, v in enumerate(y)]


def first_valley(values: Sequence[float], drop: float, frac: float) -> int:
    """The first inner k (from 1) that lies ``drop`` below the running maximum and not above its neighbours; else a share of all."""
    top = -math.inf
    for i, v in enumerate(values):
        top = max(top, v)
        if 0 < i < len(values) - 1 and top - v >= drop and v <= values[i - 1] and v <= values[i + 1]:
            return i + 1
    return max(1, math.ceil(frac * len(values)))


class LocalVotes:
    """The histogram of one k on the driver: votes, positive rows, rows."""

    def __init__(self, votes: np.ndarray, pos: np.ndarray, n: np.ndarray):
        self.votes, self.pos, self.n = votes, pos, n

    def mean(self, scale: float, start: float) -> tuple[float, bool]:
        """The intercept that matches the base rate."""
        return mean_intercept(scale * self.votes, self.pos, self.n, start)

    def maxj(self, scale: float) -> float:
        """The intercept of the threshold with the highest J."""
        return maxj_intercept(scale * self.votes, self.pos, self.n)

    def j(self, scale: float, b: float) -> float:
        """J at an intercept."""
        return _j(scale * self.votes, b, self.pos, self.n)


class SpreadVotes:
    """The histogram of one k as a table (vote, pos, n)."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.positives, self.rows = (float(x or 0) for x in table.agg(F.sum("pos"), F.sum("n")).first())

    def mean(self, scale: float, start: float) -> tuple[float, bool]:
        """The intercept that matches the base rate: an aggregate for each step."""

        def moments(b: float) -> tuple[float, float]:
            p = logistic(scale * F.col("vote") + b)
            mean, bend = self.table.agg(F.sum(F.col("n") * p), F.sum(F.col("n") * p * (1 - p))).first()
            return mean / self.rows, bend / self.rows

        return matched_intercept(moments, self.positives / self.rows, start)

    def maxj(self, scale: float) -> float:
        """The intercept of the threshold with the highest J, from running sums over the votes from above."""
        pos, neg = self.positives, self.rows - self.positives
        ran = running(self.table, "vote", {"tp": F.col("pos"), "all": F.col("n")}, descending=True)
        hit = F.col("tp") / pos if pos else F.lit(0.0)
        spared = (F.lit(neg) - (F.col("all") - F.col("tp"))) / neg if neg else F.lit(0.0)
        best = ran.select("vote", (hit + spared - 1).alias("j")).orderBy(F.desc("j"), "vote").first()
        below = self.table.filter(F.col("vote") < best["vote"]).agg(F.max("vote")).first()[0]
        at = scale * best["vote"]
        return 0.0 - (at - 1e-9 if below is None else (scale * below + at) / 2)

    def j(self, scale: float, b: float) -> float:
        """J at an intercept."""
        hit = scale * F.col("vote") + b >= 0
        total = lambda x: F.coalesce(F.sum(F.when(hit, x)), F.lit(0))
        tp, all_hits = self.table.agg(total(F.col("pos")), total(F.col("n"))).first()
        fp = all_hits - tp
        return youden(tp, self.positives - tp, self.rows - self.positives - fp, fp)


def scan(histogram: Mapping[int, LocalVotes | SpreadVotes], policy: Policy, j0: float, b0: float) -> tuple[list[float], list[float], int, float, bool]:
    """J and intercept by k, up to the first k that reaches a target; the best k and J; whether a bracket was too narrow."""
    js: list[float] = []
    bs: list[float] = []
    best_j, best_b, best_k, saturated = j0, b0, 0, False
    for k in sorted(histogram):
        votes = histogram[k]
        if policy.intercept == "mofk":
            b = mofk_intercept(k, policy.scale, policy.m, policy.m_frac)
        elif policy.intercept == "maxj":
            b = votes.maxj(policy.scale)
        else:
            b, narrow = votes.mean(policy.scale, best_b)
            saturated |= narrow
        j = votes.j(policy.scale, b)
        js.append(j)
        bs.append(b)
        if j > best_j:
            best_j, best_b, best_k = j, b, k
        if policy.target is not None and j >= policy.target:
            break
    return js, bs, best_k, best_j, saturated


@dataclass(frozen=True)
class Choice:
    """The k that a policy chooses from the J of each, and what it saw."""

    smooth: list[float]
    valley: int
    k: int


def choose_k(js: Sequence[float], policy: Policy) -> Choice:
    """The k with the highest J, of all or of those up to the first valley of the smoothed curve; the first of equal ones."""
    smooth = smoothed(js, policy.smooth_k)
    valley = first_valley(smooth, policy.firstmin_drop, policy.firstmin_frac)
    upto = min(max(1, valley), len(js)) if policy.k_policy == "premin" else len(js)
    return Choice(smooth, valley, int(np.argmax(js[:upto])) + 1)


def polish(
    df: DataFrame, coef: Mapping[str, float], intercept: float, label: str, policy: Policy, scales: Sequence[float] = (), weight: str | None = None
) -> Polished:
    """The vote rule for a model on ``df``; with ``scales``, the best J of each is reported besides.

    ``weight`` names a column with the number of rows that each row stands for.
    """
    policy.check()
    j0 = youden_j(df, label, (linear_score(coef, intercept) >= 0).cast("int"), weight)
    order = strongest(coef, policy.maxk)
    threshold = policy.target if policy.target is not None else j0 * (1 - policy.rel_tol)
    diag: dict[str, object] = {
        "J0": j0, "J_k": [], "J_k_smooth": [], "b_k": [], "order": [n for n, _ in order], "best_k_overall": 0, "best_J_overall": j0, "policy": policy.k_policy,
        "intercept_policy": policy.intercept, "k_first_min": None, "k_chosen": 0, "J_chosen": None, "adopted": False, "K_used": float(policy.scale), "adopt_threshold": threshold,
        "bracket_saturated": False, "Ks_plot": [], "bestJ_vs_K": [],
    }
    if not order:
        return Polished(dict(coef), intercept, False, diag)
    table = vote_histogram(df, order, label, weight).persist()
    try:
        rows = table.limit(HISTOGRAM_LIMIT + 1).collect()
        if len(rows) > HISTOGRAM_LIMIT:
            histogram = {k: SpreadVotes(table.filter(F.col("k") == k)) for k in range(1, len(order) + 1)}
        else:
            votes = np.array([(r.k, r.vote, r.pos, r.n) for r in rows], np.float64)
            votes = votes[np.lexsort((votes[:, 1], votes[:, 0]))]
            histogram = {int(k): LocalVotes(*votes[votes[:, 0] == k][:, 1:].T) for k in np.unique(votes[:, 0])}
        js, bs, best_k, best_j, saturated = scan(histogram, policy, j0, intercept)
        if scales:
            diag |= {"Ks_plot": list(scales), "bestJ_vs_K": [max(scan(histogram, replace(policy, scale=s, target=None), j0, intercept)[0]) for s in scales]}
    finally:
        table.unpersist()
    choice = choose_k(js, policy)
    k = choice.k
    adopted = js[k - 1] >= threshold
    diag |= {
        "J_k": js, "b_k": bs, "J_k_smooth": choice.smooth, "order": [n for n, _ in order[: len(js)]], "best_k_overall": best_k, "best_J_overall": best_j,
        "k_first_min": choice.valley, "k_chosen": k, "J_chosen": js[k - 1], "adopted": adopted, "bracket_saturated": saturated,
    }
    if not adopted:
        return Polished(dict(coef), intercept, False, diag)
    chosen = dict(order[:k])
    return Polished({n: policy.scale * chosen.get(n, 0) for n in coef}, bs[k - 1], True, diag)
