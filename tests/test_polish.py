import numpy as np
import pytest

from tidemark.operators import polish
from tidemark.operators.metrics import youden
from tidemark.operators.polish import Policy


def frame(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.choice([-1, 1], (n, 3))
    y = ((x[:, 0] + x[:, 1] - x[:, 2]) + rng.normal(size=n) > 0.5).astype(int)
    return x, y, spark.createDataFrame([(*map(int, r), int(v)) for r, v in zip(x, y, strict=True)], "a int, b int, c int, y int")


def j_of(y, pred):
    return youden((y & pred).sum(), (y & ~pred).sum(), (~y & ~pred).sum(), (~y & pred).sum())


@pytest.mark.parametrize("intercept", ["mean", "mofk", "maxj"])
@pytest.mark.parametrize("limit", [10**6, 0])
def test_against_rows(spark, monkeypatch, intercept, limit):
    """With the histogram on the driver, and distributed."""
    monkeypatch.setattr(polish, "HISTOGRAM_LIMIT", limit)
    x, y, df = frame(spark)
    coef, b = {"a": 0.7, "b": 0.9, "c": -0.2, "d": 0.0}, -0.1
    found = polish.polish(df.selectExpr("*", "0 AS d"), coef, b, "y", Policy(scale=3.0, intercept=intercept))
    d, truth = found.diag, y.astype(bool)
    assert d["order"] == ["b", "a", "c"]
    votes = np.cumsum(x[:, [1, 0, 2]] * [1, 1, -1], axis=1) * 3.0
    assert d["J0"] == pytest.approx(j_of(truth, x @ [0.7, 0.9, -0.2] + b >= 0))
    for k in range(3):
        assert d["J_k"][k] == pytest.approx(j_of(truth, votes[:, k] + d["b_k"][k] >= 0))
        if intercept == "mean":
            assert np.mean(1 / (1 + np.exp(-votes[:, k] - d["b_k"][k]))) == pytest.approx(y.mean(), abs=1e-6)
        if intercept == "mofk":
            assert d["b_k"][k] == -3.0 * (k + 1 - 1)
        if intercept == "maxj":
            every = np.append(np.unique(votes[:, k]), 99) - 0.5
            assert d["J_k"][k] == pytest.approx(max(j_of(truth, votes[:, k] >= t) for t in every))
    assert d["k_chosen"] == int(np.argmax(d["J_k"])) + 1
    assert found.curve_table(spark).count() == 3
    if found.adopted:
        assert set(found.coef.values()) <= {0.0, 3.0, -3.0}


def test_adoption(spark):
    _, _, df = frame(spark)
    coef = {"a": 0.7, "b": 0.9, "c": -0.2}
    assert not polish.polish(df, coef, 0.0, "y", Policy(target=1.1)).adopted
    stopped = polish.polish(df, coef, 0.0, "y", Policy(target=-1.0))
    assert stopped.adopted and stopped.diag["J_k"].__len__() == 1
    assert len(polish.polish(df, coef, 0.0, "y", Policy(maxk=2), scales=[1.0, 5.0]).diag["bestJ_vs_K"]) == 2
    none = polish.polish(df, dict.fromkeys(coef, 0.0), 0.3, "y", Policy())
    assert not none.adopted and none.coef == dict.fromkeys(coef, 0.0) and set(none.diag) == set(stopped.diag)


def test_intercepts_by_hand():
    assert polish.mofk_intercept(5, 10, None, None) == -40
    assert polish.mofk_intercept(5, 10, 9, None) == -40
    assert polish.mofk_intercept(5, 10, 2, None) == 20
    assert polish.mofk_intercept(5, 10, 0, 0.6) == 0
    t, pos, n = np.array([-100.0, 100.0]), np.array([0.0, 0.0]), np.array([1.0, 99.0])
    b, narrow = polish.mean_intercept(t, pos, n, 0.0)
    assert narrow and b == pytest.approx(-40, abs=1e-6)
    assert polish.maxj_intercept(np.array([-1.0, 1.0]), np.array([0, 5]), np.array([5, 5])) == 0


def test_smoothing_and_valley():
    assert polish.smoothed([1, 2], 5) == [1, 2]
    assert polish.smoothed([0, 3, 0, 3], 2) == [0, 1, 2, 3]
    assert polish.smoothed([5, 0, 10, 0, 5], 4) == [5, 0, 4, 0, 5]
    assert polish.first_valley([0.1, 0.5, 0.3, 0.6], 0.05, 0.5) == 3
    assert polish.first_valley([0.1, 0.2, 0.3, 0.4], 0.05, 0.6) == 3
    assert polish.first_valley([0.4], 0.05, 0.5) == 1


@pytest.mark.parametrize("intercept", ["mean", "maxj"])
def test_continuous_votes_distributed(spark, monkeypatch, intercept):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a - b + e > 0)) for (a, b), e in zip(x, rng.normal(size=400), strict=True)], "a double, b double, y int")
    both = []
    for limit in (10**6, 10):
        monkeypatch.setattr(polish, "HISTOGRAM_LIMIT", limit)
        both.append(polish.polish(df, {"a": 1.0, "b": -0.9}, 0.0, "y", Policy(scale=2.0, intercept=intercept), [1.0]).diag)
    for name in ("J_k", "b_k", "bestJ_vs_K"):
        assert both[0][name] == pytest.approx(both[1][name], abs=1e-6)


def test_policies_are_checked(spark):
    _, _, df = frame(spark)
    for bad in ({"intercept": "median"}, {"k_policy": "first"}):
        with pytest.raises(ValueError):
            polish.polish(df, {"a": 1.0}, 0.0, "y", Policy(**bad))
    swept = polish.polish(df, {"a": 1.0, "b": 1.0}, 0.0, "y", Policy(), [1.0, 5.0])
    assert [r.scale for r in swept.scales_table(spark).collect()] == [1.0, 5.0]
