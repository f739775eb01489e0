import numpy as np
import pytest

from tidemark.operators.solvers import SOLVERS, Rows, accelerate, descend

X = np.array([[1.0 if c == "+" else -1.0 for c in row] for row in "++- +-- -++ --+ +++ ---".split()])
Y = np.array([int(c) for c in "110010"])


def objective(rows, w, b, lam):
    return rows.loss(w, b) + lam * np.abs(w).sum()


def test_small_design():
    rows = Rows.of(X, Y, np.ones(6))
    w, b = descend(rows, 0.12, tol=1e-7)
    assert objective(rows, w, b, 0.12) < objective(rows, np.zeros(3), 0.0, 0.12) - 1e-4
    assert rows.violation(w, b, 0.12) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_optimal_and_agreeing(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 5)) if seed % 2 else rng.choice([-1.0, 1.0], (60, 5))
    y = (x @ [1.5, -1, 0, 0, 0.3] + rng.normal(size=60) > 0).astype(int)
    counts = rng.integers(0, 5, 60)
    rows = Rows.of(x, y, counts)
    for lam in (0.3, 0.02, 0.001):
        a, b = descend(rows, lam, tol=1e-9, max_iter=20_000), accelerate(rows, lam, tol=1e-10, max_iter=50_000)
        assert rows.violation(*a, lam) < 1e-6
        assert objective(rows, *a, lam) == pytest.approx(objective(rows, *b, lam), abs=1e-7)
    many = Rows.of(np.repeat(x, counts, axis=0), np.repeat(y, counts), np.ones(counts.sum()))
    assert descend(many, 0.02, tol=1e-10)[0] == pytest.approx(descend(rows, 0.02, tol=1e-10)[0], abs=1e-8)


def test_one_class_and_warm_start():
    rows = Rows.of(X, np.ones(6), np.ones(6))
    w, b = descend(rows, 0.1)
    assert np.isfinite(b) and not w.any()
    rows = Rows.of(X, Y, np.ones(6))
    cold, warm = descend(rows, 0.05, tol=1e-9), descend(rows, 0.05, *descend(rows, 0.2), tol=1e-9)
    assert cold[0] == pytest.approx(warm[0], abs=1e-6)
    assert set(SOLVERS) == {"cd", "saga", "liblinear", "fista", "hybrid"}
