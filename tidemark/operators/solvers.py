"""Solvers for the L1-penalised logistic loss on weighted rows: mean(log-loss) + lam * sum|w|, the intercept unpenalised.

Every distinct row with its label appears once with its count as weight, so the cost doesn't grow with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLIP = 40.0
_FLAT = 1e-12


def sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)), z clipped."""
    return 1 / (1 + np.exp(-np.clip(z, -CLIP, CLIP)))


@dataclass
class Rows:
    """Weighted rows: design x, labels y, and weights that sum to one; n is the count before."""

    x: np.ndarray
    y: np.ndarray
    share: np.ndarray
    n: float

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> Rows:
        """Without the rows of no weight."""
        used = counts > 0
        total = float(counts[used].sum())
        return cls(np.asfortranarray(x[used], np.float64), y[used].astype(np.float64), counts[used] / max(total, 1.0), total)

    def loss(self, w: np.ndarray, b: float) -> float:
        """The mean log-loss."""
        z = self.x @ w + b
        return float(self.share @ (np.logaddexp(0, z) - self.y * z))

    def start(self) -> float:
        """The log-odds of the label, clipped away from certainty."""
        p = min(max(float(self.share @ self.y), 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p)))

    def violation(self, w: np.ndarray, b: float, lam: float) -> float:
        """By how much the optimality conditions fail: 0 at the optimum."""
        gap = self.share * (sigmoid(self.x @ w + b) - self.y)
        g = gap @ self.x
        off = np.where(w == 0, np.maximum(np.abs(g) - lam, 0), np.abs(g + lam * np.sign(w)))
        return float(max(off.max(initial=0.0), abs(gap.sum())))


def _quadratic(g: np.ndarray, h: np.ndarray, w: np.ndarray, lam: np.ndarray, sweeps: int = 1000) -> np.ndarray:
    """The step d that minimises g d + d h d / 2 + sum(lam |w + d|) by cyclic coordinate descent on the curvature matrix."""
    d, slope, bend = np.zeros(len(g)), g.copy(), h.diagonal()
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(g)):
            now = w[j] + d[j]
            target = now - slope[j] / bend[j]
            move = np.sign(target) * max(abs(target) - lam[j] / bend[j], 0.0) - now
            if move:
                d[j] += move
                slope += move * h[j]
                largest = max(largest, abs(move) * np.sqrt(bend[j]))
        if largest <= 1e-12:
            break
    return d


def descend(rows: Rows, lam: float, w: np.ndarray | None = None, b: float | None = None, tol: float = 1e-4, max_iter: int = 2000) -> tuple[np.ndarray, float]:
    """Coordinate descent on the loss's quadratic model, which is renewed after each step; steps are halved until the loss falls.

    Only coordinates that are used or violate the optimality conditions take part, so the curvature matrix stays small.
    Ends when the conditions hold to a hundredth of ``tol`` and a tenth of the penalty, or when nothing improves any more.
    """
    x, y, share = rows.x, rows.y, rows.share
    w = np.zeros(x.shape[1]) if w is None else w.astype(np.float64).copy()
    b = rows.start() if b is None else float(b)
    z = x @ w + b
    value = float(share @ (np.logaddexp(0, z) - y * z)) + lam * float(np.abs(w).sum())
    for _ in range(max_iter):
        p = sigmoid(z)
        gap, curve = share * (p - y), share * p * (1 - p)
        g, g0 = gap @ x, float(gap.sum())
        off = np.where(w == 0, np.maximum(np.abs(g) - lam, 0), np.abs(g + lam * np.sign(w)))
        if max(off.max(initial=0.0), abs(g0)) <= min(tol / 100, lam / 10):
            break
        live = np.flatnonzero((w != 0) | (off > 0))
        design = np.column_stack([x[:, live], np.ones(len(y))])
        h = design.T @ (curve[:, None] * design)
        h[np.diag_indices_from(h)] += _FLAT + 1e-9 * h.diagonal()
        slope, weights = np.append(g[live], g0), np.append(w[live], b)
        penalty = np.append(np.full(len(live), lam), 0.0)
        d = _quadratic(slope, h, weights, penalty)
        promised = float(slope @ d + penalty @ (np.abs(weights + d) - np.abs(weights)))
        if promised >= 0:
            break
        moved, t = design @ d, 1.0
        for _ in range(60):
            zt, wt = z + t * moved, weights + t * d
            now = float(share @ (np.logaddexp(0, zt) - y * zt)) + lam * float(np.abs(wt[:-1]).sum())
            if now <= value + 1e-4 * t * promised:
                break
            t /= 2
        else:
            break
        z, value = zt, now
        w[live], b = wt[:-1], float(wt[-1])
    return w, b


def accelerate(rows: Rows, lam: float, w: np.ndarray | None = None, b: float | None = None, tol: float = 1e-4, max_iter: int = 4000) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient with backtracking and restarts."""
    x, y, share = rows.x, rows.y, rows.share
    u = np.append(np.zeros(x.shape[1]) if w is None else w, rows.start() if b is None else b).astype(np.float64)

    def smooth(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ v[:-1] + v[-1]
        gap = share * (sigmoid(z) - y)
        return float(share @ (np.logaddexp(0, z) - y * z)), np.append(gap @ x, gap.sum())

    def value(v: np.ndarray) -> float:
        return smooth(v)[0] + lam * float(np.abs(v[:-1]).sum())

    bound = 0.25 * (float((share[:, None] * x * x).sum()) + 1.0)
    step, ahead, momentum, last = 0.9 / bound * max(1.0, x.shape[1] / 4), u.copy(), 1.0, value(u)
    for _ in range(max(max_iter, 4000)):
        f, g = smooth(ahead)
        for _ in range(40):
            new = ahead - step * g
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * lam, 0)
            d = new - ahead
            if smooth(new)[0] <= f + g @ d + d @ d / (2 * step) + 1e-15:
                break
            step /= 2
        now = value(new)
        if (ahead - new) @ (new - u) > 0 or now > last:
            momentum, ahead = 1.0, u.copy()
            if now > last:
                f, g = smooth(ahead)
                new = ahead - step * g
                new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * lam, 0)
                now = value(new)
        moved = np.linalg.norm(new - u)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, momentum = new + (momentum - 1) / grown * (new - u), grown
        u, last = new, now
        if moved <= tol * step * bound * (1 + np.linalg.norm(u)):
            break
    return u[:-1], float(u[-1])


#: Solvers by name, for the path and for the final fit.
SOLVERS = {"cd": (descend, descend), "saga": (descend, descend), "liblinear": (descend, descend), "fista": (accelerate, accelerate), "hybrid": (accelerate, descend)}
