import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cover_tree as C


def brute(v, ids, q, k):
    """For the place of each query, the best other rows of its length; numbers are Python's."""
    out = {}
    for i in np.flatnonzero(q).tolist():
        scores = [(-sum(a * b for a, b in zip(v[i], v[j], strict=True)), int(ids[j])) for j in range(len(v)) if j != i and len(v[j]) == len(v[i])]
        out[i] = [(n, -s) for s, n in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("kind,n,d", [("normal", 700, 8), ("ties", 500, 3), ("equal", 300, 4), ("few", 3, 5), ("one", 1, 2)])
def test_like_brute_force(kind, n, d):
    rng = np.random.default_rng(n)
    v = np.floor(256 * rng.normal(size=(n, d))) if kind == "normal" else rng.integers(-2, 3, (n, d)).astype(float) if kind != "equal" else np.ones((n, d))
    ids, q = rng.permutation(n * 3)[:n], np.arange(n) % 7 == 0
    found, scores = C.search(v[q], np.flatnonzero(q), v, ids, 5)
    got = {int(i): [(int(a), int(b)) for a, b in zip(f, s, strict=True) if np.isfinite(b)] for i, f, s in zip(np.flatnonzero(q), found, scores, strict=True)}
    assert got == brute(v.astype(int).tolist(), ids, q, 5)


def test_tree_invariants():
    v = np.random.default_rng(1).integers(-500, 500, (900, 6)).astype(float)
    t = C.CoverTree(v, leaf=20)
    assert sorted(t.order.tolist()) == list(range(900))
    far = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
    for node, (a, b) in enumerate(t.span):
        assert far(v[t.order[a:b]], t.centres[node]).max() <= t.radius[node] + 1e-9
        children = t.children[node]
        if children:
            assert t.centre[children[0]] == t.centre[node]
            assert max(t.radius[c] for c in children) <= t.scale[node] + 1e-9 <= t.radius[node] + 2e-9
            centres = t.centres[children]
            assert min(far(centres[i], centres[j]) for i in range(len(centres)) for j in range(i)) >= t.scale[node] - 1e-9
            assert sorted(t.span[c] for c in children)[0][0] == a and sum(t.span[c][1] - t.span[c][0] for c in children) == b - a


def answers(spark, rows, asks, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = C.top_k(df, asks, k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def wanted(rows, asks, k=5):
    sound = [r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [[int(np.floor(256 * x)) for x in r[1]] for r in sound]
    found = brute(whole, [r[0] for r in sound], np.array([asks(r[0]) for r in sound]), k)
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    return sorted((sound[i][0], n + 1, j, clip(s)) for i, best in found.items() for n, (j, s) in enumerate(best))


@pytest.mark.parametrize("blocks", [(40, 7), (16_384, 32_768)])
def test_table(spark, monkeypatch, blocks):
    monkeypatch.setattr(C, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(C, "QUERY_BLOCK", blocks[1])
    v = np.random.default_rng(5).normal(size=(200, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in r], i) for i, r in enumerate(v)]
    rows += [(500, None, 0), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (502, [float("nan")] * 6, 0), (505, [float("inf")] * 6, 0), (None, [0.0] * 6, 0), (510, [], 0)]
    # Repeated rows, an id with two vectors, other lengths, large components.
    rows += [(0, rows[0][1], 9), (0, rows[0][1], 8), (5, rows[6][1], 0), (7, rows[7][1], 1), (600, [1.0, 2.0], 0), (601, [2.0, 1.0], 0), (605, [0.5], 0)]
    rows += [(700, [5000.0, 1.0, 0.0, 0.0, 3.0, -1.0], 0), (701, [-1e6, 2.0, 0.0, 1.0, 3.0, -1.0], 0)]
    assert answers(spark, rows, F.col("vec_id") % 5 == 0) == wanted(rows, lambda i: i % 5 == 0)


def test_small_tables(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(4)]
    assert answers(spark, rows[:3], F.col("vec_id") == 0) == wanted(rows[:3], lambda i: i == 0)
    assert answers(spark, [(0, [1.0], 0), (1, [2.0], 0), (1, [2.0], 0)], F.col("vec_id") == 0) == [(0, 1, 1, 131072), (0, 2, 1, 131072)]
    assert answers(spark, [], F.col("vec_id") == 0) == []


def test_scores_out_of_range(spark):
    rows = [(0, [1e15, 1.0], 0), (1, [1e15, 0.0], 0), (2, [-1e15, 0.0], 0), (3, [0.0, 1.0], 0)]
    assert answers(spark, rows, F.col("vec_id") == 0) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 65536), (0, 3, 2, -(2**63))]
