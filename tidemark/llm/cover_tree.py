"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Vectors and queries are dealt into blocks of bounded size by hash. Each vector block is indexed by one cover tree, each
query block by another, and every pair of blocks is one group of work: its two trees are searched together. A pair of
nodes is pruned if no inner product between their points can beat the worst k-th score in the query node. With centres
q and p, covering radii s and r, the bound is <q, p> + |q| r + |p| s + s r. Each query block meets one vector block first,
and the k-th scores found there are where pruning starts in all others. Partial results of the vector blocks are merged
by score, ties to the smaller id.

Components x become floor(256 x), x as double, and scores are exact integers: float64 products are, as long as no sum can
reach 2**53; blocks with larger components use 80-bit numbers, exact up to 2**64. A score beyond the range of a long
becomes the nearest long.

Edge cases: a vector or id that is null, a vector with a null or non-finite component, or without components, takes no
part; vectors of different lengths have no inner product, so only those of one length meet; equal scores go to the
smaller vec_id; every row but the query's own is a candidate, so rows that share a vec_id are candidates, and queries, of
their own, and a repeated row finds its copy; queries with fewer than k candidates get all; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, checkpointed

#: Vectors and queries in a block, and points in a leaf.
VECTOR_BLOCK, QUERY_BLOCK, LEAF = 16_384, 32_768, 128
_EXACT = 1 << 53


class CoverTree:
    """A cover tree over integer vectors whose scales follow the data.

    Nesting: a node's centre is the centre of its first child. Covering: every point of a node lies within the node's
    scale of the centre of its child, the nearest one. Separation: the children's centres are at least that scale apart.
    The scale is where farthest-first centres end: at half the node's radius, or at as many centres as halve the leaves.
    Nodes are arrays: centre, radius, scale, norm of the centre, first and last point in ``order``, and children.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.scale: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._build(leaf)
        self.centres = points[self.centre]
        self.norms = np.sqrt((self.centres**2).sum(axis=1)).astype(np.float64)

    def _node(self, a: int, b: int, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.scale.append(0.0)
        self.span.append((a, b))
        self.children.append([])
        return len(self.centre) - 1

    def _build(self, leaf: int) -> None:
        points, order = self.points, self.order
        gap = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        todo = [(self._node(0, len(points), 0, float(gap.max())), gap)]
        while todo:
            node, gap = todo.pop()
            a, b = self.span[node]
            radius = self.radius[node]
            if b - a <= leaf or radius == 0:
                continue
            # Farthest-first: each next centre is the point that is farthest from all, so none is nearer than the scale.
            mine, near = order[a:b].copy(), radius / 2
            owner, nearest = np.full(b - a, -1), np.full(b - a, np.inf)
            centres: list[int] = []
            most = max(2, min(64, 2 * (b - a) // leaf))
            start = int(np.argmin(gap))
            while True:
                centres.append(int(mine[start]))
                d = np.sqrt(((points[mine] - points[mine[start]]) ** 2).sum(axis=1))
                closer = d < nearest
                owner[closer], nearest[closer] = len(centres) - 1, d[closer]
                start = int(np.argmax(nearest))
                if nearest[start] <= near or len(centres) >= most:
                    break
            self.scale[node] = float(nearest.max())
            sort = np.argsort(owner, kind="stable")
            order[a:b] = mine[sort]
            nearest, counts = nearest[sort], np.bincount(owner, minlength=len(centres))
            at = a
            for c, n in zip(centres, counts.tolist(), strict=True):
                if n:
                    own = nearest[at - a : at - a + n]
                    child = self._node(at, at + n, c, float(own.max()))
                    self.children[node].append(child)
                    todo.append((child, own))
                    at += n


def search(
    queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and scores for each query, by score and then id; missing ones have score -inf.

    ``own`` has the place of each query among the vectors, or -1; below a query's ``floor``, scores needn't be found.
    """
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    best_score = np.full((len(queries), k), -np.inf, queries.dtype)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    if not len(queries) or not len(vectors):
        return best_id, best_score
    q, v = CoverTree(queries), CoverTree(vectors)

    def bound(a: int, nodes: list[int]) -> np.ndarray:
        radius = np.array([v.radius[n] for n in nodes])
        dots = v.centres[nodes] @ q.centres[a]
        slack = q.norms[a] * radius + q.radius[a] * (v.norms[nodes] + radius)
        return dots + slack + 1e-9 * (1 + np.abs(dots) + slack)

    def base(a: int, b: int) -> None:
        rows, cols = q.order[slice(*q.span[a])], v.order[slice(*v.span[b])]
        scores = queries[rows] @ vectors[cols].T
        scores[own[rows][:, None] == cols[None]] = -np.inf
        score = np.concatenate([best_score[rows], scores], axis=1)
        name = np.concatenate([best_id[rows], np.broadcast_to(ids[cols], scores.shape)], axis=1)
        first = np.lexsort((name, -score), axis=1)[:, :k]
        best_score[rows], best_id[rows] = np.take_along_axis(score, first, 1), np.take_along_axis(name, first, 1)

    # Depth first, the most promising vector node first, so the worst k-th scores rise early.
    todo = [(0, 0, np.inf)]
    while todo:
        a, b, most = todo.pop()
        # Equal scores with smaller ids still count, so a bound that is met is searched.
        rows = q.order[slice(*q.span[a])]
        if most < np.maximum(best_score[rows, k - 1], floor[rows]).min():
            continue
        if not q.children[a] and not v.children[b]:
            base(a, b)
        elif q.children[a] and (not v.children[b] or q.radius[a] >= v.radius[b]):
            todo += [(c, b, float(bound(c, [b])[0])) for c in q.children[a]]
        else:
            nodes = v.children[b]
            most = bound(a, nodes)
            todo += [(a, nodes[i], float(most[i])) for i in np.argsort(most)]
    return best_id, best_score


def quantised(embedding: Column) -> Column:
    """floor(256 x) of every component; null unless all are finite numbers."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound & (F.size(embedding) > 0), F.transform(doubles, lambda x: F.floor(256 * x)))


def _numbers(v: pd.Series) -> np.ndarray:
    """Vectors of one length as a matrix in which products are exact."""
    longs = np.array(v.tolist(), np.int64)
    most = float(np.abs(longs.astype(np.float64)).max())
    return longs.astype(np.float64 if longs.shape[1] * most * most < _EXACT else np.longdouble)


def _found(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of a block of vectors for each query of a block."""
    rows = rows.sort_values("asks", kind="stable")
    asks, ids = rows["asks"].to_numpy(bool), rows["vec_id"].to_numpy(np.int64)
    values = _numbers(rows["v"])
    # Rows that are equal in id and vector are told apart by a number, the same in every pair of blocks.
    nth = rows.assign(key=rows["v"].map(tuple)).groupby(["asks", "vec_id", "key"]).cumcount().to_numpy()
    keys = list(zip(ids.tolist(), rows["h"].tolist(), nth.tolist(), strict=True))
    n = int((~asks).sum())
    place = {key: i for i, key in enumerate(keys[:n])}
    own = np.array([place.get(key, -1) for key in keys[n:]], np.int64)
    found, scores = search(values[asks], own, values[~asks], ids[~asks], k, rows["floor"].astype(np.float64).fillna(-np.inf).to_numpy()[asks])
    r, c = np.nonzero(np.isfinite(scores))
    top = np.iinfo(np.int64)
    score = np.clip(scores[r, c], values.dtype.type(top.min), values.dtype.type(top.max)) if values.dtype != np.float64 else scores[r, c]
    return pd.DataFrame({"query_id": ids[asks][r], "h": rows["h"].to_numpy(np.int64)[asks][r], "nth": nth[asks][r], "vec_id": found[r, c], "score": score.astype(np.int64)})


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) where ``queries`` holds: query_id, rank, vec_id, score."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), queries.alias("asks")).filter("vec_id is not null and v is not null")
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("size", F.size("v"))
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    v_blocks, q_blocks = -(-n_rows // VECTOR_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    place = F.xxhash64("vec_id", "h")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(place, F.lit(n)).cast("int")
    asked = rows.filter("asks").select(F.lit(True).alias("asks"), "vec_id", "v", "h", "size", own(q_blocks).alias("q"), F.lit(None).cast("double").alias("floor"))
    held = rows.select(F.lit(False).alias("asks"), "vec_id", "v", "h", "size", own(v_blocks).alias("b"), F.lit(None).cast("double").alias("floor"))

    def met(asked: DataFrame, held: DataFrame, pairs: int) -> DataFrame:
        groups = bounded(asked.unionByName(held)).repartition(pairs, "size", "q", "b").groupBy("size", "q", "b")
        return groups.applyInPandas(lambda pdf: _found(pdf, k), "query_id long, h long, nth long, vec_id long, score long")

    # Query block q meets vector block q mod v_blocks first.
    start = F.pmod("q", F.lit(v_blocks))
    parts = met(asked.withColumn("b", start), held.withColumn("q", every(q_blocks)).filter(F.col("b") == start), q_blocks)
    if v_blocks > 1:
        parts = checkpointed(parts)
        # Rows that are equal in id and vector have the same scores.
        floors = parts.groupBy("query_id", "h", "nth").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        floors = floors.groupBy(F.col("query_id").alias("vec_id"), "h").agg(F.min("least").cast("double").alias("least"))
        told = asked.join(floors, ["vec_id", "h"], "left").withColumn("floor", F.col("least")).drop("least").withColumn("b", every(v_blocks))
        rest = met(told.filter(F.col("b") != start), held.withColumn("q", every(q_blocks)).filter(F.col("b") != start), q_blocks * v_blocks)
        parts = parts.unionByName(rest)
    rank = F.row_number().over(Window.partitionBy("query_id", "h", "nth").orderBy(F.desc("score"), "vec_id")).cast("int")
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
