"""Nearest neighbours by inner product with stable projections and kd-trees.

Vectors get one more coordinate, ``sqrt(M^2 - |x|^2)`` with M the largest norm
(0 for a query), after which the largest inner product is the smallest
Euclidean distance.  Gaussian projections to ``DIMS`` dimensions are 2-stable:
the squared projected distance over the squared distance follows a chi-square
law with ``DIMS`` degrees of freedom.  Every block of rows keeps a kd-tree of
its projected points.  A query takes the leaves of a block in the order of
their projected distance, verifies the vectors in them exactly, and stops when
the chi-square test holds: a vector nearer than the k-th found so far would
have been projected beyond the next leaf only with probability ``MISS``.

Rows are dealt to blocks of about ``BLOCK_ROWS`` by a hash of their id, and
queries to groups of about ``QUERY_ROWS``; each pair of a block and a group is
one task's work and returns k rows per query, so neither grows with the
table.  A vector that occurs in many rows is one point of a block with its
smallest ids.  Scores are the double-precision inner products of the original
vectors, added in one fixed order, so equal vectors tie exactly and ties go
to the smaller id.

Defined cases: vectors that are null, empty or zero, or hold null or
non-finite components, take no part, and neither do rows without an id;
vectors are only compared with vectors of equal length; rows that repeat an
id are candidates of their own, but never of a query with that id; fewer
candidates than k give fewer rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from grantflow.llm.store import staged

DIMS = 8
LEAF = 32
BLOCK_ROWS = 8_192
QUERY_ROWS = 4_096
#: Chance of missing a single true neighbour that the stopping test allows.
MISS = 0.05
SEED = 7


def chi_square_quantile(dims: int, upper_tail: float) -> float:
    """x with P(chi-square with even ``dims`` > x) = ``upper_tail``, by
    bisection of the closed form exp(-x/2) * sum (x/2)^j / j!."""
    if dims % 2:
        raise ValueError("the closed form needs an even number of dimensions")

    def tail(x: float) -> float:
        term = total = 1.0
        for j in range(1, dims // 2):
            term *= x / 2 / j
            total += term
        return float(np.exp(-x / 2) * total)

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > upper_tail else (lo, mid)
    return hi


class KdTree:
    """Points in leaves of at most ``LEAF``, with each leaf's bounding box."""

    def __init__(self, points: np.ndarray):
        groups = [np.arange(len(points))]
        leaves: list[np.ndarray] = []
        while groups:
            rows = groups.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            half = len(rows) // 2
            rows = rows[np.argpartition(own[:, axis], half)]
            groups += [rows[:half], rows[half:]]
        self.order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.ends = np.cumsum([len(x) for x in leaves])
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of every query to every leaf's box."""
        out = np.zeros((len(queries), len(self.ends)))
        for d in range(queries.shape[1]):
            q = queries[:, d, None]
            gap = np.maximum(np.maximum(self.low[:, d] - q, q - self.high[:, d]), 0)
            out += gap * gap
        return out


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in one fixed order of additions."""
    return (rows * query).sum(axis=1)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 k: int, miss: float = MISS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, candidate ids, scores) of the k nearest found per query."""
    points, where = np.unique(vectors, axis=0, return_inverse=True)
    where = where.reshape(-1)
    by = np.lexsort((ids, where))
    first = np.searchsorted(where[by], np.arange(len(points) + 1))
    norms = (points * points).sum(1)
    top = norms.max()
    lifted = np.concatenate([points, np.sqrt(np.maximum(top - norms, 0))[:, None]], 1)
    axes = np.random.default_rng(SEED).standard_normal((lifted.shape[1], DIMS))
    tree = KdTree(lifted @ axes)
    held = points[tree.order]
    start = np.append(0, tree.ends)
    stop_at = chi_square_quantile(DIMS, miss)
    # Candidates of a point are its k + 1 smallest ids: the query's own may be one.
    copies = np.minimum(np.diff(first), k + 1)
    far = tree.distances(queries @ axes[:-1])
    order = np.argsort(far, axis=1, kind="stable")
    step = max(1, -(-2 * k // LEAF))
    for q in range(len(queries)):
        query, own = queries[q], query_ids[q]
        size = float(query @ query)
        best = np.zeros(0)
        seen_points: list[np.ndarray] = []
        seen_scores: list[np.ndarray] = []
        leaves, at = order[q], 0
        while at < len(leaves):
            if len(best) > k:
                # |x - q|^2 of the k-th nearest, in the lifted space.
                kth = max(top + size - 2 * best[k], 0.0)
                if far[q, leaves[at]] > stop_at * kth:
                    break
            rows = np.concatenate([np.arange(start[x], start[x + 1]) for x in leaves[at:at + step].tolist()])
            at += step
            scores = held[rows] @ query
            seen_points.append(tree.order[rows])
            seen_scores.append(scores)
            best = np.concatenate([best, np.repeat(scores, copies[tree.order[rows]])])
            best = -np.sort(-best)[:k + 1]
            step = min(step * 2, 64)
        found, scores = np.concatenate(seen_points), np.concatenate(seen_scores)
        if len(best) > k:
            # Exact scores decide among those that could be in the first k + 1.
            found = found[scores >= best[k] - 1e-9 * (1 + abs(best[k]))]
        exact = inner_products(points[found], query)
        cand = [by[first[p]:first[p] + copies[p]] for p in found.tolist()]
        score = np.repeat(exact, [len(c) for c in cand])
        row = np.concatenate(cand) if cand else np.zeros(0, np.int64)
        other = ids[row] != own
        row, score = row[other], score[other]
        pick = np.lexsort((ids[row], -score))[:k]
        yield q, ids[row][pick], score[pick]


def _search(k: int, miss: float) -> Callable:
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            ids, query_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
            for q, found, score in search_block(ids, np.stack(rows["v"].to_numpy()), query_ids,
                                                np.stack(queries["v"].to_numpy()), k, miss):
                out["query_id"].append(np.full(len(found), query_ids[q]))
                out["vec_id"].append(found)
                out["score"].append(score)
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, float if c == "score" else np.int64)
                             for c, x in out.items()})
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query row."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("asks")) \
        .where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0") \
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) \
        .where(F.exists("v", lambda x: x != 0))
    rows = staged(rows.withColumn("size", F.size("v")), "ann-rows")
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    blocks, groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    hashed = F.xxhash64("id")
    held = rows.select("id", "v", "size", F.pmod(hashed, F.lit(blocks)).alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    asks = rows.where("asks").select("id", "v", "size", F.pmod(hashed, F.lit(groups)).cast("int").alias("grp"),
                                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ["size", "block", "grp"]
    found = held.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(
        _search(k, miss), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

