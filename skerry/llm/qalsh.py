"""Nearest neighbours by query-aware collision-counting hashing (after QALSH, Huang et al. 2015).

Every vector is projected on PROJECTIONS random orthogonal directions and each projection is kept as a sorted array. A query's window in
an array is centred at its own projection; virtual rehashing widens all windows step by step by the same factor, and only the places that a
window newly reaches are counted. Vectors that lie in at least the share COLLISIONS of a query's windows are verified by their distance. A query
ends when a vector at its k-th best distance would, but for CONFIDENCE deviations, have collided often enough; if that never happens, all others are verified.

Vectors are dealt by hash of vec_id over BLOCKS blocks, or more of at most about BLOCK rows, each with an index of its own; queries go to every block in groups of
QUERIES, so a task holds one block and one group. The best k of each block compete. Every row is indexed; nothing is sampled.

Defined results: vectors that are null, zero, or hold null or non-finite numbers take no part, nor do rows with null ids; vectors of different
lengths are no neighbours; equal distances go to the smaller vec_id; a query's own vec_id is no candidate; repeated queries count once, repeated candidates each.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.common import arrow

PROJECTIONS, COLLISIONS, CONFIDENCE, FIRST, WIDEN, SEED = 32, 0.7, 1.5, 0.3, 1.25, 11
BLOCK, BLOCKS, QUERIES = 50_000, 8, 4096


@lru_cache(8)
def directions(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    """dim x count: random directions, orthogonal to each other within every `dim` of them."""
    rng = np.random.default_rng(SEED)
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))])[:, :count]


class Index:
    """The sorted arrays of a block, each with the rows in its order."""

    def __init__(self, vectors: np.ndarray):
        self.axes, self.norms = directions(vectors.shape[1]), (vectors * vectors).sum(axis=1)
        places = vectors @ self.axes
        order = np.argsort(places, axis=0, kind="stable")
        self.arrays = np.ascontiguousarray(np.take_along_axis(places, order, axis=0).T)
        self.rows = np.ascontiguousarray(order.T.astype(np.int32))
        self.spread = float(np.sqrt(np.mean((places - places.mean(axis=0)) ** 2))) or 1.0
        self.reach = float(np.abs(places).max())

    def halves(self, asked: np.ndarray) -> np.ndarray:
        """Half the width of the windows at each widening, up to the last that isn't yet the whole of every array."""
        widest = self.reach + float(np.abs(asked).max()) + 1.0
        first = max(FIRST * self.spread, 1e-12 * widest)
        if not first < widest < math.inf:
            # numbers so large that their squares overflow: one window of all
            return np.array([math.inf])
        return first * WIDEN ** np.arange(max(1, math.ceil(math.log(widest / first, WIDEN))))

    def windows(self, asked: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of each query begin and end, as (query, widening, array)."""
        low, high = (np.empty((len(asked), len(halves), len(self.arrays)), np.int32) for _ in range(2))
        for j, array in enumerate(self.arrays):
            low[:, :, j] = np.searchsorted(array, asked[:, j, None] - halves, "left")
            high[:, :, j] = np.searchsorted(array, asked[:, j, None] + halves, "right")
        return low, high


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, neighbour, distance): the best k found for each query among the block's vectors."""
    index, found = Index(vectors), []
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256]
        asked = part @ index.axes
        halves = index.halves(asked)
        low, high = index.windows(asked, halves)
        for i, query in enumerate(part):
            at, d = _nearest(index, ids, vectors, int(query_ids[a + i]), query, halves, low[i], high[i], k)
            found += zip([int(query_ids[a + i])] * len(at), ids[at].tolist(), d.tolist(), strict=True)
    return found


def _nearest(index: Index, ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, halves: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k nearest found and their distances; each place of an array is counted once, when a window first reaches it."""
    (n, dim), m = vectors.shape, len(index.rows)
    need = math.ceil(COLLISIONS * m)
    norm, counts = float(query @ query), np.zeros(n, np.int64)
    at, best = np.zeros(0, np.int64), np.zeros(0)

    def verify(new: np.ndarray) -> None:
        nonlocal at, best
        new = new[ids[new] != own]
        # rows in their stored order are read so much faster that for many of them the products of all are cheaper
        dots = vectors @ query if 8 * len(new) > n else None
        for a in range(0, len(new), 16384):
            part = new[a : a + 16384]
            # squares by products tell who can't be among the best k; the margin is far above their rounding
            squares, margin = index.norms[part] + norm - 2 * (vectors[part] @ query if dots is None else dots[part]), 1e-9 * (index.norms[part] + norm)
            limit = (best[k - 1] if len(best) >= k else np.inf) ** 2
            if len(part) > k:
                limit = min(limit, np.partition(squares + margin, k - 1)[k - 1])
            part = part[~(squares - margin > limit)]
            at, best = np.concatenate([at, part]), np.concatenate([best, np.sqrt(((query - vectors[part]) ** 2).sum(axis=1))])
        top = np.lexsort((ids[at], best))[:k]
        at, best = at[top], best[top]

    begin, end = low[0], low[0]
    for half, left, right in zip(halves, low, high, strict=True):
        new = [rows[x:y] for rows, a, b, c, d in zip(index.rows, left.tolist(), begin.tolist(), end.tolist(), right.tolist(), strict=True) for x, y in ((a, b), (c, d)) if x < y]
        begin, end = left, right
        if new:
            counts += np.bincount(np.concatenate(new), minlength=n)
            hit = np.flatnonzero(counts >= need)
            if len(hit):
                # what has been verified never gets to `need` again
                counts[hit] = -m
                verify(hit)
        if len(best) >= k:
            p = math.erf(half * math.sqrt(dim / 2) / max(best[k - 1], 1e-300))
            if m * p - CONFIDENCE * math.sqrt(m * p * (1 - p)) >= need:
                return at, best
    verify(np.flatnonzero(counts >= 0))
    return at, best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part; the components keep their type, so that floats are moved as such."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors and queries (vec_id, embedding) as (query_id, rank, vec_id, score): the k nearest of every query by Euclidean distance."""
    arrow(vectors.sparkSession)
    base, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    n, nq = base.count(), asked.count()
    blocks, groups = max(BLOCKS, math.ceil(1.2 * n / BLOCK)), max(1, math.ceil(nq / QUERIES))
    left = base.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            dim = a.column("dim")[0].as_py()
            x, q = (t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for t in (a, b))
            ids, query_ids = (t.column("vec_id").to_numpy() for t in (a, b))
            found = search(ids, x, query_ids, q, k)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    met = left.groupBy("dim", "block", "grp").cogroup(right.groupBy("dim", "block", "grp")).applyInArrow(meet, "query_id long, vec_id long, score double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
