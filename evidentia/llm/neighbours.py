"""Approximate nearest neighbours by collision-counting hashing.

Vectors are dealt to blocks of bounded size by the hash of their id. A block projects its vectors on random directions, one sorted
array each. A query's windows around its own projections grow by virtual rehashing: the same arrays, one radius for all of them, taken
from how many places of the arrays it is to reach, which grow by a factor until all are reached (so it ends, whatever the numbers are).
A vector whose projections fall in at least `share` of the windows is verified by its exact distance. A query's windows stop
growing in a block once `quota` of the block's vectors are verified. Every vector is indexed and may collide; `share` and `quota` set
recall. Queries of a block are searched a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.plans.runtime import staged

BLOCK, PROJECTIONS, GROWTH, SHARE, QUOTA = 16_384, 64, 1.2, 0.9, 0.08
#: Share of the places of a sorted array that the first windows reach, vectors verified for each neighbour asked for in a small block, and queries in a batch.
FIRST, LEAST_QUOTA, BATCH = 0.5, 24, 64
#: Components are kept within this for projections only, so that these are finite.
FAR = 1e100


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to q, in double precision; where squares would overflow, of scaled vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        for i in np.flatnonzero(~np.isfinite(d)).tolist():
            top = max(np.abs(x[i]).max(), np.abs(q).max())
            d[i] = top * np.sqrt(((x[i] / top - q / top) ** 2).sum())
    return d


class CollisionIndex:
    def __init__(self, x: np.ndarray, projections: int = PROJECTIONS, seed: int = 3):
        self.x = x.astype(np.float64)
        self.lines = np.random.default_rng(seed).normal(size=(x.shape[1], projections))
        p = np.clip(self.x, -FAR, FAR) @ self.lines
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(p.T, self.order, axis=1)

    def _places(self, at: np.ndarray, side: str) -> np.ndarray:
        return np.stack([np.searchsorted(s, v, side=side) for s, v in zip(self.sorted, at.T, strict=True)], axis=1)

    def search(self, queries: np.ndarray, k: int, share: float = SHARE, quota: float = QUOTA, growth: float = GROWTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, distances) of all vectors verified, for each query once."""
        n, m = len(self.x), len(self.sorted)
        need, most = int(np.ceil(share * m)), min(n, max(LEAST_QUOTA * k, int(np.ceil(quota * n))))
        for first in range(0, len(queries), BATCH):
            at = np.clip(queries[first : first + BATCH], -FAR, FAR) @ self.lines
            left, middle, every = np.arange(len(at)), self._places(at, "left"), np.arange(m)
            count = np.zeros((len(at), n), dtype=np.int16)
            lo, hi, reach = middle.copy(), middle.copy(), max(1, int(FIRST * n / 2))
            while len(left):
                own, mid = at[left], middle[left]
                below, above = self.sorted[every, np.maximum(mid - reach, 0)], self.sorted[every, np.minimum(mid + reach, n - 1)]
                radius = np.median(np.maximum(own - below, above - own), axis=1)[:, None]
                a, b = self._places(own - radius, "left"), self._places(own + radius, "right")
                if reach >= n:
                    a[:], b[:] = 0, n
                a, b = np.minimum(a, lo[left]), np.maximum(b, hi[left])
                ends = []
                for i, q in enumerate(left.tolist()):
                    new = [self.order[j, a[i, j] : lo[q, j]] for j in range(m)] + [self.order[j, hi[q, j] : b[i, j]] for j in range(m)]
                    count[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                    rows = np.flatnonzero(count[q] >= need)
                    if len(rows) >= most:
                        yield first + q, rows, distances(self.x[rows], queries[first + q])
                    ends.append(len(rows) >= most)
                lo[left], hi[left] = a, b
                left, reach = left[~np.array(ends)], int(reach * growth) + 1


def nearest(vectors: DataFrame, is_query, k: int = 10, id_: str = "vec_id", column: str = "embedding", block: int = BLOCK, quota: float = QUOTA) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean, in double precision), by score, then vec_id.

    is_query: a condition on the rows that are queries; candidates are all rows whose id isn't the query's, of as many components.
    A query gets all candidates if there are fewer than k. Vectors that are null, empty or zero, or hold null or non-finite components,
    and rows without an id take no part. Of queries that repeat an id one counts (the one with the least vector); candidates that
    repeat are ranked each. Other columns are ignored. Queries meet each block, in blocks: a stated query set against all rows.
    """
    v = F.col(column).cast("array<double>")
    usable = vectors.select(F.col(id_).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    usable = usable.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    usable = staged(usable, "vectors")
    blocks = max(1, -(-usable.count() // block))
    data = usable.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    queries = usable.where("q").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    # a block to a partition, so that none waits for another
    rows = data.unionByName(queries).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[:3]), np.split(b.column(3).flatten().to_numpy(), np.asarray(b.column(3).value_lengths()).cumsum()[:-1]), strict=True))
        for _, group in groupby(stream, key=lambda r: r[0]):
            ids: dict[int, list] = {}
            asked: dict[int, list] = {}
            index: dict[int, tuple[np.ndarray, CollisionIndex]] = {}

            def answers(dim: int, queries: list) -> pa.RecordBatch:
                if dim not in index and dim in ids:
                    index[dim] = np.array([a for a, _ in ids[dim]]), CollisionIndex(np.stack([b for _, b in ids.pop(dim)]))
                who, tree = index.get(dim, (None, None))
                out = []
                for at, found, dist in tree.search(np.stack([v for _, v in queries]), k + 1, quota=quota) if tree else ():
                    other = who[found] != queries[at][0]
                    who_, dist = who[found][other], dist[other]
                    best = np.lexsort((who_, dist))[:k]
                    out += zip([queries[at][0]] * len(best), who_[best].tolist(), dist[best].tolist(), strict=True)
                return _batch(out)

            for _, kind, i, vec in group:  # the block's vectors, then the queries, of which BATCH are held
                if not kind:
                    ids.setdefault(len(vec), []).append((i, vec))
                    continue
                asked.setdefault(len(vec), []).append((i, vec))
                if len(asked[len(vec)]) == BATCH:
                    yield answers(len(vec), asked.pop(len(vec)))
            for dim, queries in asked.items():
                yield answers(dim, queries)

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])
