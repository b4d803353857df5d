"""Nearest neighbours by collision counting over query-centred windows.

Rows are indexed in blocks. Of a block, each random projection gives one sorted
array. A query counts, per vector, the arrays in which it lies within a window
centred on the query's own projection; windows widen by virtual rehashing
(radius 1, c, c^2, ...) without rebuilding an array, counting the added rings
only. Vectors whose count reaches the threshold of a radius are verified with
the exact cosine, however many they are. A query stops in a block at the first
radius within which k verified vectors lie; beyond the diameter of the sphere
all vectors of the block are verified.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component, and null ids, take no part; vectors meet only those of
their own length; ties go to the smaller id; a repeated query id is one query
(its smallest vector); repeated candidate rows are candidates each; an empty
table gives no row. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, WIDTH, FIRST_RADIUS, GROWTH = 128, 1.0, 0.45, 1.2
#: Standard deviations that the threshold lies below the collisions expected of a vector at the radius.
SLACK = 1.75
BLOCK = 8_192
#: Queries of one pass: the size bound of what is broadcast is this many vectors.
QUERY_BLOCK = 4_096
SEED = 7


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


def radii() -> list[float]:
    """Radii up to the diameter of the unit sphere."""
    n = math.ceil(math.log(2 / FIRST_RADIUS, GROWTH)) + 1
    return [FIRST_RADIUS * GROWTH ** i for i in range(n)]


def threshold() -> float:
    """Collisions that a vector at the radius reaches but for SLACK standard deviations."""
    p = math.erf(WIDTH / math.sqrt(2))
    return PROJECTIONS * p - SLACK * math.sqrt(PROJECTIONS * p * (1 - p))


class BlockIndex:
    """Sorted projections of a block of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        at = (vectors / self.norms[:, None]) @ axes
        self.order = np.argsort(at, axis=0).T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(at.T, self.order, axis=1)
        self.axes = axes

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query_id, ids, cosines) of each query's k nearest verified vectors of this block."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        centre = (queries / norms[:, None]) @ self.axes
        steps, need = radii(), threshold()
        lo = np.empty((len(steps), PROJECTIONS, len(queries)), dtype=np.int32)
        hi = np.empty_like(lo)
        for j in range(PROJECTIONS):
            for s, r in enumerate(steps):
                lo[s, j] = np.searchsorted(self.sorted[j], centre[:, j] - WIDTH * r, "left")
                hi[s, j] = np.searchsorted(self.sorted[j], centre[:, j] + WIDTH * r, "right")
        n = len(self.ids)
        for i, qid in enumerate(query_ids):
            others = self.ids != qid
            if not others.any():
                continue
            count = np.zeros(n, dtype=np.int64)
            cosine = np.full(n, -np.inf)
            tried = ~others
            left = right = None
            for s, r in enumerate(steps):
                a, b = lo[s, :, i], hi[s, :, i]
                if left is None:
                    rings = [o[x:y] for o, x, y in zip(self.order, a.tolist(), b.tolist())]
                else:
                    rings = [o[x:y] for o, x, y in zip(self.order, a.tolist(), left.tolist()) if x < y]
                    rings += [o[x:y] for o, x, y in zip(self.order, right.tolist(), b.tolist()) if x < y]
                left, right = a, b
                if rings:
                    count += np.bincount(np.concatenate(rings), minlength=n)
                self._verify(np.flatnonzero((count >= need) & ~tried), tried, cosine, queries[i], norms[i])
                near = 1 - r * r / 2
                if np.count_nonzero(cosine >= near) >= k:
                    break
            else:
                self._verify(np.flatnonzero(~tried), tried, cosine, queries[i], norms[i])
            found = np.flatnonzero(cosine > -np.inf)
            best = found[np.lexsort((self.ids[found], -cosine[found]))][:k]
            yield qid, self.ids[best], cosine[best]

    def _verify(self, rows: np.ndarray, tried: np.ndarray, cosine: np.ndarray, query: np.ndarray, norm: float) -> None:
        if rows.size:
            tried[rows] = True
            cosine[rows] = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def _by_length(ids, vectors):
    """{length: (ids, matrix)} of vectors."""
    sizes = np.array([len(v) for v in vectors])
    return {int(d): (ids[sizes == d], np.stack([v for v, x in zip(vectors, sizes) if x == d]).astype(np.float64)) for d in np.unique(sizes)}


def _search_block(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nearest of one bounded block of queries in every block of rows."""
    got = queries.toPandas()
    if got.empty:
        return rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    shared = rows.sparkSession.sparkContext.broadcast(_by_length(got["vec_id"].to_numpy(np.int64), got["embedding"].tolist()))

    def run(batches):
        def found(ids, vectors):
            for dim, (own, matrix) in _by_length(np.concatenate(ids), vectors).items():
                if dim not in shared.value:
                    continue
                index = BlockIndex(own, matrix, projections(dim))
                parts = list(index.search(*shared.value[dim], k))
                if parts:
                    yield pd.DataFrame({"query_id": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]),
                                        "vec_id": np.concatenate([p[1] for p in parts]), "score": np.concatenate([p[2] for p in parts])})

        ids, vectors = [], []
        for batch in batches:
            ids.append(batch["vec_id"].to_numpy(np.int64))
            vectors += batch["embedding"].tolist()
            if len(vectors) >= BLOCK:
                yield from found(ids, vectors)
                ids, vectors = [], []
        if vectors:
            yield from found(ids, vectors)

    return rows.mapInPandas(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` found for each of ``queries``, the query's own id aside.

    Queries go over all rows in blocks of at most about QUERY_BLOCK.
    """
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    parts = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    out = None
    for i in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i)
        near = _search_block(rows, block, k)
        out = near if out is None else out.unionByName(near)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
