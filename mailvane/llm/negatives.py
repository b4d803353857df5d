"""Hard-negative mining with exact integer scores by the method of the Four Russians.

Every component becomes floor(SCALE * x). A candidate is stored as bit planes:
for each plane one bit a dimension, eight dimensions a byte. An anchor has one
table for each eight dimensions with the sum of its components over every subset
of them. A score is then looked up, not multiplied: the bytes of a plane index
the tables, the lookups are added, and the planes are put together from the
highest (the sign) down, doubling in between. Scores are whole numbers and exact.

Two passes over (block of anchors) x (block of candidates) pairs: the first
finds the positives, within the label; the second the negatives of other labels
inside the score band that the positives set. A block pair is one task of bounded
size and returns a bounded number of rows for each anchor; a grouped top-k merges
them. No label, vector or id is a grouping key of candidates, so none can be hot.

Defined results: rows with a null id, label or vector, or any null or non-finite
component, take no part, as candidates or as anchors; vectors of another length
than an anchor's are not its candidates; rows with the anchor's id are not its
candidates; rows repeated whole count once, rows that share an id and differ each
count; ties go to the smaller id, then label, then vector; an anchor without
positives, and a positive without negatives in its band, give no row; an empty
vector scores 0. A score that no long holds counts as the nearest
long. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import materialise

SCALE = 256
#: Rows of a block of anchors and of a block of candidates; a pair of blocks is one group.
ANCHORS, CANDIDATES = 512, 16_384
MAX_TASKS = 20_000
#: Anchors and candidates scored at a time inside a group.
TILE = 128, 1024
GROUP = 8
ROW = "vec_id long, label long, dims int, planes int, bits binary"
KEY = ("vec_id", "label", "dims", "bits")


def quantised(vector, scale: float) -> list[int] | None:
    """floor(scale * x) of every component as whole numbers; None where a component is null or not finite."""
    if vector is None:
        return None
    x = np.array([np.nan if v is None else v for v in vector], dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    y = np.floor(scale * x)
    return y.astype(np.int64) if (np.abs(y) < 2.0**62).all() else [int(v) for v in y.tolist()]


def pack(values) -> tuple[int, bytes]:
    """(number of planes, bytes by plane then group) in two's complement, the lowest plane first."""
    top = max((int(v) if v >= 0 else ~int(v) for v in (values.tolist() if isinstance(values, np.ndarray) else values)), default=0)
    planes = top.bit_length() + 1
    a = np.asarray(values, dtype=np.int64 if planes < 64 else object)
    bits = np.array([(a >> p) & 1 for p in range(planes)], dtype=np.uint8)
    return planes, np.packbits(bits, axis=1, bitorder="little").tobytes()


def unpack(dims: int, planes: int, bits: bytes) -> np.ndarray:
    """The whole numbers of a packed row (as Python numbers where a long cannot hold them)."""
    rows = np.frombuffer(bits, dtype=np.uint8).reshape(planes, -1)
    b = np.unpackbits(rows, axis=1, bitorder="little")[:, :dims]
    kind = np.int64 if planes < 64 else object
    out = -b[-1].astype(kind)
    for row in b[-2::-1]:
        out = out * 2 + row.astype(kind)
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: the sum of an anchor's components over the dimensions whose bit is set."""
    n, dims = anchors.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((n, groups * GROUP), dtype=anchors.dtype)
    wide[:, :dims] = anchors
    parts = wide.T.reshape(groups, GROUP, n)
    table = np.zeros((groups, 1 << GROUP, n), dtype=anchors.dtype)
    for j in range(GROUP):
        table[:, 1 << j:2 << j] = table[:, :1 << j] + parts[:, j:j + 1]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[candidate, anchor] inner products; ``planes`` is [candidate, plane, group], the lowest plane first."""
    total = None
    for p in range(planes.shape[1] - 1, -1, -1):
        part = np.zeros((planes.shape[0], table.shape[2]), dtype=table.dtype)
        for g in range(planes.shape[2]):
            part += table[g].take(planes[:, p, g], axis=0)
        if total is None:
            total = -part  # the highest plane is the sign
        else:
            total += total
            total += part
    return total


def _width(anchors: list[np.ndarray], dims: int, planes: int) -> type:
    """The narrowest number type that holds every score and partial sum."""
    top = max((max(abs(int(v)) for v in a.tolist()) for a in anchors if a.size), default=0)
    need = top.bit_length() + planes + max(dims, 1).bit_length() + 1
    return np.int32 if need < 32 else np.int64 if need < 64 else object


class Candidates:
    """The candidates of a block with one length of vectors, in order of their key."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["vec_id", "label", "bits"], kind="stable")
        self.ids, self.labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.bits = rows["bits"].tolist()
        self.dims, self.planes = int(rows["dims"].iat[0]), int(rows["planes"].max())
        groups = -(-self.dims // GROUP)
        own = rows["planes"].to_numpy()
        self.packed = np.zeros((len(rows), self.planes, groups), dtype=np.uint8)
        for n in np.unique(own):
            at = np.flatnonzero(own == n)
            part = np.frombuffer(b"".join(self.bits[i] for i in at), dtype=np.uint8).reshape(len(at), n, groups)
            self.packed[at, :n] = part
            self.packed[at, n:] = part[:, -1:]  # the sign goes on

    def scored(self, anchors: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """[anchor, candidate] scores of the candidates ``at``."""
        kind = _width(anchors, self.dims, self.planes)
        out = np.zeros((len(anchors), at.size), dtype=kind)
        for a in range(0, len(anchors), TILE[0]):
            table = subset_sums(np.stack(anchors[a:a + TILE[0]]).astype(kind))
            for c in range(0, at.size, TILE[1]):
                out[a:a + TILE[0], c:c + TILE[1]] = scores(table, self.packed[at[c:c + TILE[1]]]).T
        return out


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties in order of place."""
    if score.size > 4 * k and score.dtype != object:
        score_at = np.flatnonzero(score >= np.partition(score, score.size - k)[score.size - k])
    else:
        score_at = np.arange(score.size)
    return score_at[np.argsort(-score[score_at], kind="stable")[:k]]


def _long(v) -> int:
    return max(-1 << 63, min(int(v), (1 << 63) - 1))


def packed_rows(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """The rows of ``vectors`` (vec_id, embedding, label) that take part, packed, each once (ROW)."""
    @pandas_udf("dims int, planes int, bits binary")
    def f(v: pd.Series) -> pd.DataFrame:
        out = []
        for x in v:
            q = quantised(x, scale)
            out.append((None, None, None) if q is None else (len(q), *pack(q)))
        return pd.DataFrame(out, columns=["dims", "planes", "bits"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), f("embedding").alias("p"))
    rows = rows.filter("vec_id is not null and label is not null and p.bits is not null")
    return rows.select("vec_id", "label", "p.*").distinct()


def _dealt(rows: DataFrame, size: int, seed: int, count: int) -> DataFrame:
    """``rows`` with a block number, by a hash of the whole row."""
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(max(1, math.ceil(count / size)))))


def _pairs(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], scored, schema: str) -> DataFrame:
    """``scored(anchors, candidates)`` of every pair of a block of anchors and a block of candidates."""
    def every(count: int, size: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, math.ceil(count / size)) - 1).cast("long")))

    left = _dealt(anchors, ANCHORS, 1, counts[0]).withColumnRenamed("block", "a").withColumn("c", every(counts[1], CANDIDATES))
    right = _dealt(rows, CANDIDATES, 2, counts[1]).withColumnRenamed("block", "c").withColumn("a", every(counts[0], ANCHORS))
    pairs = math.prod(max(1, math.ceil(n / size)) for n, size in zip(counts, (ANCHORS, CANDIDATES)))
    tasks = min(pairs, MAX_TASKS)  # set, so that small rows with much work are not merged into few tasks
    return (left.repartition(tasks, "a", "c").groupBy("a", "c").cogroup(right.repartition(tasks, "a", "c").groupBy("a", "c"))
            .applyInPandas(scored, schema))


def _by_length(left: pd.DataFrame, right: pd.DataFrame):
    """(anchors, candidates) with vectors of one length."""
    for dims, part in left.groupby("dims"):
        same = right[right["dims"] == dims]
        if len(same):
            yield part, Candidates(same)


def positives(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], k: int) -> DataFrame:
    """The first ``k`` rows of the same label for each anchor: its key, positive_id, positive_score."""
    names = [*KEY, "planes", "positive_id", "positive_bits", "positive_score"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, c in _by_length(left, right):
            for label, mine in part.groupby("label"):
                at = np.flatnonzero(c.labels == label)
                if not at.size:
                    continue
                values = [unpack(d, p, b) for d, p, b in zip(mine["dims"], mine["planes"], mine["bits"])]
                for row, s in zip(mine.itertuples(), c.scored(values, at)):
                    other = np.flatnonzero(c.ids[at] != row.vec_id)
                    out += [(row.vec_id, label, row.dims, row.bits, row.planes, c.ids[at[i]], c.bits[at[i]], _long(s[i])) for i in other[_first(s[other], k)]]
        return pd.DataFrame(out, columns=names)

    found = _pairs(anchors, rows, counts, run, "vec_id long, label long, dims int, bits binary, planes int, positive_id long, positive_bits binary, positive_score long")
    w = Window.partitionBy(*KEY).orderBy(F.col("positive_score").desc(), "positive_id", "positive_bits")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def negatives(found: DataFrame, rows: DataFrame, counts: tuple[int, int], k: int, low: int, high: int) -> DataFrame:
    """The first ``k`` rows of another label whose score is within ``low`` to ``high`` percent of each positive's."""
    names = ["vec_id", "label", "dims", "bits", "place", "positive_id", "positive_score", "negative_id", "negative_label", "negative_bits", "negative_score"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, c in _by_length(left, right):
            values = [unpack(d, p, b) for d, p, b in zip(part["dims"], part["planes"], part["bits"])]
            every = np.arange(c.ids.size)
            for start in range(0, len(values), TILE[0]):
                for row, s in zip(part.iloc[start:start + TILE[0]].itertuples(), c.scored(values[start:start + TILE[0]], every)):
                    other = np.flatnonzero((c.labels != row.label) & (c.ids != row.vec_id))
                    for place, pid, score in zip(row.places, row.positive_ids, row.positive_scores):
                        lo, hi = -(-low * int(score) // 100), high * int(score) // 100
                        inside = other[(s[other] >= lo) & (s[other] <= hi)]
                        out += [(row.vec_id, row.label, row.dims, row.bits, place, pid, score, c.ids[i], c.labels[i], c.bits[i], _long(s[i]))
                                for i in inside[_first(s[inside], k)]]
        return pd.DataFrame(out, columns=names)

    told = found.groupBy(*KEY, "planes").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    told = told.select(*KEY, "planes", F.col("p.place").alias("places"), F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    out = _pairs(told, rows, counts, run, "vec_id long, label long, dims int, bits binary, place int, positive_id long, positive_score long, "
                 "negative_id long, negative_label long, negative_bits binary, negative_score long")
    w = Window.partitionBy(*KEY, "place").orderBy(F.col("negative_score").desc(), "negative_id", "negative_label", "negative_bits")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``; ``low`` and ``high`` are percents
    of the positive's score between which a negative's lies.
    """
    rows = materialise(packed_rows(vectors, scale), "negatives-rows")
    anchors = rows.filter(is_anchor)
    counts = (anchors.count(), rows.count())
    found = materialise(positives(anchors, rows, counts, n_positives), "negatives-positives")
    out = negatives(found, rows, counts, n_negatives, low, high)
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows from DuckDB, every score multiplied out.
ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, c.vec_id AS id, c.label AS cl,
        CAST(list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.q) = len(c.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE al = cl
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE al <> cl AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""
