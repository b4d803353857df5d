"""Which messages of one table another lacks, by digests of uid ranges.

A folder's uids are cut into wide ranges and those into narrow ones. Each range
has a count and an order-free sum of hashes, combined before their shuffle. Only
the narrow ranges inside wide ranges that differ are digested, and only rows of
narrow ranges that differ meet in a join. Where two tables agree, as a listing
and its index mostly do, no row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Uids of a wide and of a narrow range.
SPANS = (1 << 16, 1 << 8)


def _range(span: int) -> Column:
    return F.floor(F.col("uid") / span)


def range_digests(keys: DataFrame, span: int) -> DataFrame:
    """``folder, range, n, digest`` of ``keys(folder, uid)``."""
    return keys.groupBy("folder", _range(span).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("folder", "uid").cast("decimal(38,0)")).alias("digest"))


def differing(left: DataFrame, right: DataFrame, span: int) -> DataFrame:
    """``_folder, _range`` of the ranges of ``left`` whose digest ``right`` does not have."""
    a, b = range_digests(left, span), range_digests(right, span)
    return a.join(b, ["folder", "range", "n", "digest"], "left_anti").select(F.col("folder").alias("_folder"), F.col("range").alias("_range"))


def missing(left: DataFrame, right: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Rows of ``left(folder, uid)`` that ``right(folder, uid)`` does not have; rows with a null uid are in neither.

    A repeated row only makes its range differ, and the join at the end decides.
    """
    left, right = (t.select("folder", "uid").filter("uid is not null") for t in (left, right))
    for span in spans:
        parts = differing(left, right, span)
        inside = (F.col("folder") == F.col("_folder")) & (_range(span) == F.col("_range"))
        left, right = left.join(parts, inside, "left_semi"), right.join(parts, inside, "left_semi")
    return left.join(right, ["folder", "uid"], "left_anti")
