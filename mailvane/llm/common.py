"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, small_arrow_batches

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage without depending on any executor: a lost executor costs a
    re-read of shared files, never a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame) -> None:
    """Bound the Arrow batches of texts before a Python step runs over ``df``."""
    small_arrow_batches(df.sparkSession)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the held-out fold (null id: false)."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from (null id: false)."""
    return F.coalesce(fold(doc_id) != 0, F.lit(False))
