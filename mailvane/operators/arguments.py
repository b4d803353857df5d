"""Argument checks of query batches, before any work (§2.13).

A single caller gets an error for a blank folder or query, or a limit below 1.
In a batch one bad row must not stop the others: it is set aside with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "is required"
TOO_SMALL = "must be greater than 0"


def _errors(queries: DataFrame, texts: tuple[str, ...], limits: tuple[str, ...]) -> Column:
    """The first thing wrong with a row, or null."""
    blank = [F.when(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")) == "", F.lit(f"{c} {BLANK}")) for c in texts]
    small = [F.when(F.col(c) < 1, F.lit(f"{c} {TOO_SMALL}")) for c in limits if c in queries.columns]
    return F.coalesce(*blank, *small, F.lit(None).cast("string"))


def checked(queries: DataFrame, texts: tuple[str, ...] = ("folder", "query"),
            limits: tuple[str, ...] = ("limit", "max_scan")) -> tuple[DataFrame, DataFrame]:
    """(rows to run, rejected rows with ``error``); a null limit takes the default and is no error."""
    marked = queries.withColumn("error", _errors(queries, texts, limits))
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")
