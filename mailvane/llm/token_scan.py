"""Token counts by a separator scan of flat, unindexed token files.

A token file is little-endian integers, each document ended by a separator id,
with no index. Files are read in fixed ranges; each range is searched for the
separator in one vector operation; an exclusive prefix sum of separators over
the ranges of a file numbers the documents, and the pieces of a document that
crosses ranges are added up.

Defined results: a document without tokens counts 0; tokens behind a file's
last separator are a document that is not terminated, none behind it are none;
an empty file has no document; a null or empty text is written as its separator
alone; text that spells the separator is ordinary text; repeated rows are
documents each; an empty table writes no file and counts none. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialise, text_batches

SEPARATOR = 50_256
#: Split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of one range, and ranges of one step of the prefix sum.
RANGE, STEP = 1 << 20, 1024
DTYPE = "<u2"


class TokenFiles(NamedTuple):
    """A folder of token files and which document (doc_id) has which place (file, ordinal)."""
    path: str
    order: DataFrame


@lru_cache(1)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def store_uri(path: str) -> str:
    """A folder of the session as the file library names it: Hadoop's names of object stores differ."""
    scheme, sep, rest = path.partition(":/")
    if not sep:
        return path
    name = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasb": "abfss", "wasbs": "abfss"}.get(scheme, scheme)
    return f"file:///{rest.lstrip('/')}" if name == "file" else f"{name}:/{rest}"


def _open(path: str):
    return pafs.FileSystem.from_uri(store_uri(path))


def write_token_files(docs: DataFrame, vocabulary: str) -> TokenFiles:
    """Encode whole texts into token files in the shared folder, one per partition.

    A task writes under a name of its own attempt and moves the file at its end;
    a repeated task puts the same file in its place.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches):
        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():06d}.tokens"
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        attempt = f"{root}/_{name}-{ctx.taskAttemptId()}"
        encode, n, out = _encoding(ranks.value).encode_ordinary, 0, None
        for batch in batches:
            if out is None and len(batch):
                out = fs.open_output_stream(attempt)
            for text in batch["text"]:
                out.write(np.array([*(encode(text) if text else ()), SEPARATOR], dtype=DTYPE).tobytes())
            yield pd.DataFrame({"file": name, "ordinal": range(n, n + len(batch)), "doc": batch["doc"]})
            n += len(batch)
        if out is not None:
            out.close()
            fs.move(attempt, f"{root}/{name}")

    text_batches(docs)
    kind = docs.schema["doc_id"].dataType
    order = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInPandas(run, "file string, ordinal long, doc string")
    return TokenFiles(path, materialise(order, "token-order").withColumn("doc_id", F.col("doc").cast(kind)).drop("doc"))


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, dtype: str = DTYPE, range_tokens: int = RANGE) -> DataFrame:
    """(file, ordinal, n_tokens, terminated) of every document in the token files of a folder."""
    width = np.dtype(dtype).itemsize
    size = range_tokens * width
    schema = "path string, modificationTime timestamp, length long, content binary"
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(path).select("path", "length")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], schema).select("path", "length")  # nothing was written
    if files.filter(F.col("length") % width != 0).take(1):
        raise ValueError("a token file ends within a token")
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("range"))

    def run(batches):
        for batch in batches:
            rows = []
            for p, length, r in zip(batch["path"], batch["length"], batch["range"]):
                fs, name = _open(p)
                with fs.open_input_file(name) as f:
                    f.seek(r * size)
                    ids = np.frombuffer(f.read(min(size, length - r * size)), dtype=dtype)
                at = np.flatnonzero(ids == separator)
                ends = np.diff(at, prepend=-1) - 1
                rows.append({"file": name.rsplit("/", 1)[-1], "range": r, "seps": len(at),
                             "counts": [*ends.tolist(), int(len(ids) - 1 - (at[-1] if len(at) else -1))]})
            yield pd.DataFrame(rows, columns=["file", "range", "seps", "counts"])

    found = ranges.repartition("path", "range").mapInPandas(run, "file string, range long, seps long, counts array<long>")
    found = materialise(found, "token-ranges")
    step = F.expr(f"range div {STEP}").alias("step")
    inside = Window.partitionBy("file", "step").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    local = found.select("*", step).withColumn("local", F.coalesce(F.sum("seps").over(inside), F.lit(0)))
    steps = found.groupBy("file", step).agg(F.sum("seps").alias("seps"))
    before = Window.partitionBy("file").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("file", "step", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("base"))
    numbered = local.join(steps, ["file", "step"]).select(
        "file", "seps", (F.col("base") + F.col("local")).alias("first"), F.posexplode("counts").alias("i", "n"))
    pieces = numbered.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n", (F.col("i") < F.col("seps")).alias("closed"),
                             ((F.col("i") > 0) & (F.col("i") < F.col("seps"))).alias("whole"))
    whole = pieces.filter("whole").select("file", "ordinal", F.col("n").alias("n_tokens"), F.lit(True).alias("terminated"))
    joined = pieces.filter("not whole").groupBy("file", "ordinal").agg(F.sum("n").alias("n_tokens"), F.max("closed").alias("terminated"))
    return whole.unionByName(joined.filter("terminated or n_tokens > 0"))
