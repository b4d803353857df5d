"""Cleaning pipeline over ``documents``: identify, filter, deduplicate, decontaminate, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``docs``; the last adds the token ids. Each stage works
on all rows its predecessor kept and learns, where it learns, from those rows.
Null, empty and repeated rows are handled as the operators state; on an empty
table every stage returns no row.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailvane.llm import decontam, langid, quality, simhash, wfst
from mailvane.llm.common import table, text_batches
from mailvane.session import scratch_path

#: The SentencePiece model, a parameter.
MODEL = os.environ.get("MAILVANE_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models do not reject."""
    return langid.keep_identified(docs, langid.learn(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (3-word shingles, at most 2 bits apart)."""
    return simhash.keep_one(docs, width=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``token_ids`` and ``n_tokens``."""
    text_batches(docs)
    encode = wfst.encoder(spark, wfst.load(MODEL))
    rows = docs.drop("token_ids", "n_tokens").withColumn("token_ids", encode("text"))
    return rows.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: Learned models, fingerprints and encodings have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
