"""Registered queries of this subpackage, ``opN_<name>``, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licenses, negatives, qalsh, quality, repair, simhash, substring, token_scan, warc, wfst
from .common import held_out, table, text_batches

#: Folder of public tokenizer files, a parameter.
TOKENIZERS = os.environ.get("MAILVANE_TOKENIZERS", "/opt/tokenizers")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, read back from flat token files."""
    docs = table(spark, sf_dir, "documents")
    files = token_scan.write_token_files(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    counts = token_scan.scan(spark, files.path)
    return files.order.join(counts, ["file", "ordinal"], "left").select("doc_id", "n_tokens")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), width=3, max_bits=2)
    return groups.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number, and whether decoding gives the text back."""
    model = wfst.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    text_batches(docs)
    coded = docs.select("doc_id", "text", wfst.coder(spark, model)("text").alias("coded"))
    plain = F.translate(F.coalesce("text", F.lit("")), wfst.BLANK, " ")
    return coded.select("doc_id", F.col("coded.ids").alias("token_ids"), F.size("coded.ids").alias("n_tokens"),
                        (F.col("coded.text") == plain).alias("round_trip"))


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of a replica of all pages' WARC files, located by the tree."""
    return warc.audit(*warc.replicas_of_pages(table(spark, sf_dir, "pages")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.measured(table(spark, sf_dir, "documents"))
    ensemble = quality.fit(stats, quality.taught(stats, table(spark, sf_dir, "labels")))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return qalsh.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text"))
        for t, r in enumerate(("user", "assistant"))])))
    return chat.read_back(chat.windows(rows.unionByName(extra)))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=10, low=30, high=90, scale=256)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_counts, op2_simhash, op3_langid, op4_sentencepiece, op5_warc_audit, op6_quality, op7_ann, op8_decontaminate,
    op9_chat, op10_licenses, op11_hard_negatives, op12_substring_dedup, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_audit": warc.ORACLE_SQL, "op11_hard_negatives": negatives.ORACLE_SQL, "op12_substring_dedup": substring.ORACLE_SQL,
    "op13_conversation_repair": repair.ORACLE_SQL}
