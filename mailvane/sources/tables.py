"""Table sources and sinks (S2-S7) and the message views over the fixture tables.

Schemas follow FIXTURES.md: ``messages`` carries the header and index flags,
``bodies`` the text, ``listing`` what a folder listing returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: fixture mapping constants ---
FIXTURE_UIDVALIDITY = 777
FIXTURE_DATE = "Thu, 28 May 2026 10:00:00 +0900"
# --- end fixed values ---

MESSAGE_SCHEMA = T.StructType([
    T.StructField("folder", T.StringType()),
    T.StructField("uid", T.LongType()),
    T.StructField("uidvalidity", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("body_text_type", T.StringType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("body_index_blocked", T.BooleanType()),
    T.StructField("block_reason", T.StringType()),
    T.StructField("is_deleted", T.BooleanType()),
    T.StructField("synced_at", T.TimestampType()),
    T.StructField("deleted_at", T.TimestampType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("folder", T.StringType()),
    T.StructField("uidvalidity", T.LongType()),
    T.StructField("last_uid", T.LongType()),
    T.StructField("last_full_check_at", T.TimestampType()),
])

LISTING_SCHEMA = T.StructType([
    T.StructField("folder", T.StringType()),
    T.StructField("uid", T.LongType()),
    T.StructField("uidvalidity", T.LongType()),
    T.StructField("listing_ok", T.BooleanType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A caller that reads few large row groups with many cores may set
    ``mailvane.readPartitions``; unset, the scan's own partitions stay."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get("mailvane.readPartitions", None)
    return df.repartition(int(parts), df.columns[0]) if parts else df


def restrict_folders(df: DataFrame, folders: DataFrame) -> DataFrame:
    """``df`` limited to the folders named by ``folders(folder)``.

    A semi join: on a folder-partitioned table its small side prunes
    partitions at run time, and nothing is read on the driver.
    """
    return df.join(folders.select("folder").distinct(), "folder", "left_semi")


def subject_of(text: Column) -> Column:
    """First line of a text."""
    return F.substring_index(text, "\n", 1)


def _arrived(rows: DataFrame) -> list[str]:
    """A stream's ``arrived`` column goes through both views, where it is there."""
    return [c for c in rows.columns if c == "arrived"]


def source_messages_from_documents(documents: DataFrame) -> DataFrame:
    """The mailbox view of ``documents``: folder = source, uid = doc_id.

    Returns what a mailbox fetch yields: header fields plus the body text,
    ``body_text_type`` and ``truncated``.
    """
    return documents.select(
        F.col("source").alias("folder"),
        F.col("doc_id").alias("uid"),
        F.lit(FIXTURE_UIDVALIDITY).cast("long").alias("uidvalidity"),
        subject_of(F.col("text")).alias("subject"),
        F.concat(F.lit("user"), F.col("doc_id").cast("string"), F.lit("@example.com")).alias("sender"),
        F.lit(FIXTURE_DATE).alias("date"),
        F.col("text").alias("body"),
        F.lit("plain").alias("body_text_type"),
        F.lit(False).alias("truncated"),
        *_arrived(documents),
    )


def source_messages_from_conversations(conversations: DataFrame) -> DataFrame:
    """Second corpus: one folder per role, uid = conv_id * 1000 + turn."""
    return conversations.select(
        F.col("role").alias("folder"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("uid"),
        F.lit(FIXTURE_UIDVALIDITY).cast("long").alias("uidvalidity"),
        subject_of(F.col("text")).alias("subject"),
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("@example.com")).alias("sender"),
        F.lit(FIXTURE_DATE).alias("date"),
        F.col("text").alias("body"),
        F.lit("plain").alias("body_text_type"),
        F.lit(False).alias("truncated"),
    )


def as_index_rows(source: DataFrame, run_ts: Column | None = None) -> DataFrame:
    """Source rows as fully indexed, active ``messages`` rows (no policy applied)."""
    ts = run_ts if run_ts is not None else F.current_timestamp()
    return source.select(
        "folder", "uid", "uidvalidity", "subject", "sender", "date", "body",
        "body_text_type", "truncated",
        F.lit(False).alias("body_index_blocked"),
        F.lit(None).cast("string").alias("block_reason"),
        F.lit(False).alias("is_deleted"),
        ts.cast("timestamp").alias("synced_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        *_arrived(source),
    )


def folder_inventory(messages: DataFrame) -> DataFrame:
    """Folder names present in a message table (S3)."""
    return messages.select(F.col("folder").alias("name")).distinct()


def uid_listing(messages: DataFrame, min_uid: int | None = None) -> DataFrame:
    """Folder listing with an optional ``N:*`` range, strictly ``uid >= N``."""
    out = messages.select("folder", "uid", "uidvalidity")
    if min_uid is not None:
        out = out.filter(F.col("uid") >= F.lit(int(min_uid)))
    return out


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
