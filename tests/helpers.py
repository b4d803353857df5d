"""Small in-memory message tables for tests."""

from pyspark.sql import functions as F

from mailvane.sources.tables import LISTING_SCHEMA, MESSAGE_SCHEMA, STATE_SCHEMA

DATE = "Thu, 28 May 2026 10:00:00 +0900"


def messages(spark, rows, folder="INBOX", epoch=777, ts="2026-05-28 10:00:00"):
    """rows: (uid, subject, body[, is_deleted[, blocked]])"""
    data = []
    for r in rows:
        uid, subject, body = r[:3]
        deleted = r[3] if len(r) > 3 else False
        blocked = r[4] if len(r) > 4 else False
        data.append((folder, int(uid), epoch, subject, "sender@example.com", DATE,
                     "" if blocked else body, "blocked" if blocked else "plain", False, blocked,
                     "COMPENSATION_SUBJECT" if blocked else None, deleted, None, None))
    df = spark.createDataFrame(data, MESSAGE_SCHEMA)
    return df.withColumn("synced_at", F.lit(ts).cast("timestamp"))


def source(spark, uids, folder="INBOX", failing=(), subjects=None, epoch=777):
    subjects = subjects or {}
    rows = [(folder, int(u), epoch, subjects.get(int(u), f"Mail {u}"), "sender@example.com", DATE,
             f"body {u}", "plain", False, int(u) not in set(failing)) for u in uids]
    return spark.createDataFrame(rows, "folder string, uid long, uidvalidity long, subject string, sender string, "
                                       "date string, body string, body_text_type string, truncated boolean, ok boolean")


def listing(spark, uids, folder="INBOX", epoch=777, ok=True):
    rows = [(folder, int(u), epoch, ok) for u in uids] or [(folder, None, epoch, ok)]
    return spark.createDataFrame(rows, LISTING_SCHEMA)


def state(spark, rows):
    """rows: (folder, uidvalidity, last_uid, last_full_check_at str or None)"""
    df = spark.createDataFrame([(f, e, u, None) for f, e, u, _ in rows], STATE_SCHEMA)
    checks = {f: c for f, _, _, c in rows}
    expr = F.lit(None).cast("timestamp")
    for f, c in checks.items():
        if c is not None:
            expr = F.when(F.col("folder") == f, F.lit(c).cast("timestamp")).otherwise(expr)
    return df.withColumn("last_full_check_at", expr)


def empty_state(spark):
    return spark.createDataFrame([], STATE_SCHEMA)


def empty_messages(spark):
    return spark.createDataFrame([], MESSAGE_SCHEMA)
