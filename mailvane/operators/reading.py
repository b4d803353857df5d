"""Header listing, keyed body reads and body scans.

Per-folder slicing uses ``row_number() <= n`` over a window partitioned by
folder; Spark plans it as a partial ``WindowGroupLimit`` before the shuffle,
so even a folder holding a third of all rows only sends ``n`` rows per map
task to the final window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.redact import redact, redact_body, redact_summary, validate_patterns
from ..functions.text import casefold
from ..sources.tables import restrict_folders

HEADER_COLUMNS = ("folder", "uid", "subject", "sender", "date")


def _check_positive(name: str, value: int | None) -> None:
    if value is not None and int(value) < 1:
        raise ValueError(f"{name} must be greater than 0")


def newest_per_folder(df: DataFrame, n: int | None, rank_col: str = "rank",
                      partition: Sequence[str] = ("folder",)) -> DataFrame:
    """Newest ``n`` rows per folder by uid, with their 1-based rank (O1/O2)."""
    w = Window.partitionBy(*partition).orderBy(F.col("uid").desc())
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out if n is None else out.filter(F.col(rank_col) <= F.lit(int(n)))


def oldest_per_folder(df: DataFrame, n: int | None, rank_col: str = "rank",
                      partition: Sequence[str] = ("folder",)) -> DataFrame:
    """Oldest ``n`` rows per folder by uid (O3)."""
    w = Window.partitionBy(*partition).orderBy(F.col("uid").asc())
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out if n is None else out.filter(F.col(rank_col) <= F.lit(int(n)))


def with_block_flags(df: DataFrame, keywords=policy.COMPENSATION_SUBJECT_KEYWORDS,
                     reason: str = policy.COMPENSATION_BLOCK_REASON) -> DataFrame:
    return df.withColumns(policy.block_columns("subject", keywords, reason))


def recent_messages(messages: DataFrame, limit: int = 10,
                    keywords=policy.COMPENSATION_SUBJECT_KEYWORDS,
                    extra_patterns=None) -> DataFrame:
    """Newest ``limit`` headers of every folder, flagged and redacted."""
    _check_positive("limit", limit)
    extra = validate_patterns(extra_patterns)
    heads = newest_per_folder(messages.select(*HEADER_COLUMNS), limit)
    return redact_summary(with_block_flags(heads, keywords), extra)


def fetch_headers(messages: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed header fetch (P2) for a batch of ``(folder, uid)`` keys.

    Returns (found, missing). The reference raises on a missing key; here
    the missing keys come back as their own DataFrame.
    """
    k = keys.select("folder", "uid")
    found = messages.select(*HEADER_COLUMNS).join(k, ["folder", "uid"], "left_semi")
    missing = k.join(messages.select("folder", "uid"), ["folder", "uid"], "left_anti")
    return found, missing


def read_bodies(messages: DataFrame, bodies: DataFrame | None, keys: DataFrame,
                max_chars: int = 20000, allow_blocked_body: bool = False,
                keywords=policy.COMPENSATION_SUBJECT_KEYWORDS,
                extra_patterns=None) -> DataFrame:
    """Body read for a batch of keys with subject policy.

    A blocked message (and no override) gets the ``[BLOCKED:...]`` body and
    its text is never joined in. Others are redacted, then cut to
    ``max_chars``. ``bodies`` may be None when ``messages`` carries ``body``.
    """
    _check_positive("max_chars", max_chars)
    extra = validate_patterns(extra_patterns)
    k = keys.select("folder", "uid")
    body_cols = ["body_text_type", "truncated"] if bodies is not None else ["body", "body_text_type", "truncated"]
    heads = messages.select(*HEADER_COLUMNS, *body_cols).join(k, ["folder", "uid"], "left_semi")
    blocked = policy.contains_keyword("subject", keywords) & F.lit(not allow_blocked_body)
    heads = heads.withColumn("blocked", blocked)

    blocked_rows = heads.filter("blocked").select(
        *HEADER_COLUMNS,
        F.lit(policy.COMPENSATION_BLOCK_BODY).alias("body"),
        F.lit("blocked").alias("body_text_type"),
        F.lit(False).alias("truncated"),
        F.lit(True).alias("blocked"),
        F.lit(True).alias("can_override"),
        F.lit(policy.COMPENSATION_BLOCK_REASON).alias("block_reason"),
    )
    open_heads = heads.filter(~F.col("blocked"))
    if bodies is not None:
        # only non-blocked keys reach the body table
        open_heads = open_heads.drop("body_text_type", "truncated").join(
            bodies.select("folder", "uid", "body", "body_text_type", "truncated"), ["folder", "uid"])
    open_rows = open_heads.select(
        *HEADER_COLUMNS, "body", "body_text_type", "truncated",
        F.lit(False).alias("blocked"), F.lit(False).alias("can_override"),
        F.lit(None).cast("string").alias("block_reason"),
    )
    return (redact_body(open_rows, max_chars, extra)
            .unionByName(redact_body(blocked_rows, None, extra)))


def active_blocked(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Active blocked rows, newest first per folder, optionally the newest ``limit``."""
    rows = messages.filter(~F.col("is_deleted") & F.col("body_index_blocked"))
    return newest_per_folder(rows, limit)


def body_search(messages: DataFrame, queries: DataFrame, max_body_chars: int | None = 2000,
                allow_blocked_body: bool = False,
                keywords=policy.COMPENSATION_SUBJECT_KEYWORDS,
                extra_patterns=None, default_limit: int = 20, default_max_scan: int = 200) -> DataFrame:
    """Substring search over the newest bodies of a folder, for a batch of queries.

    ``queries`` has ``query_id, folder, query`` and optionally ``limit`` and
    ``max_scan``. Per query: take the newest ``max_scan`` messages of the
    folder (blocked and failed rows use up scan budget), drop blocked
    subjects (P5), keep bodies containing the case-folded query (P7), return
    the newest ``limit`` matches with redacted, cut bodies. ``messages`` may
    carry ``ok``; rows with ``ok = false`` count as fetch failures. A blank
    query finds nothing.
    """
    extra = validate_patterns(extra_patterns)
    q = queries.select(
        "query_id", "folder", "query",
        (F.col("limit") if "limit" in queries.columns else F.lit(default_limit)).alias("q_limit"),
        (F.col("max_scan") if "max_scan" in queries.columns else F.lit(default_max_scan)).alias("q_scan"),
    ).withColumn("q_folded", casefold("query")).filter(F.trim("query") != "")
    # Slice keys only, with a literal bound so Spark plans a partial WindowGroupLimit before the
    # shuffle (a hot folder sends at most `bound` keys per map task); bodies are joined afterwards,
    # for the sliced keys only. The bound is the widest max_scan of the (small) query batch.
    bound, least_scan, least_limit = q.agg(F.max("q_scan"), F.min("q_scan"), F.min("q_limit")).first()
    _check_positive("max_scan", least_scan)
    _check_positive("limit", least_limit)
    bound = bound or 0
    scan_n = q.groupBy("folder").agg(F.max("q_scan").alias("scan_n"))
    messages = restrict_folders(messages, q)
    cols = list(HEADER_COLUMNS) + ["body", "body_text_type", "truncated"]
    ok = F.col("ok") if "ok" in messages.columns else F.lit(True)
    w = Window.partitionBy("folder").orderBy(F.col("uid").desc())
    keys = (messages.join(scan_n.select("folder"), "folder", "left_semi").select("folder", "uid")
            .withColumn("scan_rank", F.row_number().over(w))
            .filter(F.col("scan_rank") <= F.lit(int(bound)))
            .join(scan_n, "folder")
            .filter(F.col("scan_rank") <= F.col("scan_n")))
    ranked = keys.join(messages.select(*cols, ok.alias("ok")), ["folder", "uid"])
    skip = policy.contains_keyword("subject", keywords) & F.lit(not allow_blocked_body)
    hits = (ranked.join(q, "folder")
            .filter(F.col("scan_rank") <= F.col("q_scan"))
            .filter(~skip & F.col("ok"))
            .filter(F.coalesce(casefold("body"), F.lit("")).contains(F.col("q_folded"))))
    wq = Window.partitionBy("query_id").orderBy(F.col("uid").desc())
    top = (hits.withColumn("rank", F.row_number().over(wq))
           .filter(F.col("rank") <= F.col("q_limit"))
           .select("query_id", *cols, "rank",
                   F.lit(False).alias("blocked"), F.lit(False).alias("can_override"),
                   F.lit(None).cast("string").alias("block_reason")))
    return redact_body(top, max_body_chars, extra)


def read_new(source: DataFrame, reader_state: DataFrame, limit: int = 50,
             run_ts=None, keywords=policy.COMPENSATION_SUBJECT_KEYWORDS,
             extra_patterns=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read messages above each folder's checkpoint.

    ``source`` is the mailbox: ``folder, uid, uidvalidity, subject, sender,
    date`` and optionally ``ok`` (header fetch succeeded).
    ``reader_state`` is ``folder, last_uid, uidvalidity``.

    Resume after ``last_uid`` only when checkpoint and both epochs are known
    and equal; otherwise restart at uid 1. The oldest ``limit`` uids are
    fetched and the result stops at the first failure. The checkpoint moves
    (with the current epoch) only when rows were returned.

    Returns (messages, new_state, summary) where summary has one row per
    listed folder: folder, uidvalidity, previous_last_uid, new_last_uid.
    """
    _check_positive("limit", limit)
    extra = validate_patterns(extra_patterns)
    ts = run_ts if run_ts is not None else F.current_timestamp()
    ok = F.col("ok") if "ok" in source.columns else F.lit(True)
    folders = source.groupBy("folder").agg(F.max("uidvalidity").alias("cur_epoch"))
    st = reader_state.select("folder", F.col("last_uid").alias("prev_last_uid"),
                             F.col("uidvalidity").alias("prev_epoch"))
    gate = folders.join(st, "folder", "left").withColumn(
        "start_uid",
        F.when(F.col("prev_last_uid").isNotNull() & F.col("cur_epoch").isNotNull()
               & F.col("prev_epoch").isNotNull() & (F.col("cur_epoch") == F.col("prev_epoch")),
               F.col("prev_last_uid") + 1).otherwise(F.lit(1)))
    cand = (source.select(*HEADER_COLUMNS, ok.alias("ok"))
            .join(gate.select("folder", "start_uid"), "folder")
            .filter(F.col("uid") >= F.col("start_uid")))
    cand = oldest_per_folder(cand, limit)
    gap = cand.groupBy("folder").agg(F.min(F.when(~F.col("ok"), F.col("uid"))).alias("gap_uid"))
    got = (cand.join(gap, "folder")
           .filter(F.col("gap_uid").isNull() | (F.col("uid") < F.col("gap_uid")))
           .drop("gap_uid", "ok", "start_uid"))
    out = redact_summary(with_block_flags(got, keywords), extra)
    new_max = got.groupBy("folder").agg(F.max("uid").alias("got_max"))
    summary = (gate.join(new_max, "folder", "left")
               .select("folder", F.col("cur_epoch").alias("uidvalidity"), "prev_last_uid",
                       F.coalesce("got_max", "prev_last_uid").alias("new_last_uid"),
                       F.col("got_max").isNotNull().alias("moved"),
                       F.col("prev_epoch")))
    moved = summary.filter("moved").select(
        "folder", F.col("new_last_uid").alias("last_uid"), "uidvalidity",
        ts.cast("timestamp").alias("updated_at"))
    kept = (reader_state.select("folder", "last_uid", "uidvalidity",
                                (F.col("updated_at") if "updated_at" in reader_state.columns
                                 else F.lit(None).cast("timestamp")).alias("updated_at"))
            .join(moved.select("folder"), "folder", "left_anti"))
    new_state = kept.unionByName(moved)
    return out, new_state, summary.drop("moved", "prev_epoch").withColumnRenamed(
        "prev_last_uid", "previous_last_uid")
