"""Sync and reader scenarios over the fixture corpus, with their SQL oracles.

Prior run: the lower half of every folder (uid below half of the largest
doc_id) is indexed; the folder state records its highest uid. Then the
server moves on:

* the listing has the whole corpus except the "gone" messages;
* "failed" messages cannot be fetched;
* folders src1-src3 had a full check six hours ago (not due), the others three days ago;
* folders src4 and src5 changed epoch (776 -> 777): reset;
* folder src6 has no state: first load;
* folder src7's listing failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import reading, sync
from ..session import scratch_path
from ..sources import tables
from ..sources.store import MailStore, commit_sync, write_full
from . import catalog
from . import fixture as fx
from . import oracle as o
from .catalog import register

# --- fixed values: scenario folders and limits ---
FRESH_FOLDERS = ("src1", "src2", "src3")
RESET_FOLDERS = ("src4", "src5")
NEW_FOLDER = "src6"
FAILED_LISTING = "src7"
OLD_EPOCH = 776
PRIOR_SYNC_TS = "2026-05-28 12:00:00"
INITIAL_LIMIT = 30
INCREMENTAL_LIMIT = 10
READ_LIMIT = 10
# --- end fixed values ---

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _in(col: str, values) -> str:
    return f"{col} IN ({', '.join(o.q(v) for v in values)})"


def _half(spark, d) -> F.Column:
    return catalog.documents(spark, d).select((F.max("doc_id") / 2).alias("h")).scalar()


def prior_messages(spark: SparkSession, d: str) -> DataFrame:
    src = catalog.source(spark, d)
    rows = sync.apply_index_policy(src.filter(F.col("uid") < _half(spark, d)), fx.POLICY_KEYWORDS)
    return rows.select(
        "folder", "uid", "uidvalidity", "subject", "sender", "date", "body", "body_text_type", "truncated",
        "body_index_blocked", "block_reason", F.lit(False).alias("is_deleted"),
        F.lit(PRIOR_SYNC_TS).cast("timestamp").alias("synced_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"))


def prior_state(spark: SparkSession, d: str) -> DataFrame:
    p = prior_messages(spark, d).filter(F.col("folder") != F.lit(NEW_FOLDER))
    return p.groupBy("folder").agg(F.max("uid").alias("last_uid")).select(
        "folder",
        F.when(F.col("folder").isin(*RESET_FOLDERS), F.lit(OLD_EPOCH))
        .otherwise(F.lit(tables.FIXTURE_UIDVALIDITY)).cast("long").alias("uidvalidity"),
        "last_uid",
        F.when(F.col("folder").isin(*FRESH_FOLDERS), F.lit(fx.FRESH_CHECK_TS))
        .otherwise(F.lit(fx.OLD_CHECK_TS)).cast("timestamp").alias("last_full_check_at"))


def listing(spark: SparkSession, d: str) -> DataFrame:
    src = catalog.source(spark, d)
    ok = (src.filter(fx.still_listed(F.col("uid")) & (F.col("folder") != F.lit(FAILED_LISTING)))
          .select("folder", "uid", "uidvalidity", F.lit(True).alias("listing_ok")))
    failed = (src.filter(F.col("folder") == F.lit(FAILED_LISTING)).groupBy("folder")
              .agg(F.max("uidvalidity").alias("uidvalidity"))
              .select("folder", F.lit(None).cast("long").alias("uid"), "uidvalidity",
                      F.lit(False).alias("listing_ok")))
    return ok.unionByName(failed)


def mailbox(spark: SparkSession, d: str) -> DataFrame:
    return catalog.source(spark, d).withColumn("ok", fx.fetch_ok(F.col("uid")))


def run(spark: SparkSession, d: str, allow_blocked: bool = False, prior: tuple[DataFrame, DataFrame] | None = None) -> sync.SyncResult:
    """The second run over ``prior`` (messages, state), by default what the first left."""
    opts = sync.SyncOptions(INITIAL_LIMIT, INCREMENTAL_LIMIT, False, allow_blocked, fx.POLICY_KEYWORDS,
                            policy.COMPENSATION_BLOCK_REASON)
    messages, state = prior or (prior_messages(spark, d), prior_state(spark, d))
    return sync.sync(listing(spark, d), mailbox(spark, d), messages, state, opts, fx.RUN_TS)


def _fmt(c: str) -> F.Column:
    return F.date_format(F.col(c), TS_FMT).alias(c)


# ------------------------------------------------------------------ SQL

def _policy_cols(blocked: str) -> str:
    return (f"CASE WHEN {blocked} THEN '' ELSE body END AS body, "
            f"CASE WHEN {blocked} THEN 'blocked' ELSE 'plain' END AS body_text_type, false AS truncated, "
            f"{blocked} AS body_index_blocked, CASE WHEN {blocked} THEN 'COMPENSATION_SUBJECT' END AS block_reason")


def _scenario_sql(allow_blocked: bool = False) -> str:
    blocked = o.contains_any_sql("subject", fx.POLICY_KEYWORDS)
    run_ts = f"TIMESTAMP '{fx.RUN_TS}'"
    blocked_now = "false" if allow_blocked else blocked
    blocked_cte = ""
    blocked_union = ""
    if allow_blocked:
        blocked_cte = f""",
bl AS (SELECT folder, uid, 'blocked' AS reason, false AS checkpoint FROM (
         SELECT p.folder, p.uid, row_number() OVER (PARTITION BY p.folder ORDER BY p.uid DESC) AS r
         FROM prior p JOIN d4 USING (folder) WHERE NOT d4.first_load AND p.body_index_blocked AND NOT p.is_deleted) x
       WHERE r <= {INITIAL_LIMIT}
         AND (folder, uid) NOT IN (SELECT (folder, uid) FROM nw)
         AND (folder, uid) NOT IN (SELECT (folder, uid) FROM bf))"""
        blocked_union = " UNION ALL SELECT * FROM bl"
    return f"""
WITH {o.MESSAGES_CTE},
h AS (SELECT max(doc_id) / 2 AS h FROM documents),
prior AS (SELECT folder, uid, uidvalidity, subject, sender, date, {_policy_cols(blocked)},
                 false AS is_deleted, TIMESTAMP '{PRIOR_SYNC_TS}' AS synced_at, CAST(NULL AS TIMESTAMP) AS deleted_at
          FROM m, h WHERE uid < h.h),
pstate AS (SELECT folder, CASE WHEN {_in('folder', RESET_FOLDERS)} THEN {OLD_EPOCH} ELSE 777 END AS uidvalidity,
                  max(uid) AS last_uid,
                  CASE WHEN {_in('folder', FRESH_FOLDERS)} THEN TIMESTAMP '{fx.FRESH_CHECK_TS}'
                       ELSE TIMESTAMP '{fx.OLD_CHECK_TS}' END AS last_full_check_at
           FROM prior WHERE folder <> '{NEW_FOLDER}' GROUP BY folder),
listing AS (SELECT folder, uid, uidvalidity, true AS listing_ok FROM m
            WHERE uid % {fx.GONE_EVERY} <> 0 AND folder <> '{FAILED_LISTING}'
            UNION ALL SELECT folder, CAST(NULL AS BIGINT), max(uidvalidity), false FROM m
            WHERE folder = '{FAILED_LISTING}' GROUP BY folder),
src AS (SELECT m.*, uid % {fx.FAIL_EVERY} <> 0 AS ok FROM m),
fi AS (SELECT folder, max(uidvalidity) AS cur_epoch, bool_and(listing_ok) AS listing_ok FROM listing GROUP BY 1),
act AS (SELECT folder, count(*) AS n_active FROM prior WHERE NOT is_deleted GROUP BY 1),
d2 AS (SELECT fi.folder, fi.cur_epoch, fi.listing_ok, s.folder IS NOT NULL AS has_state,
              s.uidvalidity AS prev_epoch, s.last_uid AS prev_last, s.last_full_check_at AS prev_check,
              coalesce(act.n_active, 0) AS n_active,
              (s.folder IS NOT NULL AND s.uidvalidity IS NOT NULL AND fi.cur_epoch IS NOT NULL
               AND s.uidvalidity <> fi.cur_epoch) AS reset
       FROM fi LEFT JOIN pstate s USING (folder) LEFT JOIN act USING (folder)),
d3 AS (SELECT *, CASE WHEN reset THEN NULL ELSE prev_last END AS eff_last,
              CASE WHEN reset THEN NULL ELSE prev_check END AS eff_check,
              has_state AND prev_last IS NOT NULL
                AND (CASE WHEN reset THEN 0 ELSE n_active END) < {INITIAL_LIMIT} AS needs_backfill FROM d2),
d4 AS (SELECT *, eff_last IS NULL AS first_load,
              (eff_check IS NULL OR eff_check <= {run_ts} - INTERVAL 1 DAY) AND listing_ok AS did_full FROM d3),
lr AS (SELECT l.folder, l.uid, row_number() OVER (PARTITION BY l.folder ORDER BY l.uid DESC) AS rdesc
       FROM listing l WHERE l.uid IS NOT NULL),
ini AS (SELECT lr.folder, lr.uid, 'initial' AS reason, true AS checkpoint FROM lr JOIN d4 USING (folder)
        WHERE d4.first_load AND lr.rdesc <= {INITIAL_LIMIT}),
nw AS (SELECT folder, uid, 'new' AS reason, true AS checkpoint FROM (
         SELECT l.folder, l.uid, row_number() OVER (PARTITION BY l.folder ORDER BY l.uid) AS r
         FROM listing l JOIN d4 USING (folder)
         WHERE l.uid IS NOT NULL AND NOT d4.first_load AND l.uid > d4.eff_last) x WHERE r <= {INCREMENTAL_LIMIT}),
bf AS (SELECT lr.folder, lr.uid, 'backfill' AS reason, false AS checkpoint FROM lr JOIN d4 USING (folder)
       WHERE NOT d4.first_load AND d4.needs_backfill AND lr.rdesc <= {INITIAL_LIMIT}
         AND (lr.folder, lr.uid) NOT IN (SELECT (folder, uid) FROM prior WHERE NOT is_deleted)
         AND (lr.folder, lr.uid) NOT IN (SELECT (folder, uid) FROM nw)){blocked_cte},
wl AS (SELECT * FROM ini UNION ALL SELECT * FROM nw UNION ALL SELECT * FROM bf{blocked_union}),
f AS (SELECT wl.*, coalesce(s.ok, false) AS ok, s.subject, s.sender, s.date, s.body, d4.cur_epoch
      FROM wl LEFT JOIN src s USING (folder, uid) JOIN d4 USING (folder)),
got AS (SELECT folder, uid, cur_epoch AS uidvalidity, subject, sender, date, {_policy_cols(blocked_now)},
               false AS is_deleted, {run_ts} AS synced_at, CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM f WHERE ok),
gap AS (SELECT folder, min(uid) FILTER (WHERE NOT ok) AS g FROM f WHERE checkpoint GROUP BY 1),
done AS (SELECT f.folder, max(f.uid) AS done_max FROM f LEFT JOIN gap USING (folder)
         WHERE f.checkpoint AND f.ok AND (gap.g IS NULL OR f.uid < gap.g) GROUP BY 1),
cnt AS (SELECT folder, count(*) FILTER (WHERE ok) AS indexed_count FROM f GROUP BY 1),
ups AS (SELECT * FROM prior WHERE folder NOT IN (SELECT folder FROM d4 WHERE reset)
          AND (folder, uid) NOT IN (SELECT (folder, uid) FROM got)
        UNION ALL SELECT * FROM got),
mk AS (SELECT ups.*, (d4.did_full IS TRUE AND NOT ups.is_deleted
                      AND (ups.folder, ups.uid) NOT IN (SELECT (folder, uid) FROM listing WHERE uid IS NOT NULL)) AS gone
       FROM ups LEFT JOIN d4 USING (folder)),
msgs AS (SELECT folder, uid, uidvalidity, subject, sender, date, body, body_text_type, truncated,
                body_index_blocked, block_reason, is_deleted OR gone AS is_deleted, synced_at,
                CASE WHEN gone THEN {run_ts} ELSE deleted_at END AS deleted_at, gone FROM mk),
del AS (SELECT folder, count(*) AS deleted_count FROM msgs WHERE gone GROUP BY 1),
per AS (SELECT d4.*, coalesce(cnt.indexed_count, 0) AS indexed_count, coalesce(del.deleted_count, 0) AS deleted_count,
               CASE WHEN d4.eff_last IS NULL THEN done.done_max WHEN done.done_max IS NULL THEN d4.eff_last
                    ELSE greatest(d4.eff_last, done.done_max) END AS last_uid
        FROM d4 LEFT JOIN done USING (folder) LEFT JOIN cnt USING (folder) LEFT JOIN del USING (folder)),
newstate AS (SELECT folder, uidvalidity, last_uid, last_full_check_at FROM pstate WHERE folder NOT IN (SELECT folder FROM d4)
             UNION ALL SELECT folder, cur_epoch, last_uid, CASE WHEN did_full THEN {run_ts} ELSE eff_check END FROM per)
"""


def _ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


SQL_WORKLIST = _scenario_sql() + "SELECT folder, uid, reason, checkpoint FROM wl"
SQL_STATE = _scenario_sql() + f"SELECT folder, uidvalidity, last_uid, {_ts_sql('last_full_check_at')} FROM newstate"
SQL_MESSAGES = _scenario_sql() + (
    "SELECT folder, uid, uidvalidity, subject, sender, date, md5(body) AS body_md5, body_text_type, truncated, "
    f"body_index_blocked, block_reason, is_deleted, {_ts_sql('synced_at')}, {_ts_sql('deleted_at')} FROM msgs")
SQL_DELETED = _scenario_sql() + f"SELECT folder, uid, {_ts_sql('deleted_at')} FROM msgs WHERE is_deleted"
SQL_METRICS = _scenario_sql() + (
    "SELECT folder, cur_epoch AS uidvalidity, indexed_count, deleted_count, last_uid, reset, "
    "did_full AS full_check FROM per")
SQL_RESET = _scenario_sql() + (
    f"SELECT folder, uid, uidvalidity, body_text_type FROM msgs WHERE {_in('folder', RESET_FOLDERS)}")
SQL_OVERRIDE = _scenario_sql(True) + (
    "SELECT w.folder, w.uid, w.reason, w.checkpoint, g.body_index_blocked, md5(g.body) AS body_md5 "
    "FROM wl w LEFT JOIN got g USING (folder, uid)")
SQL_DUE = _scenario_sql() + (
    f"SELECT folder, (last_full_check_at IS NULL OR last_full_check_at <= TIMESTAMP '{fx.RUN_TS}' - INTERVAL 1 DAY)"
    " AS due FROM pstate")


def _messages_out(df: DataFrame) -> DataFrame:
    return df.select("folder", "uid", "uidvalidity", "subject", "sender", "date",
                     F.md5(F.col("body")).alias("body_md5"), "body_text_type", "truncated",
                     "body_index_blocked", "block_reason", "is_deleted", _fmt("synced_at"), _fmt("deleted_at"))


register("sync_worklist", SQL_WORKLIST)(lambda spark, d: run(spark, d).worklist)
register("sync_checkpoint", SQL_STATE)(
    lambda spark, d: run(spark, d).state.select("folder", "uidvalidity", "last_uid", _fmt("last_full_check_at")))
register("sync_upsert", SQL_MESSAGES)(lambda spark, d: _messages_out(run(spark, d).messages))


@register("store_commit", SQL_MESSAGES)
def store_commit(spark, d):
    store = MailStore(spark, scratch_path(spark, "store-commit"))
    write_full(store, prior_messages(spark, d), prior_state(spark, d))
    commit_sync(store, run(spark, d, prior=(store.messages(), store.state())))
    return _messages_out(store.messages())


register("sync_deleted", SQL_DELETED)(
    lambda spark, d: run(spark, d).messages.filter("is_deleted").select("folder", "uid", _fmt("deleted_at")))
register("sync_metrics", SQL_METRICS)(lambda spark, d: run(spark, d).metrics)
register("sync_reset", SQL_RESET)(
    lambda spark, d: run(spark, d).messages.filter(F.col("folder").isin(*RESET_FOLDERS))
    .select("folder", "uid", "uidvalidity", "body_text_type"))


@register("sync_override", SQL_OVERRIDE)
def sync_override(spark, d):
    r = run(spark, d, allow_blocked=True)
    got = r.indexed.select("folder", "uid", "body_index_blocked", F.md5(F.col("body")).alias("body_md5"))
    return r.worklist.join(got, ["folder", "uid"], "left")


register("full_check_due", SQL_DUE)(
    lambda spark, d: prior_state(spark, d).select(
        "folder", sync.full_check_due(F.col("last_full_check_at"), F.lit(fx.RUN_TS).cast("timestamp"))
        .alias("due")))


# --------------------------------------------------------------- reader

def reader_state(spark: SparkSession, d: str) -> DataFrame:
    return prior_state(spark, d).select("folder", "last_uid", "uidvalidity",
                                        F.col("last_full_check_at").alias("updated_at"))


def read_new_run(spark, d):
    return reading.read_new(mailbox(spark, d), reader_state(spark, d), READ_LIMIT,
                            F.lit(fx.RUN_TS).cast("timestamp"), fx.POLICY_KEYWORDS)


def _reader_sql() -> str:
    blocked = o.contains_any_sql("subject", fx.POLICY_KEYWORDS)
    return f"""
WITH {o.MESSAGES_CTE},
h AS (SELECT max(doc_id) / 2 AS h FROM documents),
rs AS (SELECT folder, max(uid) AS last_uid,
              CASE WHEN {_in('folder', RESET_FOLDERS)} THEN {OLD_EPOCH} ELSE 777 END AS uidvalidity
       FROM m, h WHERE uid < h.h AND folder <> '{NEW_FOLDER}' GROUP BY folder),
src AS (SELECT m.*, uid % {fx.FAIL_EVERY} <> 0 AS ok FROM m),
g AS (SELECT f.folder, f.cur_epoch, rs.last_uid AS prev_last_uid, rs.uidvalidity AS prev_epoch,
             CASE WHEN rs.last_uid IS NOT NULL AND f.cur_epoch IS NOT NULL AND rs.uidvalidity IS NOT NULL
                       AND f.cur_epoch = rs.uidvalidity THEN rs.last_uid + 1 ELSE 1 END AS start_uid
      FROM (SELECT folder, max(uidvalidity) AS cur_epoch FROM src GROUP BY 1) f LEFT JOIN rs USING (folder)),
c AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.folder ORDER BY s.uid) AS rank
                     FROM src s JOIN g USING (folder) WHERE s.uid >= g.start_uid) x WHERE rank <= {READ_LIMIT}),
gap AS (SELECT folder, min(uid) FILTER (WHERE NOT ok) AS gu FROM c GROUP BY 1),
got AS (SELECT c.* FROM c JOIN gap USING (folder) WHERE gap.gu IS NULL OR c.uid < gap.gu),
mx AS (SELECT folder, max(uid) AS got_max FROM got GROUP BY 1)
"""


SQL_READ_NEW = _reader_sql() + (
    f"SELECT folder, uid, {o.redact_sql('subject')} AS subject, {o.redact_sql('sender')} AS sender, date, rank, "
    f"{o.contains_any_sql('subject', fx.POLICY_KEYWORDS)} AS body_read_blocked, "
    f"CASE WHEN {o.contains_any_sql('subject', fx.POLICY_KEYWORDS)} THEN 'COMPENSATION_SUBJECT' END AS block_reason "
    "FROM got")
SQL_READ_SUMMARY = _reader_sql() + (
    "SELECT folder, cur_epoch AS uidvalidity, prev_last_uid AS previous_last_uid, "
    "coalesce(got_max, prev_last_uid) AS new_last_uid FROM g LEFT JOIN mx USING (folder)")

register("read_new", SQL_READ_NEW)(lambda spark, d: read_new_run(spark, d)[0])
register("read_new_epoch", SQL_READ_SUMMARY)(lambda spark, d: read_new_run(spark, d)[2])
