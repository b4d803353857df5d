"""Incremental index synchronisation for many folders at once.

The original tool syncs one folder per call and decides with Python
branches. Here every decision is a column of a per-folder table, work lists
are window slices and anti joins, and the upsert is copy-on-write: rows of
untouched messages are carried over, touched ones replaced. A folder that
holds a third of all messages is still processed across many tasks, since
only the bounded slices (``initial_limit``, ``incremental_limit``) are
windowed per folder and everything else is keyed by ``(folder, uid)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..session import checkpoint_dir, few
from ..sources.tables import MESSAGE_SCHEMA
from .digests import missing
from .reading import active_blocked


def apply_index_policy(source: DataFrame, keywords=policy.COMPENSATION_SUBJECT_KEYWORDS,
                       reason: str | None = policy.COMPENSATION_BLOCK_REASON) -> DataFrame:
    """Index form of the subject policy.

    A blocked message keeps its header, gets an empty body, type
    ``blocked`` and ``body_index_blocked``; its body column is never read
    for it. Pass ``keywords=None`` to index every body (override).
    """
    blocked = policy.contains_keyword("subject", keywords)
    cols = ["folder", "uid", "subject", "sender", "date"]
    extra = [c for c in ("uidvalidity", "ok") if c in source.columns]
    return source.select(
        *cols, *extra,
        F.when(blocked, F.lit("")).otherwise(F.col("body")).alias("body"),
        F.when(blocked, F.lit("blocked")).otherwise(F.col("body_text_type")).alias("body_text_type"),
        F.when(blocked, F.lit(False)).otherwise(F.col("truncated")).alias("truncated"),
        blocked.alias("body_index_blocked"),
        F.when(blocked, F.lit(reason)).otherwise(F.lit(None).cast("string")).alias("block_reason"),
    )


# ---------------------------------------------------------------- sync


@dataclass(frozen=True)
class SyncOptions:
    initial_limit: int = 2000
    incremental_limit: int = 100
    full_check: bool = False
    allow_blocked_body: bool = False
    keywords: tuple[str, ...] | None = policy.COMPENSATION_SUBJECT_KEYWORDS
    block_reason: str | None = policy.COMPENSATION_BLOCK_REASON
    full_check_interval: str = "1 day"

    def validate(self) -> None:
        for name in ("initial_limit", "incremental_limit"):
            if int(getattr(self, name)) < 1:
                raise ValueError(f"{name} must be greater than 0")


@dataclass(frozen=True)
class SyncResult:
    messages: DataFrame   # the new index table
    state: DataFrame      # the new folder_state
    metrics: DataFrame    # one row per listed folder (I13)
    worklist: DataFrame   # folder, uid, reason, checkpoint
    indexed: DataFrame    # rows written this run (input of the postings refresh, I8)
    reset_folders: DataFrame
    changed: DataFrame    # messages this run wrote or soft-deleted; ``fresh``: written (S7)


def needs_reset(prev_epoch: Column, cur_epoch: Column, has_state: Column) -> Column:
    """Index epoch gate (I3a): reset only when both epochs are known and differ."""
    return has_state & prev_epoch.isNotNull() & cur_epoch.isNotNull() & (prev_epoch != cur_epoch)


def full_check_due(last_check: Column, run_ts: Column, interval: str = "1 day",
                   forced: bool = False) -> Column:
    """Forced, never run, unparsable, or at least ``interval`` old."""
    due = last_check.isNull() | (last_check <= run_ts - F.expr(f"INTERVAL {interval}"))
    return F.lit(True) if forced else due


def folder_decisions(listing: DataFrame, messages: DataFrame, state: DataFrame,
                     opts: SyncOptions, run_ts: Column) -> DataFrame:
    """One row per listed folder with every per-folder decision as a column."""
    info = listing.groupBy("folder").agg(
        F.max("uidvalidity").alias("cur_epoch"),
        F.bool_and(F.coalesce("listing_ok", F.lit(True))).alias("listing_ok"))
    check = state["last_full_check_at"]
    if dict(state.dtypes)["last_full_check_at"] == "string":
        check = F.try_to_timestamp(check)
    prev = state.select("folder", F.lit(True).alias("has_state"),
                        F.col("uidvalidity").alias("prev_epoch"), F.col("last_uid").alias("prev_last_uid"),
                        check.alias("prev_check"))
    n_active = messages.filter(~F.col("is_deleted")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_active"))
    d = (info.join(prev, "folder", "left").join(n_active, "folder", "left")
         .withColumn("has_state", F.coalesce("has_state", F.lit(False)))
         .withColumn("n_active", F.coalesce("n_active", F.lit(0))))
    reset = needs_reset(F.col("prev_epoch"), F.col("cur_epoch"), F.col("has_state"))
    d = d.withColumn("reset", reset)
    d = d.withColumns({
        "eff_last_uid": F.when(F.col("reset"), F.lit(None).cast("long")).otherwise(F.col("prev_last_uid")),
        "eff_check": F.when(F.col("reset"), F.lit(None).cast("timestamp")).otherwise(F.col("prev_check")),
        "needs_backfill": F.col("has_state") & F.col("prev_last_uid").isNotNull()
        & (F.when(F.col("reset"), F.lit(0)).otherwise(F.col("n_active")) < F.lit(int(opts.initial_limit))),
    })
    due = full_check_due(F.col("eff_check"), run_ts, opts.full_check_interval, opts.full_check)
    # a failed listing never counts as a full check: nothing is deleted and the time is kept
    return d.withColumns({
        "first_load": F.col("eff_last_uid").isNull(),
        "did_full_check": due & F.col("listing_ok"),
    })


def build_worklist(listing: DataFrame, messages: DataFrame, decisions: DataFrame,
                   opts: SyncOptions) -> DataFrame:
    """Ordered, disjoint work lists: initial, new, backfill, blocked.

    Slices are ``dense_rank() <= n`` per folder (partial WindowGroupLimit
    before the shuffle). Returns ``folder, uid, reason, checkpoint`` where
    ``checkpoint`` marks the uids that may move the checkpoint.
    """
    d = decisions.select("folder", "first_load", "eff_last_uid", "needs_backfill", "reset")
    listed = listing.filter(F.col("uid").isNotNull()).select("folder", "uid").join(d, "folder")
    w_desc = Window.partitionBy("folder").orderBy(F.col("uid").desc())
    w_asc = Window.partitionBy("folder").orderBy(F.col("uid").asc())
    # a uid that is listed more than once has one rank, and leaves one row of the slice
    recent = (listed.withColumn("r", F.dense_rank().over(w_desc))
              .filter(F.col("r") <= F.lit(int(opts.initial_limit))).drop("r").distinct())
    initial = recent.filter("first_load").select("folder", "uid", F.lit("initial").alias("reason"),
                                                 F.lit(True).alias("checkpoint"))
    new = (listed.filter(~F.col("first_load") & (F.col("uid") > F.col("eff_last_uid")))
           .withColumn("r", F.dense_rank().over(w_asc))
           .filter(F.col("r") <= F.lit(int(opts.incremental_limit)))
           .select("folder", "uid", F.lit("new").alias("reason"), F.lit(True).alias("checkpoint")).distinct())
    active_keys = messages.filter(~F.col("is_deleted")).select("folder", "uid")
    backfill = (recent.filter(~F.col("first_load") & F.col("needs_backfill"))
                .select("folder", "uid")
                .join(active_keys, ["folder", "uid"], "left_anti")
                .join(new.select("folder", "uid"), ["folder", "uid"], "left_anti")
                .select("folder", "uid", F.lit("backfill").alias("reason"), F.lit(False).alias("checkpoint")))
    out = initial.unionByName(new).unionByName(backfill)
    if opts.allow_blocked_body:
        known = messages.join(d.filter(~F.col("first_load")).select("folder"), "folder", "left_semi")
        blocked = (active_blocked(known, opts.initial_limit).select("folder", "uid")
                   .join(new.select("folder", "uid"), ["folder", "uid"], "left_anti")
                   .join(backfill.select("folder", "uid"), ["folder", "uid"], "left_anti")
                   .select("folder", "uid", F.lit("blocked").alias("reason"), F.lit(False).alias("checkpoint")))
        out = out.unionByName(blocked)
    return out


def _sized(keys: DataFrame) -> DataFrame:
    """Checkpointed ``keys`` as the built side of a join: sent to every task where few, else hashed by partition.

    Either way the texts they meet stream past them and are not sorted, so a
    task holds keys, and no more of them as texts grow longer.
    """
    return few(keys, many="shuffle_hash")


def _one_per_key(source: DataFrame, materialize: bool = False) -> DataFrame:
    """One row per (folder, uid): a fetched one before a failed one, then by a hash of the row.

    With ``materialize`` the keys that repeat are found first, without texts;
    only their rows are compared, and the others are not sorted for it. Keys
    are not null.
    """
    if materialize:
        keys = source.groupBy("folder", "uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("folder", "uid").checkpoint(eager=True)
        if keys.isEmpty():
            return source
        again = _sized(keys)
        return source.join(again, ["folder", "uid"], "left_anti").unionByName(_one_per_key(source.join(again, ["folder", "uid"], "left_semi")))
    order = F.struct((~F.coalesce("ok", F.lit(False))).alias("failed"), F.xxhash64(*[c for c in source.columns if c != "ok"]).alias("h"))
    return source.groupBy("folder", "uid").agg(F.min_by(F.struct("*"), order).alias("row")).select("row.*")


def sync(listing: DataFrame, source: DataFrame, messages: DataFrame, state: DataFrame,
         opts: SyncOptions = SyncOptions(), run_ts: Column | str | None = None,
         materialize: bool = True) -> SyncResult:
    """Synchronise the index of every listed folder in one pass.

    ``listing(folder, uid, uidvalidity, listing_ok)``: what each folder
    listing returned (a listed, empty folder is one row with uid NULL; a uid
    listed more than once counts once).
    ``source``: the fetchable messages with ``ok`` (fetch succeeded); of
    several rows of a message one that succeeded is taken.
    ``messages`` / ``state``: the current index table and folder_state.

    Order of effects matches the original: reset, upsert, checkpoint,
    full check. The caller writes messages and postings before the state,
    so a crash replays a run instead of skipping messages.

    With ``materialize`` the per-folder decisions and the fetched work list
    (bounded by the slice limits per folder) are checkpointed to the shared
    checkpoint folder, so writing messages, postings, state and metrics does
    not recompute them, and a lost executor does not send the run back to
    the listing.
    """
    opts.validate()
    ts = F.lit(run_ts).cast("timestamp") if isinstance(run_ts, str) else (
        run_ts if run_ts is not None else F.current_timestamp())
    d = folder_decisions(listing, messages, state, opts, ts)
    if materialize:
        checkpoint_dir(listing.sparkSession)
        d = d.checkpoint(eager=True)
    work = build_worklist(listing, messages, d, opts)
    asked = work
    if materialize:
        work = work.checkpoint(eager=True)
        asked = _sized(work)

    ok = F.coalesce(F.col("ok"), F.lit(True)) if "ok" in source.columns else F.lit(True)
    src = source.select("folder", "uid", "subject", "sender", "date", "body", "body_text_type",
                        "truncated", ok.alias("ok"), F.lit(True).alias("found"))
    # semi-join first: only work-list rows leave the mailbox scan (the small key side can be
    # broadcast); the left join that marks missing uids then runs between two small sides
    src = _one_per_key(src.join(asked.select("folder", "uid"), ["folder", "uid"], "left_semi"), materialize)
    if materialize:
        # the same rows as the left join, with the texts on the streamed side
        found = src.join(asked, ["folder", "uid"])
        absent = work.join(src.select("folder", "uid"), ["folder", "uid"], "left_anti")
        fetched = found.unionByName(absent, allowMissingColumns=True)
    else:
        fetched = work.join(src, ["folder", "uid"], "left")
    fetched = (fetched
               .withColumn("ok", F.coalesce(F.col("found"), F.lit(False)) & F.coalesce(F.col("ok"), F.lit(False))))
    if materialize:
        fetched = fetched.checkpoint(eager=True)
        work = fetched.select("folder", "uid", "reason", "checkpoint")
    keywords = None if opts.allow_blocked_body else opts.keywords
    # few rows, counted: the texts are not dealt out by folder, nor by key for the soft deletes
    epochs = d.select("folder", "cur_epoch")
    epochs = few(epochs) if materialize else epochs
    indexed = (apply_index_policy(fetched.filter("ok"), keywords, opts.block_reason)
               .join(epochs, "folder")
               .select("folder", "uid", F.col("cur_epoch").alias("uidvalidity"), "subject", "sender", "date",
                       "body", "body_text_type", "truncated", "body_index_blocked", "block_reason",
                       F.lit(False).alias("is_deleted"), ts.cast("timestamp").alias("synced_at"),
                       F.lit(None).cast("timestamp").alias("deleted_at")))

    # checkpoint: the contiguous successful prefix of the checkpoint uids (I4 A1 A3)
    ck = fetched.filter("checkpoint").groupBy("folder").agg(
        F.min(F.when(~F.col("ok"), F.col("uid"))).alias("gap_uid"),
        F.count_if(F.col("ok")).alias("n_ok"))
    done = (fetched.filter("checkpoint").filter("ok").join(ck.select("folder", "gap_uid"), "folder")
            .filter(F.col("gap_uid").isNull() | (F.col("uid") < F.col("gap_uid")))
            .groupBy("folder").agg(F.max("uid").alias("done_max")))
    counts = fetched.groupBy("folder").agg(F.count_if(F.col("ok")).alias("indexed_count"))

    reset_folders = d.filter("reset").select("folder")
    cols = [f.name for f in MESSAGE_SCHEMA.fields]
    written = _sized(fetched.filter("ok").select("folder", "uid")) if materialize else indexed.select("folder", "uid")
    kept = (messages.select(*cols)
            .join(few(reset_folders) if materialize else reset_folders, "folder", "left_anti")
            .join(written, ["folder", "uid"], "left_anti"))
    upserted = kept.withColumn("fresh", F.lit(False)).unionByName(indexed.select(*cols, F.lit(True).alias("fresh")))

    # soft delete: active rows missing from a successful full listing
    # Only folders due for a full check meet the listing, and of those only the uid ranges whose digests differ
    checked = d.filter("did_full_check").select("folder")
    # (what this run fetched was listed, or was held before)
    listed = listing.select("folder", "uid").join(checked, "folder", "left_semi")
    held = (messages.filter(~F.col("is_deleted")).select("folder", "uid").join(checked, "folder", "left_semi")
            .join(reset_folders, "folder", "left_anti"))
    gone = missing(held, listed).withColumn("gone", F.lit(True))
    gone = few(gone.checkpoint(eager=True)) if materialize else gone
    marked = (upserted.join(gone, ["folder", "uid"], "left")
              .withColumn("gone", ~F.col("is_deleted") & F.coalesce("gone", F.lit(False))))
    new_messages = marked.select(
        *[c for c in cols if c not in ("is_deleted", "deleted_at")],
        (F.col("is_deleted") | F.col("gone")).alias("is_deleted"),
        F.when(F.col("gone"), ts.cast("timestamp")).otherwise(F.col("deleted_at")).alias("deleted_at"),
        "gone", "fresh",
    )
    deleted = new_messages.filter("gone").groupBy("folder").agg(F.count(F.lit(1)).alias("deleted_count"))
    changed = new_messages.filter("gone or fresh").select(*cols, "fresh")
    new_messages = new_messages.select(*cols)

    per = (d.join(done, "folder", "left").join(counts, "folder", "left").join(deleted, "folder", "left")
           .withColumn("last_uid", F.greatest(F.col("eff_last_uid"), F.col("done_max"))))
    metrics = per.select(
        "folder", F.col("cur_epoch").alias("uidvalidity"),
        F.coalesce("indexed_count", F.lit(0)).alias("indexed_count"),
        F.coalesce("deleted_count", F.lit(0)).alias("deleted_count"),
        "last_uid", "reset", F.col("did_full_check").alias("full_check"))
    touched_state = per.select(
        "folder", F.col("cur_epoch").alias("uidvalidity"), "last_uid",
        F.when(F.col("did_full_check"), ts.cast("timestamp")).otherwise(F.col("eff_check"))
        .alias("last_full_check_at"))
    st = state
    if dict(state.dtypes)["last_full_check_at"] == "string":
        st = state.withColumn("last_full_check_at", F.try_to_timestamp("last_full_check_at"))
    untouched = st.select("folder", "uidvalidity", "last_uid", "last_full_check_at").join(
        d.select("folder"), "folder", "left_anti")
    return SyncResult(new_messages, untouched.unionByName(touched_state), metrics, work,
                      indexed, reset_folders, changed)


def refresh_index_after(index, result: SyncResult, with_positions: bool = False):
    """Postings refresh for a sync result (I8 + I6)."""
    from .index import refresh_index

    return refresh_index(index, result.indexed, result.reset_folders, with_positions, result.messages)
