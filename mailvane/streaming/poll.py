"""Polling reads and incremental index maintenance as Structured Streaming (ST1-ST4).

* ST1: ``readStream`` over a landing folder, ``trigger(availableNow=True)``
  for scheduled runs; the streaming checkpoint remembers which files were
  read.
* ST3: the position and epoch of every folder are a small table, written
  with each micro-batch. The batch is joined to the one from which its run
  started: rows above the stored uid pass, in whatever order the files of a
  run hold them; an epoch change or an unknown epoch restarts the folder.
* ST2: every micro-batch is a run of a ``MailStore``: its messages, their
  postings and lengths, what they replace, and the state last.
* ST4: ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds the work per micro-batch.

Rows never pass through Python and no folder is gathered in one task: the
only grouping by folder is a maximum, combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sync import needs_reset
from ..session import checkpoint_dir, few, scratch_path
from ..sources.store import MESSAGE_COLS, MailStore, commit_run, compact

POSITIONS = "folder string, uidvalidity long, last_uid long"


def message_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                   max_files_per_trigger: int | None = None, fmt: str = "parquet",
                   arrival: str | None = None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of message files landing under ``path`` (ST1, ST4).

    A micro-batch is bounded by files or by bytes (one file at least).
    ``arrival`` names a column to add: (file time, file path) of each row, by
    which ``upsert_batches`` can tell the later of two writes.
    """
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", int(max_bytes_per_trigger))
    rows = r.load(path)
    if arrival:
        rows = rows.withColumn(arrival, F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    return rows


def folder_epochs(batch: DataFrame) -> DataFrame:
    """``_folder, _epoch``: the epoch of each folder in a batch, the highest known one."""
    return batch.groupBy(F.col("folder").alias("_folder")).agg(F.max("uidvalidity").alias("_epoch"))


def _of_epoch(batch: DataFrame, epochs: DataFrame) -> DataFrame:
    """Rows of the folder's epoch, or of an unknown one; older epochs no longer name messages."""
    return batch.join(epochs, F.col("folder").eqNullSafe(F.col("_folder"))).filter(
        F.coalesce("uidvalidity", "_epoch").eqNullSafe(F.col("_epoch")))


def gate_new(batch: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows of ``batch`` above each folder's position; an epoch change restarts the folder (ST3).

    ``batch`` has ``folder, uid, uidvalidity``; ``positions(folder,
    uidvalidity, last_uid)`` has one row per folder read so far. A folder
    resumes only where both epochs are known and equal; rows of an epoch below
    the known one are late and do not pass. Inside a batch only rows of the
    folder's highest epoch count; a row of unknown epoch counts as one of that
    epoch.
    """
    known = positions.select(F.col("folder").alias("_f"), F.col("uidvalidity").alias("_known"), "last_uid")
    start = folder_epochs(batch).join(known, F.col("_folder").eqNullSafe(F.col("_f")), "left").select(
        "_folder", "_epoch", F.when(F.col("_known") == F.col("_epoch"), F.col("last_uid")).alias("_after"),
        F.coalesce(F.col("_epoch") < F.col("_known"), F.lit(False)).alias("_late"))
    return (_of_epoch(batch, start).filter(~F.col("_late") & (F.col("_after").isNull() | (F.col("uid") > F.col("_after"))))
            .select(*batch.columns))


def advance(positions: DataFrame, batch: DataFrame, passed: DataFrame) -> DataFrame:
    """Positions after the rows ``passed`` of ``batch`` were read; a late epoch changes nothing."""
    late = F.coalesce(F.col("_epoch") < F.col("_known"), F.lit(False))
    top = passed.groupBy(F.col("folder").alias("_p")).agg(F.max("uid").alias("_top"))
    known = positions.select(F.col("folder").alias("_f"), F.col("uidvalidity").alias("_known"), "last_uid")
    epochs = folder_epochs(batch)
    seen = (epochs.join(known, F.col("_folder").eqNullSafe(F.col("_f")), "left")
            .join(top, F.col("_folder").eqNullSafe(F.col("_p")), "left")
            .select(F.col("_folder").alias("folder"),
                    F.when(late, F.col("_known")).otherwise(F.col("_epoch")).alias("uidvalidity"),
                    F.greatest("_top", F.when(late | F.col("_known").eqNullSafe(F.col("_epoch")), F.col("last_uid")))
                    .alias("last_uid")))
    return positions.join(epochs, F.col("folder").eqNullSafe(F.col("_folder")), "left_anti").unionByName(seen)


def _batch_numbers(spark: SparkSession, pattern: str) -> set[int]:
    """Batch numbers of the paths that match."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return {int(f.getPath().getName().split("=")[1]) for f in found or ()}


def run_to_table(stream: DataFrame, root: str, positions: DataFrame | None = None) -> str:
    """Run everything available now through the gate into ``root`` (ST1, ST3); returns the folder of the rows.

    ``rows/batch=n`` and ``positions/batch=n`` belong to micro-batch n, and the
    streaming checkpoint lies beside them. A batch overwrites its own files, so
    a replayed batch leaves the same rows. ``positions`` is where the first run
    starts.

    The files of a run may hold the uids of a folder in any order, so every
    batch is gated against the positions at the start of its run. A message
    that an earlier batch of the run returned is not returned again, and rows
    of an epoch older than one met in the run do not pass. ``runs/batch=n``
    marks a run that ended with batch n; a run that died goes on from the
    positions at its own start.
    """
    spark = stream.sparkSession
    first = positions if positions is not None else spark.createDataFrame([], POSITIONS)
    base = max(_batch_numbers(spark, f"{root}/runs/batch=*"), default=-1)

    def at(s: SparkSession, n: int) -> DataFrame:
        return first if n < 0 else s.read.schema(POSITIONS).parquet(f"{root}/positions/batch={n}")

    def of_run(s: SparkSession, name: str, schema, n: int) -> DataFrame:
        """A table of the batches of this run before n."""
        return s.read.schema(schema).parquet(*[f"{root}/{name}/batch={i}" for i in range(base + 1, n)])

    def apply(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        folder_epochs(batch).write.mode("overwrite").parquet(f"{root}/epochs/batch={n}")
        if n > base + 1:
            met = of_run(s, "epochs", "_folder string, _epoch long", n).groupBy("_folder").agg(F.max("_epoch").alias("_epoch"))
            older = F.col("folder").eqNullSafe(F.col("_folder")) & (F.col("uidvalidity") < F.col("_epoch"))
            batch = batch.join(met, older, "left_anti")
        passed = gate_new(batch, at(s, base))
        if n > base + 1:
            done = of_run(s, "rows", batch.schema, n).select(
                F.col("folder").alias("_f"), F.col("uid").alias("_u"), F.col("uidvalidity").alias("_e"))
            same = (F.col("folder").eqNullSafe(F.col("_f")) & F.col("uid").eqNullSafe(F.col("_u"))
                    & F.coalesce("uidvalidity", "_e").eqNullSafe(F.coalesce("_e", "uidvalidity")))
            passed = passed.join(done, same, "left_anti")
        rows = f"{root}/rows/batch={n}"
        passed.write.mode("overwrite").parquet(rows)
        after = advance(at(s, n - 1), batch, s.read.schema(batch.schema).parquet(rows))
        after.write.mode("overwrite").parquet(f"{root}/positions/batch={n}")

    q = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/stream")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    last = max(_batch_numbers(spark, f"{root}/positions/batch=*"), default=-1)
    if last > base:
        spark.range(0).write.mode("overwrite").parquet(f"{root}/runs/batch={last}")
    return f"{root}/rows"


def upsert_batches(stream: DataFrame, store: MailStore, checkpoint_location: str | None = None,
                   order_by: tuple[str, ...] = ("uidvalidity", "synced_at"),
                   compact_at: int | None = None) -> MailStore:
    """Keyed upsert of every micro-batch into ``store``, messages and postings together (ST2).

    ``stream`` has the message columns and those of ``order_by``, by which the
    last write per ``(folder, uid)`` of a batch wins (nulls first); equal ones
    go by a hash of the row without ``synced_at``, so a replay chooses the same
    row. A folder whose epoch rose is reset; rows of an epoch below the known
    one are late and change nothing, and so does a write that by those of the
    ``order_by`` columns which the store holds is older than the stored one. A
    run writes what the batch changes; with ``compact_at``, that many runs are
    rewritten as one. A replayed batch replaces its own rows. Returns ``store``.
    """
    spark = stream.sparkSession
    ck = checkpoint_location or scratch_path(spark, "upsert-ckpt")
    checkpoint_dir(spark)

    def apply(batch: DataFrame, n: int) -> None:
        state = store.state()
        current = state.select(F.col("folder").alias("_f"), F.col("uidvalidity").alias("_known"))
        older = F.col("folder").eqNullSafe(F.col("_f")) & (F.col("uidvalidity") < F.col("_known"))
        batch = batch.join(current, older, "left_anti")
        epochs = folder_epochs(batch)
        tie = F.xxhash64(*[c for c in MESSAGE_COLS if c != "synced_at"])
        last = Window.partitionBy("folder", "uid").orderBy(*[F.col(c).desc_nulls_last() for c in order_by], tie)
        newest = _of_epoch(batch, epochs).withColumn("_r", F.row_number().over(last)).filter("_r = 1")
        kept = [c for c in order_by if c in MESSAGE_COLS]
        held = None
        if store.exists():
            # keys alone are compared: the store holds few of a batch's messages, and its texts stay where they are
            same = F.col("folder").eqNullSafe(F.col("_f")) & F.col("uid").eqNullSafe(F.col("_u"))
            named = batch.select(F.col("folder").alias("_f"), F.col("uid").alias("_u")).distinct()
            stored = store.messages().select("folder", "uid", F.struct(*kept).alias("_stored") if kept else F.lit(None).alias("_stored"))
            held = few(stored.join(named, same, "left_semi").select(F.col("folder").alias("_f"), F.col("uid").alias("_u"), "_stored")
                       .checkpoint(eager=True))
            if kept:
                newest = newest.join(held, same & (F.col("_stored") > F.struct(*kept)), "left_anti")
        changed = newest.select(*MESSAGE_COLS, F.lit(True).alias("fresh")).checkpoint(eager=True)
        known = state.select(F.col("folder").alias("_f"), F.col("uidvalidity").alias("_known"), "last_uid",
                             "last_full_check_at", F.lit(True).alias("_has"))
        top = changed.groupBy(F.col("folder").alias("_p")).agg(F.max("uid").alias("_top"))
        reset = needs_reset(F.col("_known"), F.col("_epoch"), F.coalesce("_has", F.lit(False)))
        seen = (epochs.join(known, F.col("_folder").eqNullSafe(F.col("_f")), "left")
                .join(top, F.col("_folder").eqNullSafe(F.col("_p")), "left")
                .select(F.col("_folder").alias("folder"), F.coalesce("_epoch", "_known").alias("uidvalidity"),
                        F.greatest("_top", F.when(~reset, F.col("last_uid"))).alias("last_uid"),
                        F.when(~reset, F.col("last_full_check_at")).alias("last_full_check_at"),
                        reset.alias("_reset")).checkpoint(eager=True))
        untouched = state.join(seen.select(F.col("folder").alias("_f")), F.col("folder").eqNullSafe(F.col("_f")),
                               "left_anti")
        replaced = changed.filter("uid is not null").join(held, same, "left_semi") if held is not None else None
        commit_run(store, changed, seen.filter("_reset"), untouched.unionByName(seen.drop("_reset")), replaced)
        if compact_at and len(store.runs()) >= compact_at:
            compact(store)

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return store
