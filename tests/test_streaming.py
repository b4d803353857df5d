import os

from pyspark.sql import functions as F

from mailvane.operators import index as ix
from mailvane.plans import catalog, streams
from mailvane.session import scratch_path
from mailvane.sources.store import MailStore
from mailvane.sources.tables import as_index_rows
from mailvane.streaming import poll

from conftest import SF_SMALL

SCHEMA = "folder string, uid long, uidvalidity long, subject string"
POSITIONS = poll.POSITIONS


def land(spark, path, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, name))


def keys(df):
    return sorted((r["folder"], r["uid"]) for r in df.collect())


def test_position_gate_across_polls(spark, tmp_dir):
    landing, out = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    land(spark, landing, [("INBOX", 1, 777, "a"), ("INBOX", 2, 777, "b"), ("Sent", 5, 1, "c")], "b1")

    def poll_once():
        s = poll.message_stream(spark, landing + "/*", schema, max_files_per_trigger=1)
        return keys(spark.read.parquet(poll.run_to_table(s, out)))

    assert poll_once() == [("INBOX", 1), ("INBOX", 2), ("Sent", 5)]
    # a late uid (<= position) is not returned, a new one is; Sent keeps its position meanwhile
    land(spark, landing, [("INBOX", 2, 777, "late"), ("INBOX", 3, 777, "new")], "b2")
    assert poll_once() == [("INBOX", 1), ("INBOX", 2), ("INBOX", 3), ("Sent", 5)]
    # epoch change restarts the folder
    land(spark, landing, [("INBOX", 1, 888, "reset"), ("Sent", 5, 1, "late")], "b3")
    got = poll_once()
    assert got.count(("INBOX", 1)) == 2 and got.count(("Sent", 5)) == 1
    last = spark.read.parquet(f"{out}/positions/batch=2")
    assert sorted(map(tuple, last.select("folder", "uidvalidity", "last_uid").collect())) == [("INBOX", 888, 1), ("Sent", 1, 5)]


def test_gate_unknown_epochs_null_folders_and_mixed_batch(spark):
    batch = spark.createDataFrame([
        ("A", 1, None, ""), ("B", 1, 5, ""), ("B", 9, 4, "older epoch"), ("B", 3, None, "as the folder's"),
        (None, 2, 7, ""), (None, 1, 7, ""), ("C", 4, 7, "")], SCHEMA)
    at = spark.createDataFrame([("A", 7, 10), ("B", 5, 2), (None, 7, 1), ("D", 1, 8)], POSITIONS)
    passed = poll.gate_new(batch, at)
    got = {(r["folder"], r["uid"]) for r in passed.collect()}
    assert got == {("A", 1), ("B", 3), (None, 2), ("C", 4)}
    after = {tuple(r) for r in poll.advance(at, batch, passed).select("folder", "uidvalidity", "last_uid").collect()}
    assert after == {("A", None, 1), ("B", 5, 3), (None, 7, 2), ("C", 7, 4), ("D", 1, 8)}
    assert poll.gate_new(batch.limit(0), at).count() == 0


def as_messages(rows):
    return as_index_rows(rows.select(
        "folder", "uid", "uidvalidity", "subject", F.lit("x@example.com").alias("sender"), F.lit("").alias("date"),
        F.concat(F.lit("text of "), F.col("subject")).alias("body"), F.lit("plain").alias("body_text_type"),
        F.lit(False).alias("truncated"), *[c for c in rows.columns if c == "arrived"]))


def test_upsert_batches_messages_and_postings(spark, tmp_dir):
    landing, ck = os.path.join(tmp_dir, "landing2"), scratch_path(spark, "upsert")
    schema = spark.createDataFrame([], SCHEMA).schema
    store = MailStore(spark, os.path.join(tmp_dir, "store"))

    def poll_once():
        s = poll.message_stream(spark, landing + "/*", schema, max_files_per_trigger=1)
        poll.upsert_batches(as_messages(s), store, ck, compact_at=3)
        got = {(r["folder"], r["uid"]): r["subject"] for r in store.messages().collect()}
        rebuilt = ix.build_index(store.messages())
        for a, b in ((store.index().postings, rebuilt.postings), (store.index().doc_len, rebuilt.doc_len)):
            assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
        return got

    land(spark, landing, [("INBOX", 1, 777, "one"), ("INBOX", 2, 777, "two"), ("001", 1, 1, "other")], "b1")
    assert poll_once() == {("INBOX", 1): "one", ("INBOX", 2): "two", ("001", 1): "other"}
    land(spark, landing, [("INBOX", 2, 777, "second"), ("INBOX", 3, 777, "three")], "b2")
    assert poll_once() == {("INBOX", 1): "one", ("INBOX", 2): "second", ("INBOX", 3): "three", ("001", 1): "other"}
    # a new epoch resets its folder only; three runs become one
    land(spark, landing, [("INBOX", 1, 778, "anew")], "b3")
    assert poll_once() == {("INBOX", 1): "anew", ("001", 1): "other"}
    assert len(store.runs()) == 1
    assert {(r["folder"], r["uidvalidity"], r["last_uid"]) for r in store.state().collect()} == {("INBOX", 778, 1), ("001", 1, 1)}


def test_files_of_one_run_in_any_order(spark, tmp_dir):
    """Part files with interleaved uids: every message once, older epochs out, and a run that died goes on as itself."""
    landing, out = os.path.join(tmp_dir, "landing3"), os.path.join(tmp_dir, "out3")
    schema = spark.createDataFrame([], SCHEMA).schema
    for i in range(3):
        land(spark, landing, [("INBOX", u, 777, "") for u in range(9, 0, -1) if u % 3 == i] + [("INBOX", 4, 777, "again")][:i], f"b{i}")
        land(spark, landing, [("New", i + 1, 5 if i == 1 else 6, "")], f"c{i}")

    def poll_once():
        s = poll.message_stream(spark, landing + "/*", schema, max_files_per_trigger=1)
        got = keys(spark.read.parquet(poll.run_to_table(s, out)))
        last = spark.read.parquet(f"{out}/positions/batch={max(poll._batch_numbers(spark, f'{out}/positions/batch=*'))}")
        return got, sorted(map(tuple, last.select("folder", "uidvalidity", "last_uid").collect()))

    got, at = poll_once()
    assert {k for k in got if k[0] == "INBOX"} == {("INBOX", u) for u in range(1, 10)}
    assert ("New", 1) in got and ("New", 3) in got and at == [("INBOX", 777, 9), ("New", 6, 3)]
    land(spark, landing, [("INBOX", 3, 777, "late"), ("INBOX", 11, 777, "")], "d0")
    land(spark, landing, [("INBOX", 10, 777, "")], "d1")
    more, at = poll_once()
    assert len(more) == len(got) + 2 and at == [("INBOX", 777, 11), ("New", 6, 3)]


def test_tables_of_part_files_are_streamed_whole(spark, tmp_dir):
    for name, key in (("events", "event_id"), ("documents", "doc_id")):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(3, key).write.parquet(f"{tmp_dir}/{name}.parquet")
    for name in ("stream_read_new", "stream_resume", "stream_sync", "stream_postings"):
        whole, parts = (sorted(map(str, catalog.queries()[name](spark, d).collect())) for d in (SF_SMALL, tmp_dir))
        assert whole and parts == whole, name


def test_late_epochs_and_older_writes_change_nothing(spark, tmp_dir):
    landing, ck = os.path.join(tmp_dir, "landing4"), scratch_path(spark, "late")
    schema = spark.createDataFrame([], SCHEMA + ", at timestamp").schema
    store = MailStore(spark, os.path.join(tmp_dir, "late-store"))

    def poll_once(name, rows):
        spark.createDataFrame([(*r[:4], None) for r in rows], schema).withColumn("at", F.lit(rows[0][4]).cast("timestamp")).coalesce(1).write.parquet(f"{landing}/{name}")
        s = poll.message_stream(spark, landing + "/*", schema, max_files_per_trigger=1)
        poll.upsert_batches(as_messages(s.withColumnRenamed("at", "arrived")).withColumn("synced_at", F.lit(rows[0][4]).cast("timestamp")), store, ck)
        state = {tuple(r) for r in store.state().select("folder", "uidvalidity", "last_uid").collect()}
        return {r["uid"]: r["subject"] for r in store.messages().collect()}, state

    now = {1: "a", 2: "b", 3: "c"}
    assert poll_once("b1", [("INBOX", u, 778, s, "2026-06-01 10:00:00") for u, s in now.items()]) == (now, {("INBOX", 778, 3)})
    assert poll_once("b2", [("INBOX", 9, 777, "late", "2026-06-01 11:00:00")]) == (now, {("INBOX", 778, 3)})
    # a write with an older time than the stored one arrives in a later batch
    assert poll_once("b3", [("INBOX", 2, 778, "older", "2026-06-01 09:00:00")]) == (now, {("INBOX", 778, 3)})
    assert poll_once("b4", [("INBOX", 2, 778, "newer", "2026-06-01 12:00:00")]) == (now | {2: "newer"}, {("INBOX", 778, 3)})


def test_a_late_epoch_passes_no_gate(spark, tmp_dir):
    at = spark.createDataFrame([("A", 778, 3)], POSITIONS)
    late = spark.createDataFrame([("A", 9, 777, "")], SCHEMA)
    passed = poll.gate_new(late, at)
    assert passed.count() == 0 and [tuple(r) for r in poll.advance(at, late, passed).collect()] == [("A", 778, 3)]
    landing, out = os.path.join(tmp_dir, "landing5"), os.path.join(tmp_dir, "out5")
    schema = spark.createDataFrame([], SCHEMA).schema
    for i, rows in enumerate(([("A", 1, 778, "")], [("A", 7, 777, "")], [("A", 1, 778, ""), ("A", 2, 778, "")])):
        land(spark, landing, rows, f"b{i}")
        got = keys(spark.read.parquet(poll.run_to_table(poll.message_stream(spark, landing + "/*", schema), out)))
    assert got == [("A", 1), ("A", 2)]


def test_later_runs_name_only_what_they_replace(spark, tmp_dir):
    """New messages leave nothing to resolve when the store is read; a null uid names no message and resets no folder."""
    landing, ck = os.path.join(tmp_dir, "landing6"), scratch_path(spark, "replaced")
    schema = spark.createDataFrame([], SCHEMA).schema
    store = MailStore(spark, os.path.join(tmp_dir, "replaced-store"))

    def poll_once(name, rows):
        land(spark, landing, rows, name)
        poll.upsert_batches(as_messages(poll.message_stream(spark, landing + "/*", schema)), store, ck)
        gone = store._read("gone", "folder string, uid long, text boolean", sorted(store._numbers(store._path("gone", "*")))).select("folder", "uid")
        return sorted(map(str, ((r["folder"], r["uid"]) for r in gone.collect())))

    assert poll_once("b1", [("A", 1, 7, "a"), ("A", 2, 7, "b")]) == []
    assert store._numbers(store._path("gone", "*")) == set()
    assert poll_once("b2", [("A", 3, 7, "c"), ("B", 1, 7, "d"), ("A", None, 7, "n")]) == []
    assert poll_once("b3", [("A", 2, 7, "new"), ("A", 4, 7, "e")]) == [str(("A", 2))]
    assert {(r["folder"], r["uid"], r["subject"]) for r in store.messages().collect()} == {
        ("A", 1, "a"), ("A", 2, "new"), ("A", 3, "c"), ("A", 4, "e"), ("A", None, "n"), ("B", 1, "d")}


def test_documents_come_by_bytes_and_the_later_file_stays(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for i, rows in enumerate((docs, docs.limit(3).withColumn("text", F.lit("later words")))):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_dir}/documents.parquet")
        for f in os.listdir(f"{tmp_dir}/documents.parquet"):
            if f.endswith(".parquet") and not f.startswith("part-x"):
                os.utime(f"{tmp_dir}/documents.parquet/{f}") if i else os.utime(f"{tmp_dir}/documents.parquet/{f}", (1, 1))
                os.rename(f"{tmp_dir}/documents.parquet/{f}", f"{tmp_dir}/documents.parquet/part-x{i}.parquet")
    store = streams._synced(spark, tmp_dir)
    assert len(store.runs()) == 1
    later = {r["uid"] for r in store.messages().filter("body = 'later words'").select("uid").collect()}
    assert store.messages().count() == docs.count() and later == {r["doc_id"] for r in docs.limit(3).select("doc_id").collect()}
