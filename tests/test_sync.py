from pyspark.sql import functions as F

from helpers import empty_messages, empty_state, listing, messages, source, state
from mailvane.operators import index as ix
from mailvane.operators import search
from mailvane.operators.sync import SyncOptions, refresh_index_after, sync

RUN = "2026-06-01 12:00:00"
KW = ("성과급",)


def opts(**kw):
    base = dict(initial_limit=2000, incremental_limit=100, keywords=KW)
    base.update(kw)
    return SyncOptions(**base)


def uids(df, reason=None):
    if reason:
        df = df.filter(F.col("reason") == reason)
    return sorted(r["uid"] for r in df.collect())


def test_first_load_blocks_policy_subject(spark):
    src = source(spark, [1, 2, 3], subjects={3: "성과급 안내"})
    r = sync(listing(spark, [1, 2, 3]), src, empty_messages(spark), empty_state(spark), opts(), RUN)
    m = {x["uid"]: x for x in r.messages.collect()}
    assert sorted(m) == [1, 2, 3]
    assert m[3]["body_index_blocked"] and m[3]["body"] == "" and m[3]["body_text_type"] == "blocked"
    assert m[3]["block_reason"] == "COMPENSATION_SUBJECT"
    met = r.metrics.first()
    assert (met["indexed_count"], met["last_uid"], met["reset"], met["full_check"]) == (3, 3, False, True)
    st = r.state.first()
    assert st["last_uid"] == 3 and st["last_full_check_at"] is not None


def test_first_load_takes_newest_initial_limit(spark):
    r = sync(listing(spark, range(1, 11)), source(spark, range(1, 11)), empty_messages(spark),
             empty_state(spark), opts(initial_limit=4), RUN)
    assert uids(r.worklist) == [7, 8, 9, 10]
    assert r.metrics.first()["last_uid"] == 10


def test_incremental_limit_and_gap(spark):
    prior = messages(spark, [(10, "Existing", "existing body")])
    st = state(spark, [("INBOX", 777, 10, "2026-06-01 11:00:00")])
    r = sync(listing(spark, [10, 11, 12]), source(spark, [10, 11, 12], failing=[11]), prior, st,
             opts(initial_limit=1, incremental_limit=10), RUN)
    assert uids(r.worklist) == [11, 12]
    met = r.metrics.first()
    assert (met["indexed_count"], met["last_uid"]) == (1, 10)
    assert uids(r.messages) == [10, 12]


def test_incremental_limit_bounds_new_uids(spark):
    prior = messages(spark, [(u, f"Mail {u}", f"body {u}") for u in range(1, 6)])
    st = state(spark, [("INBOX", 777, 5, "2026-06-01 11:00:00")])
    r = sync(listing(spark, range(1, 20)), source(spark, range(1, 20)), prior, st,
             opts(initial_limit=3, incremental_limit=4), RUN)
    assert uids(r.worklist, "new") == [6, 7, 8, 9]
    assert r.metrics.first()["last_uid"] == 9


def test_backfill_after_small_sync(spark):
    prior = messages(spark, [(u, f"Mail {u}", f"body {u}") for u in (8, 9, 10)])
    st = state(spark, [("INBOX", 777, 10, "2026-06-01 11:00:00")])
    r = sync(listing(spark, range(1, 11)), source(spark, range(1, 11)), prior, st,
             opts(initial_limit=5, incremental_limit=100), RUN)
    assert uids(r.worklist) == [6, 7]
    met = r.metrics.first()
    assert (met["indexed_count"], met["last_uid"]) == (2, 10)


def test_epoch_change_resets_folder_and_index(spark):
    prior = messages(spark, [(1, "Old stale", "stale body")])
    st = state(spark, [("INBOX", 777, 1, None)])
    r = sync(listing(spark, [1, 2], epoch=888), source(spark, [1, 2], epoch=888), prior, st,
             opts(initial_limit=10), RUN)
    met = r.metrics.first()
    assert met["reset"] and met["uidvalidity"] == 888 and met["last_uid"] == 2
    idx = refresh_index_after(ix.build_index(prior), r)
    q = spark.createDataFrame([(1, "INBOX", "stale", 20), (2, "INBOX", "body 2", 20)],
                              "query_id long, folder string, query string, limit int")
    res = search.search(idx, r.messages, q, with_excerpt=False, fallback=False).collect()
    assert [(x["query_id"], x["uid"]) for x in res] == [(2, 2)]


def test_unknown_epoch_does_not_reset(spark):
    prior = messages(spark, [(1, "a", "b")])
    st = state(spark, [("INBOX", None, 1, "2026-06-01 11:00:00")])
    r = sync(listing(spark, [1, 2], epoch=888), source(spark, [1, 2]), prior, st, opts(), RUN)
    assert not r.metrics.first()["reset"]


def test_full_check_soft_deletes_and_upsert_revives(spark):
    prior = messages(spark, [(1, "a", "x"), (2, "b", "y"), (3, "c", "z", True)])
    st = state(spark, [("INBOX", 777, 3, "2026-05-01 00:00:00")])
    r = sync(listing(spark, [1, 3]), source(spark, [1, 3]), prior, st, opts(initial_limit=10), RUN)
    m = {x["uid"]: x for x in r.messages.collect()}
    assert m[2]["is_deleted"] and m[2]["deleted_at"] is not None
    assert not m[3]["is_deleted"]            # backfilled, revived
    met = r.metrics.first()
    assert (met["deleted_count"], met["full_check"]) == (1, True)


def test_full_check_not_due_keeps_rows(spark):
    prior = messages(spark, [(1, "a", "x"), (2, "b", "y")])
    st = state(spark, [("INBOX", 777, 2, "2026-06-01 06:00:00")])
    r = sync(listing(spark, [1]), source(spark, [1]), prior, st, opts(initial_limit=2), RUN)
    assert not r.messages.filter("is_deleted").count()
    assert r.metrics.first()["full_check"] is False


def test_empty_successful_listing_deletes_all_failed_listing_deletes_none(spark):
    prior = messages(spark, [(1, "a", "x"), (2, "b", "y")])
    st = state(spark, [("INBOX", 777, 2, None)])
    r = sync(listing(spark, []), source(spark, []), prior, st, opts(full_check=True), RUN)
    assert r.messages.filter("is_deleted").count() == 2
    r2 = sync(listing(spark, [], ok=False), source(spark, []), prior, st, opts(full_check=True), RUN)
    assert r2.messages.filter("is_deleted").count() == 0
    assert r2.metrics.first()["full_check"] is False


def test_override_reindexes_blocked_rows(spark):
    prior = messages(spark, [(1, "a", "x"), (2, "성과급 안내", "", False, True)])
    st = state(spark, [("INBOX", 777, 2, "2026-06-01 11:00:00")])
    src = source(spark, [1, 2], subjects={2: "성과급 안내"})
    r = sync(listing(spark, [1, 2]), src, prior, st, opts(initial_limit=2, allow_blocked_body=True), RUN)
    assert uids(r.worklist, "blocked") == [2]
    row = r.messages.filter("uid = 2").first()
    assert not row["body_index_blocked"] and row["body"] == "body 2"


def test_two_runs_equal_full_rebuild(spark):
    all_uids = list(range(1, 31))
    st0, m0 = empty_state(spark), empty_messages(spark)
    src = source(spark, all_uids)
    r1 = sync(listing(spark, all_uids[:12]), src, m0, st0, opts(initial_limit=100, incremental_limit=5), RUN)
    m1, s1 = r1.messages.cache(), r1.state.cache()
    r2 = sync(listing(spark, all_uids), src, m1, s1, opts(initial_limit=100, incremental_limit=100),
              "2026-06-03 12:00:00")
    full = sync(listing(spark, all_uids), src, m0, st0, opts(initial_limit=100), "2026-06-03 12:00:00")
    cols = ["folder", "uid", "subject", "body", "is_deleted", "body_index_blocked"]
    assert sorted(map(tuple, r2.messages.select(cols).collect())) == \
        sorted(map(tuple, full.messages.select(cols).collect()))
    assert r2.state.first()["last_uid"] == full.state.first()["last_uid"] == 30
    inc = refresh_index_after(refresh_index_after(ix.build_index(m0), r1), r2)
    rebuilt = ix.build_index(full.messages)
    pc = ["term", "folder", "uid", "tf"]
    assert sorted(map(tuple, inc.postings.select(pc).collect())) == \
        sorted(map(tuple, rebuilt.postings.select(pc).collect()))


def test_many_folders_in_one_pass(spark):
    src = source(spark, [1, 2]).unionByName(source(spark, [5, 6, 7], folder="Sent"))
    lst = listing(spark, [1, 2]).unionByName(listing(spark, [5, 6, 7], folder="Sent"))
    r = sync(lst, src, empty_messages(spark), empty_state(spark), opts(initial_limit=2), RUN)
    got = {x["folder"]: x["last_uid"] for x in r.state.collect()}
    assert got == {"INBOX": 2, "Sent": 7}
    assert uids(r.worklist.filter("folder = 'Sent'")) == [6, 7]


def test_repeated_listing_and_source_rows_count_once(spark):
    listed = listing(spark, [1, 2, 2, 2])
    src = source(spark, [1, 2, 2], subjects={2: "twice"}).unionByName(source(spark, [2], failing=[2]))
    r = sync(listed, src, empty_messages(spark), empty_state(spark), opts(initial_limit=2), RUN)
    assert uids(r.worklist) == uids(r.messages) == uids(r.changed) == [1, 2]
    assert r.metrics.first()["indexed_count"] == 2
    again = sync(listing(spark, [1, 1, 3, 3]), source(spark, [3, 3]), r.messages, r.state, opts(full_check=True), RUN)
    assert sorted((x["uid"], x["is_deleted"]) for x in again.messages.collect()) == [(1, False), (2, True), (3, False)]
    assert again.metrics.first()["deleted_count"] == 1


def test_texts_stream_past_the_keys_of_a_sync(spark, monkeypatch):
    """No join of a sync sorts texts, whether its keys are few or many; a repeated and a missing message come out as before."""
    from mailvane.operators import sync as module

    prior = messages(spark, [(1, "Old", "old body"), (2, "Kept", "kept body"), (9, "Gone", "gone body")])
    src = source(spark, [1, 3, 4]).unionByName(source(spark, [3, 4], failing=[3]))
    listed, st = listing(spark, [1, 2, 3, 4, 5]), state(spark, [("INBOX", 777, 2, None)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = sync(listed, src, prior, st, opts(), RUN, materialize=False)

    def rows(df):
        return sorted(map(str, df.collect()))

    for many in (None, "shuffle_hash"):
        if many:
            monkeypatch.setattr(module, "_sized", lambda keys: keys.hint(many))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            r = sync(listed, src, prior, st, opts(), RUN)
            plan = r.messages._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert "SortMergeJoin" not in plan and (not many or "ShuffledHashJoin" in plan)
        for name in ("messages", "metrics", "state", "worklist", "indexed"):
            assert rows(getattr(r, name)) == rows(getattr(plain, name)), name
    assert uids(r.worklist) == [3, 4, 5] and {x["uid"] for x in r.messages.filter("is_deleted").collect()} == {9}
