from pyspark.sql import functions as F

from helpers import source
from mailvane.operators import reading

KW = ("성과급",)


def test_recent_messages_newest_first_flagged(spark):
    src = source(spark, range(1, 8), subjects={6: "성과급 안내"})
    rows = sorted(reading.recent_messages(src, 3, KW).collect(), key=lambda r: r["rank"])
    assert [r["uid"] for r in rows] == [7, 6, 5]
    assert rows[1]["body_read_blocked"] and rows[1]["block_reason"] == "COMPENSATION_SUBJECT"
    assert rows[0]["block_reason"] is None


def test_read_bodies_withholds_blocked_unless_allowed(spark):
    src = source(spark, [1, 2], subjects={2: "성과급 안내"})
    keys = src.select("folder", "uid")
    rows = {r["uid"]: r for r in reading.read_bodies(src, None, keys, 100, False, KW).collect()}
    assert rows[2]["body"] == "[BLOCKED:COMPENSATION_SUBJECT]" and rows[2]["can_override"]
    assert rows[1]["body"] == "body 1" and not rows[1]["blocked"]
    rows = {r["uid"]: r for r in reading.read_bodies(src, None, keys, 100, True, KW).collect()}
    assert rows[2]["body"] == "body 2"


def test_fetch_headers_reports_missing_keys(spark):
    src = source(spark, [1, 2])
    keys = spark.createDataFrame([("INBOX", 2), ("INBOX", 9)], "folder string, uid long")
    found, missing = reading.fetch_headers(src, keys)
    assert [r["uid"] for r in found.collect()] == [2]
    assert [r["uid"] for r in missing.collect()] == [9]


def test_body_search_slices_before_filtering(spark):
    src = source(spark, range(1, 11), subjects={10: "성과급"}, failing=[9])
    src = src.withColumn("body", F.when(F.col("uid") <= 8, F.lit("Project KEYWORD update"))
                         .otherwise(F.lit("keyword")))
    q = spark.createDataFrame([(1, "INBOX", "keyword", 2, 3), (2, "INBOX", "keyword", 20, 1)],
                              "query_id long, folder string, query string, limit int, max_scan int")
    rows = reading.body_search(src, q, 10, False, KW).collect()
    got = sorted((r["query_id"], r["uid"]) for r in rows)
    # uid 10 blocked and uid 9 failed still use up the scan budget
    assert got == [(1, 8)]
    assert all(r["body"] == "Project KE" and r["truncated"] for r in rows)


def test_read_new_gates_on_epoch_and_stops_at_failure(spark):
    src = source(spark, range(1, 8), failing=[5])
    st = spark.createDataFrame([("INBOX", 2, 777)], "folder string, last_uid long, uidvalidity long")
    got, new_state, summary = reading.read_new(src, st, 10)
    assert sorted(r["uid"] for r in got.collect()) == [3, 4]
    s = summary.first()
    assert (s["previous_last_uid"], s["new_last_uid"]) == (2, 4)
    assert new_state.first()["last_uid"] == 4
    st2 = spark.createDataFrame([("INBOX", 2, 666)], "folder string, last_uid long, uidvalidity long")
    got2, _, _ = reading.read_new(src, st2, 2)
    assert sorted(r["uid"] for r in got2.collect()) == [1, 2]


def test_read_new_without_rows_keeps_checkpoint(spark):
    src = source(spark, [1, 2])
    st = spark.createDataFrame([("INBOX", 2, 777)], "folder string, last_uid long, uidvalidity long")
    got, new_state, summary = reading.read_new(src, st, 10)
    assert got.count() == 0
    assert summary.first()["new_last_uid"] == 2 and new_state.first()["last_uid"] == 2


def test_window_group_limit_in_plan(spark):
    src = source(spark, range(1, 50))
    plan = reading.recent_messages(src, 3, KW)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan


def test_body_search_plans_group_limit_and_late_body_join(spark):
    src = source(spark, range(1, 50))
    q = spark.createDataFrame([(1, "INBOX", "body", 2, 5)],
                              "query_id long, folder string, query string, limit int, max_scan int")
    df = reading.body_search(src, q, 10, False, KW)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r["uid"] for r in df.collect()) == [48, 49]
