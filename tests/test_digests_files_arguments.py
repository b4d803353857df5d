"""Range digests against a plain anti join, message files as a stream, and argument checks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import messages
from mailvane.operators import arguments, digests, reading
from mailvane.streaming import files


def test_missing_is_the_anti_join(spark):
    rng = random.Random(2)
    left = [(f, rng.randint(-50, 5000)) for f in ("a", "b", "same") for _ in range(400)]
    right = [x for x in left if x[0] == "same" or rng.random() > 0.02] + [("b", 9999), ("c", 1), ("a", None)]
    right += right[:50]
    a, b = (spark.createDataFrame(x, "folder string, uid long") for x in (left + left[:30] + [("a", None), ("d", 4)], right))
    want = sorted({tuple(r) for r in a.filter("uid is not null").join(b, ["folder", "uid"], "left_anti").collect()})
    for spans in (digests.SPANS, (1024, 64, 4), ()):
        assert sorted({tuple(r) for r in digests.missing(a, b, spans).collect()}) == want
    ranges = {tuple(r) for r in digests.differing(a.filter("uid is not null").distinct(), b.filter("uid is not null").distinct(), 256).collect()}
    assert all(f != "same" for f, _ in ranges) and {(f, u // 256) for f, u in want} <= ranges


def test_equal_tables_descend_nowhere(spark):
    rows = spark.range(5000).select(F.lit("a").alias("folder"), F.col("id").alias("uid"))
    assert digests.differing(rows, rows, 1 << 16).count() == 0 and digests.missing(rows, rows).count() == 0
    other = rows.filter("uid <> 777")
    assert [tuple(r) for r in digests.missing(rows, other).collect()] == [("a", 777)]
    assert digests.differing(rows, other, 256).count() == 1


def mail(subject, body):
    return (f"From: a@example.com\r\nSubject: {subject}\r\nDate: x\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n{body}\r\n").encode()


def test_files_are_read_once_and_broken_ones_again(spark, tmp_dir):
    path, root = os.path.join(tmp_dir, "mail"), os.path.join(tmp_dir, "out")
    os.makedirs(f"{path}/in/box")

    def put(name, content):
        with open(f"{path}/{name}", "wb") as f:
            f.write(content)

    def state():
        files.ingest(spark, path, root, max_files=2)
        return (sorted((r["subject"], r["body"]) for r in files.messages(spark, root).collect()),
                sorted(os.path.basename(r["path"]) for r in files.failed(spark, root).collect()))

    put("in/1.eml", mail("one", "first"))
    put("in/box/2.eml", mail("two", "zweite é"))
    put("in/3.eml", b"\r\n")
    put("in/4.eml", mail("four", "x").replace(b"utf-8", b"no-such-charset"))
    put("in/notes.txt", b"not a message")
    assert state() == ([("one", "first"), ("two", "zweite é")], ["3.eml", "4.eml"])
    put("in/3.eml", mail("three", "now whole"))
    put("in/box/5.eml", mail("five", "new"))
    assert state() == ([("five", "new"), ("one", "first"), ("three", "now whole"), ("two", "zweite é")], ["4.eml"])
    assert state() == ([("five", "new"), ("one", "first"), ("three", "now whole"), ("two", "zweite é")], ["4.eml"])


def test_bad_arguments_are_set_aside(spark):
    rows = [(1, "INBOX", "ok", 5, 3), (2, " ", "ok", 5, 3), (3, "INBOX", "　\t", 5, 3), (4, "INBOX", "ok", 0, 3), (5, None, None, 5, 3), (6, "INBOX", "ok", None, -2)]
    run, bad = arguments.checked(spark.createDataFrame(rows, "query_id long, folder string, query string, limit int, max_scan int"))
    assert [r["query_id"] for r in run.collect()] == [1]
    assert {r["query_id"]: r["error"] for r in bad.collect()} == {
        2: "folder is required", 3: "query is required", 4: "limit must be greater than 0", 5: "folder is required", 6: "max_scan must be greater than 0"}


@pytest.mark.parametrize("limit, scan", [(0, 5), (-3, 5), (5, 0)])
def test_body_search_limits(spark, limit, scan):
    q = spark.createDataFrame([(1, "INBOX", "a", limit, scan), (2, "INBOX", "a", 5, 5)], "query_id long, folder string, query string, limit int, max_scan int")
    with pytest.raises(ValueError):
        reading.body_search(messages(spark, [(1, "a", "a")]), q)


def test_active_blocked_newest_first(spark):
    msgs = messages(spark, [(1, "a", "", False, True), (2, "b", "", False, True), (3, "c", "", True, True), (4, "d", ""), (5, "e", "", False, True)])
    assert [r["uid"] for r in reading.active_blocked(msgs, 2).orderBy("rank").collect()] == [5, 2]
    assert reading.active_blocked(msgs).count() == 3
