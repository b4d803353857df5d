import math
import re

import pytest
import regex
from pyspark.sql import functions as F

from helpers import messages
from mailvane.functions.text import TERM_PATTERN, fold_python
from mailvane.operators import index as ix
from mailvane.operators import search

QS = "query_id long, folder string, query string, limit int"


def run(spark, msgs, queries, **kw):
    q = spark.createDataFrame(queries, QS)
    return search.search(ix.build_index(msgs), msgs, q, **kw)


def test_korean_search_skips_deleted(spark):
    msgs = messages(spark, [(121, "프로젝트 회의", "다음 주 일정과 예산을 논의합니다."),
                            (122, "프로젝트 회의", "삭제된 메일", True)])
    res = run(spark, msgs, [(1, "INBOX", "프로젝트", 20)]).collect()
    assert [r["uid"] for r in res] == [121]


def test_korean_particles_hit_by_fallback_only(spark):
    msgs = messages(spark, [(121, "프로젝트 회의", "다음 주 일정과 예산을 논의합니다.")])
    res = run(spark, msgs, [(1, "INBOX", "일정 예산", 20)]).collect()
    assert [(r["uid"], r["score"]) for r in res] == [(121, 0.0)]
    assert res[0]["excerpt"] == "다음 주 일정과 예산을 논의합니다."


def test_no_tokens_no_fallback(spark):
    msgs = messages(spark, [(1, "a", "b")])
    assert run(spark, msgs, [(1, "INBOX", "!!", 20)]).count() == 0


def test_underscore_alone_falls_back_to_every_message(spark):
    msgs = messages(spark, [(1, "a", "b"), (2, "c", "d")])
    assert sorted(r["uid"] for r in run(spark, msgs, [(1, "INBOX", "_", 20)]).collect()) == [1, 2]


def test_fallback_like_is_ascii_case_insensitive(spark):
    msgs = messages(spark, [(1, "x", "ÉCOLE Alpha"), (2, "y", "école alpha")])
    res = run(spark, msgs, [(1, "INBOX", "lph", 20), (2, "INBOX", "éco", 20)]).collect()
    got = sorted((r["query_id"], r["uid"]) for r in res)
    assert got == [(1, 1), (1, 2), (2, 2)]


def brute_bm25(docs, query):
    """Plain-Python BM25 over (uid, subject, body) with the same rules, for cross-checking."""
    term_re = regex.compile(TERM_PATTERN)
    toks = {u: [fold_python(m.group()) for m in term_re.finditer(s)] +
            [fold_python(m.group()) for m in term_re.finditer(b)] for u, s, b in docs}
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    qt = [fold_python(t) for t in re.findall(r"\w+", query)]
    out = {}
    for u, t in toks.items():
        if not all(q in t for q in qt):
            continue
        s = 0.0
        for q in qt:
            df = sum(1 for x in toks.values() if q in x)
            idf = math.log((n - df + 0.5) / (df + 0.5))
            idf = 1e-6 if idf <= 0 else idf
            f = t.count(q)
            s += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
        out[u] = -s
    return out


def test_bm25_matches_brute_force(spark):
    docs = [(1, "alpha beta", "gamma alpha alpha"), (2, "beta", "delta epsilon beta"),
            (3, "gamma", "alpha beta gamma delta"), (4, "zeta", "eta theta"), (5, "Álpha", "beta")]
    msgs = messages(spark, docs)
    for query in ("alpha", "alpha beta", "beta beta", "gamma delta"):
        res = run(spark, msgs, [(1, "INBOX", query, 20)], with_excerpt=False, fallback=False).collect()
        expect = brute_bm25(docs, query)
        assert {r["uid"]: round(r["score"], 12) for r in res} == {u: round(s, 12) for u, s in expect.items()}
        scores = [(r["score"], -r["uid"]) for r in sorted(res, key=lambda r: r["rank"])]
        assert scores == sorted(scores)


def test_stats_cover_all_folders_results_one_folder(spark):
    a = messages(spark, [(1, "x", "alpha beta")], folder="A")
    b = messages(spark, [(2, "y", "alpha")], folder="B")
    msgs = a.unionByName(b)
    res = run(spark, msgs, [(1, "A", "alpha", 20)], with_excerpt=False, fallback=False).collect()
    assert [r["uid"] for r in res] == [1]
    expect = brute_bm25([(1, "x", "alpha beta"), (2, "y", "alpha")], "alpha")[1]
    assert abs(res[0]["score"] - expect) < 1e-12


def test_phrase_needs_adjacent_terms(spark):
    msgs = messages(spark, [(1, "s", "foo bar baz"), (2, "s", "bar foo baz"), (3, "foo", "bar")])
    res = run(spark, msgs, [(1, "INBOX", "foo_bar", 20)], with_excerpt=False, fallback=False).collect()
    assert [r["uid"] for r in res] == [1]


def test_limit_and_tie_break(spark):
    msgs = messages(spark, [(u, "s", "same words") for u in range(1, 8)])
    res = run(spark, msgs, [(1, "INBOX", "same", 3)], with_excerpt=False, fallback=False).collect()
    assert [r["uid"] for r in sorted(res, key=lambda r: r["rank"])] == [7, 6, 5]


def test_limits_are_checked(spark):
    msgs = messages(spark, [(1, "a", "b")])
    with pytest.raises(ValueError):
        run(spark, msgs, [(1, "INBOX", "a", 0)])


def test_output_is_redacted(spark):
    msgs = messages(spark, [(1, "password=hunter2", "token body Authorization: Bearer abcdefghijk")])
    r = run(spark, msgs, [(1, "INBOX", "token", 20)]).first()
    assert "hunter2" not in r["subject"] and "[REDACTED:BEARER_TOKEN]" in r["excerpt"]


def test_top_k_plans_partial_group_limit(spark):
    msgs = messages(spark, [(u, "s", "same words") for u in range(1, 30)])
    q = spark.createDataFrame([(1, "INBOX", "same", 3), (2, "INBOX", "zzz", 2)], QS)
    scored = search.search(ix.build_index(msgs), msgs, q, with_excerpt=False, materialize=False)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_search_context_reports_sync_failure(spark):
    msgs = messages(spark, [(1, "alpha", "beta")])
    q = spark.createDataFrame([(1, "INBOX", "alpha", 5)], QS)

    def failing_sync():
        raise RuntimeError("listing failed")

    def fails_later():
        return msgs.select(F.raise_error(F.lit("late failure")).alias("x"))

    late, _ = search.search_context(fails_later, lambda: msgs)
    assert late.first()["ok"] is False and "late failure" in late.first()["error"]
    report, results = search.search_context(failing_sync, lambda: run(spark, msgs, [(1, "INBOX", "alpha", 5)]))
    r = report.first()
    assert (r["ok"], r["error"]) == (False, "listing failed")
    assert [x["uid"] for x in results.collect()] == [1]


def test_postings_are_cut_to_the_terms_of_a_query_before_any_shuffle(spark):
    from mailvane.operators import index as ix

    msgs = messages(spark, [(1, "Été", "Alpha éte beta"), (2, "", "beta")])
    index = ix.build_index(msgs)
    terms = spark.createDataFrame([("ete",), ("none",)], "term string")
    assert [tuple(r) for r in index.of_terms(terms).postings.select("term", "uid", "tf").collect()] == [("ete", 1, 2)]
    plan = index.postings.join(F.broadcast(terms), "term", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_tokens_are_found_without_a_lower_case_copy(spark):
    from mailvane.functions.text import contains_token

    rows = [("xALPHAx", "alpha"), ("al\npha", "al_pha"), ("É", "é"), ("a.c", "abc"), ("\u212a", "k"), ("a𝔘b", "a_b"), (None, "a")]
    df = spark.createDataFrame(rows, "text string, token string")
    assert [r[0] for r in df.select(contains_token("text", "token")).collect()] == [True, True, False, False, False, True, None]
