"""Operators over embeddings, pages and conversations against brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from mailvane.llm import chat, qalsh, warc
from mailvane.llm import queries as Q

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------------- ANN

def brute_nearest(rows, qid, q, k=5):
    q = np.array(q, dtype=float)
    out = []
    for i, v in rows:
        if i != qid and len(v) == len(q):
            v = np.array(v, dtype=float)
            out.append((-(v * q).sum() / (math.sqrt((v * v).sum()) * math.sqrt((q * q).sum())), i))
    return sorted(out)[:k]


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in Q.op7_ann(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    hits = total = 0
    for qid, q in rows:
        if qid % 50 == 0:
            want = brute_nearest(rows, qid, q)
            hits, total = hits + sum(i in got[qid] for _, i in want), total + len(want)
            for s, i in want:
                if i in got[qid]:
                    assert got[qid][i][1] == pytest.approx(-s, abs=1e-12)
    assert hits >= 0.9 * total


def test_recall_on_many_rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 64))
    ids = np.arange(6000)
    index = qalsh.BlockIndex(ids, x, qalsh.projections(64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for qid, found, _ in index.search(ids[:60], x[:60], 5):
        s = unit @ unit[qid]
        s[qid] = -9
        hits += len(set(found) & set(np.argsort(-s)[:5]))
    assert hits >= 0.9 * 300


def test_ann_ties_copies_and_bad_vectors(spark):
    bad = [(900, None), (901, []), (902, [0.0, 0.0]), (903, [1.0, None]), (904, [float("nan"), 1.0]), (905, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(i, [0.0, 1.0]) for i in range(40, 60)] + [(200, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])] + bad
    df = spark.createDataFrame([(i, v, 1, 0.5, 9) for i, v in rows], "vec_id long, embedding array<float>, label int, score double, query_id long")
    got = {}
    for r in qalsh.search(df, df.filter("vec_id % 50 = 0 or vec_id >= 900")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got[0]) == [(n, n, 1.0) for n in range(1, 6)]
    assert sorted(got[50]) == [(n, 39 + n, 1.0) for n in range(1, 6)]
    assert set(got) == {0, 50}
    assert qalsh.search(df.limit(0), df).count() == 0 and qalsh.search(df, df.limit(0)).count() == 0


# --------------------------------------------------------------------- WARC

def replica(spark, rows):
    return spark.createDataFrame([(f, o, len(b or ""), hashlib.sha256((b or "").encode()).hexdigest(), "x") for f, o, b in rows],
                                 "file string, offset long, length long, digest string, kind string")


def test_audit_locates_random_damage(spark):
    rng = random.Random(4)
    first = [(f, o * 700 + rng.randint(0, 600), f"{f}{o}") for f in ("a", "b", "c") for o in range(400)] + [("far", 1 << 41, "x"), ("far", 5, "y")]
    second, want = [], set()
    for f, o, b in first:
        roll = rng.random()
        if f == "c" or roll > 0.05:
            second.append((f, o, b))
        elif roll < 0.02:
            second.append((f, o, b + "!"))
            want.add((f, o, "changed"))
        elif roll < 0.035:
            want.add((f, o, "missing"))
        else:
            second += [(f, o, b), (f, o + 1, b)]
            want.add((f, o + 1, "extra"))
    second.append(("new", 3, "z"))
    want.add(("new", 3, "extra"))
    got = warc.audit(replica(spark, first), replica(spark, second)).collect()
    assert {(r.file, r.offset, r.kind) for r in got} == want and len(got) == len(want)


def test_audit_edge_cases(spark):
    rows = [("a", 0, "x"), ("a", 0, "x"), (None, 5, None), ("a", None, "q")]
    one, none = replica(spark, rows), replica(spark, [("a", 0, "x")]).limit(0)
    assert warc.audit(one, one).count() == 0 and warc.audit(none, none).count() == 0
    got = warc.audit(one, replica(spark, [("a", 0, "x"), (None, 5, "?"), ("a", None, "q")])).collect()
    assert sorted((r.file or "", r.offset, r.kind) for r in got) == [("", 5, "changed"), ("a", 0, "changed")]
    assert warc.audit(none, one).count() == 3


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None, 3), (None, "u", "h", 3), (None, None, None, 3), (1, None, None, 3), (7, "u", "h" * 300_000, 3)],
                                  "page_id long, url string, html string, offset long")
    first, second = warc.replicas_of_pages(pages)
    assert first.count() == 5
    assert [(r.kind, r.first_length) for r in warc.audit(first, second).collect()] == [("missing", 300_000 + 107)] or \
        warc.audit(first, second).collect()[0].kind == "missing"


# --------------------------------------------------------------------- chat

def digests(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))


def check_conversations(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, place int")
    windows = chat.windows(df, **kw)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got == {c: digests([x[2:] for x in order(v)]) for c, v in by.items()}
    return windows.collect()


def test_control_strings_survive_and_never_show():
    for text in ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\n", "\\", "\\\\<|end|>", "<\\|end|>", "<<s>", "[/INST][INST]", "<<SYS>><</SYS>>", "a\nb", ""]:
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
        formatted, _ = chat.format_window([(False, text, text), (True, "user", text)])
        assert [(a, r, t) for a, r, t, _ in chat.parse_window(formatted)] == [(False, text, text), (True, "user", text)]


def test_given_conversations(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    check_conversations(spark, rows)
    got = {r.conv_id: r for r in Q.op9_chat(spark, SF).collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_chars == 21 and len(got) == len({r[0] for r in rows}) + 1


def test_windows_budget_history_and_system(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)
    rng = random.Random(6)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], " ".join(["w"] * rng.randint(0, 12))) for c in range(6) for t in range(60)]
    windows = check_conversations(spark, rows, budget=120, history=30)
    for w in windows:
        turns = list(chat.parse_window(w.text))
        assert w.n_tokens == sum(len(t.split()) + chat.MARKS for _, _, t, _ in turns) <= 120
        assert [a for a, *_ in turns] == sorted((a for a, *_ in turns), reverse=True)
        if w.conv_id % 2:
            assert turns[0][1] == "system" and sum(r == "system" for _, r, _, _ in turns) == 1
    assert len(windows) > 30


def test_a_long_system_turn_is_inside_the_budget(spark):
    rows = [(c, 0, "system", " ".join(["s"] * n)) for c, n in enumerate((296, 700, 996, 2000))]
    rows += [(c, t, ("user", "assistant")[t % 2], " ".join(["w"] * k)) for c, k in enumerate((370, 90, 4, 4)) for t in range(1, 30)]
    for w in check_conversations(spark, rows, budget=1024, history=256):
        assert w.n_tokens <= 1024 or w.conv_id == 3
        assert w.n_tokens == sum(len(t.split()) + chat.MARKS for _, _, t, _ in chat.parse_window(w.text))


def test_chat_edge_cases(spark):
    rows = [(1, None, None, None), (1, 0, "system", "s"), (1, 0, "system", "s"), (1, 2, "assistant", "x " * 5000), (1, 3, "assistant", None), (None, 0, "assistant", "n"),
            (None, 0, "assistant", "n"), (2, 5, "assistant", "only"), (3, -4, "user", "a\\b"), (3, 10**12, "assistant", "</s>"), (4, 1, "user", "q"), (4, 2, "system", "late")]
    check_conversations(spark, rows)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(none)).count() == 0


def test_names_of_object_stores():
    from mailvane.llm.token_scan import store_uri

    assert [store_uri(p) for p in ("s3a://b/x", "hdfs://n:1/x", "file:/tmp/x", "file:///tmp/x", "/tmp/x", "abfs://c@a/x")] == [
        "s3://b/x", "hdfs://n:1/x", "file:///tmp/x", "file:///tmp/x", "/tmp/x", "abfss://c@a/x"]
