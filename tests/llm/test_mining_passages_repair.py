"""Hard negatives, repeated passages and conversation repair against brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailvane.llm import negatives, repair, substring
from mailvane.llm import queries as Q

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------- hard negatives

def brute_negatives(rows, every, n_pos=5, n_neg=10, low=30, high=90):
    rows = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, label, q in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, y, v) for i, y, v in rows if i != a and len(v) == len(q))
        for s, pid, *_ in [x for x in scored if x[2] == label][:n_pos]:
            kept = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:n_neg]
            out += [(a, pid, r, x[1], -s, -x[0]) for r, x in enumerate(kept, 1)]
    return sorted(out)


def mined(spark, rows, every=10, **kw):
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "vec_id long, label long, embedding array<float>, score double, rank int")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **kw).collect())


def test_given_vectors(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in Q.op11_hard_negatives(spark, SF).collect()) == brute_negatives(rows, 100)


def test_many_blocks_ties_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "CANDIDATES", 16)
    monkeypatch.setattr(negatives, "TILE", (2, 5))
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 2), [float(np.float32(rng.choice([-1, -0.5, 0, 0.25, 0.5, 3.7]))) for _ in range(rng.choice([3, 3, 3, 9]))]) for i in range(150)]
    rows += [rows[10], rows[20], (30, 1, [0.5, 0.5, 0.5]), (31, 1, [0.5, 0.5, 0.5])]
    bad = [(200, None, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (210, 1, None), (220, 1, [1.0, None, 0.0]), (230, 1, [math.nan, 0.0]), (240, 1, [math.inf, 0.0])]
    assert mined(spark, rows + bad) == brute_negatives(rows, 10)
    assert mined(spark, []) == [] and mined(spark, bad) == [] and mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]


def test_large_components_stay_exact(spark):
    rows = [(0, 1, [3e6, -2e6]), (1, 1, [3e6, 1e5]), (2, 2, [1.5e6, 7.0]), (3, 2, [2e6, 1e-3])]
    assert mined(spark, rows) == brute_negatives([(i, y, [float(np.float32(x)) for x in v]) for i, y, v in rows], 10)
    assert mined(spark, [(0, 1, [3e30]), (1, 1, [3e30]), (2, 2, [1e9])]) == []


def test_lookups_equal_products():
    rng = np.random.default_rng(0)
    for dims, top in ((1, 2), (8, 300), (13, 70_000), (64, 256)):
        a, c = rng.integers(-top, top, (5, dims)), rng.integers(-top, top, (7, dims))
        packed = [negatives.pack(v) for v in c]
        assert all((negatives.unpack(dims, *p) == v).all() for p, v in zip(packed, c))
        planes = max(p for p, _ in packed)
        wide = np.zeros((7, planes, -(-dims // 8)), dtype=np.uint8)
        for i, (p, b) in enumerate(packed):
            rows = np.frombuffer(b, dtype=np.uint8).reshape(p, -1)
            wide[i, :p], wide[i, p:] = rows, rows[-1]
        assert (negatives.scores(negatives.subset_sums(a), wide) == c @ a.T).all()


# ------------------------------------------------------- repeated passages

def brute_passages(rows, window=20):
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda d: (d[0], d[1], substring.xxhash.xxh3_64_intdigest(d[2])))
    seen, out = set(), {}
    for d in docs:
        w = d[2].encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        out[d] = (len(w), len(gone), " ".join(x.decode() for j, x in enumerate(w) if j not in gone))
    return sorted(((i,) + out[i is not None, i or 0, t or ""] for i, t in rows), key=repr)


def cut(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, block string, range int")
    return sorted((tuple(r) for r in substring.remove_repeats(df, **kw).collect()), key=repr)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute_passages(rows)]
    assert sorted((tuple(r) for r in Q.op12_substring_dedup(spark, SF).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [300, 1 << 21])
def test_passages_at_every_offset(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(4000)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (19, 20, 21, 33, 60)]
    rows = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p[rng.randint(0, 3):]
        rows.append((rng.choice([i, i, 1000 - i]), rng.choice([" ", "\n", "\t  "]).join(w)))
    rows += [(5, "a " * 500), (6, "a " * 30), (None, "a " * 25), (None, None), (7, ""), (8, " \n"), rows[3], rows[3], (rows[3][0], rows[4][1]), (-4, "\x1f".join(["b"] * 30)), (9, "x" * 100)]
    assert cut(spark, rows) == brute_passages(rows)


def test_empty_table_and_parameters(spark):
    assert cut(spark, []) == []
    rows = [(1, "a b c d e"), (2, "z b c d y")]
    assert cut(spark, rows, window=3, period=3) == brute_passages(rows, 3)
    with pytest.raises(ValueError):
        cut(spark, rows, window=10, period=13)


def test_covers_and_word_hashes(monkeypatch):
    for v, cover in substring.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    text = " ".join(["x", "yy" * 10, "é", "x", "yy" * 10, "w" * 50, "é"]).encode()
    _, whole = substring.word_hashes(text)
    assert whole[0] == whole[3] and whole[1] == whole[4] and whole[2] == whole[6] and len(set(whole.tolist())) == 4
    monkeypatch.setattr(substring, "CHUNK", 30)
    monkeypatch.setattr(substring, "_TABLES", [])
    small = substring.word_hashes(text)[1]
    assert (small[[0, 1, 2, 3, 4, 6]] == whole[[0, 1, 2, 3, 4, 6]]).all()  # a word over a chunk has a hash of its own


# ------------------------------------------------------ conversation repair

FOLLOWS = {0: "su", 1: "u", 2: "a", 3: "u"}
LEADS = {"s": 1, "u": 2, "a": 3}
NAMES = {"u": "user", "a": "assistant"}


def brute_repair(rows):
    """Whole audits of every state, from the last row backward."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    turns, seen, faults = [r[1] for r in rows if r[1] is not None], set(), []
    for _, _, role, text in rows:
        said = text.strip(repair.BLANKS)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    def with_inserts(best):
        for _ in range(4):
            best = [min([b] + [(best[LEADS[a]][0] + 3, "I" + best[LEADS[a]][1], (NAMES[a] + ":", *best[LEADS[a]][2])) for a in FOLLOWS[s] if a in NAMES],
                        key=lambda x: x[:2]) for s, b in enumerate(best)]
        return best

    best = with_inserts([(0, "", ()), (10**9, "", ()), (10**9, "", ()), (0, "", ())])
    for (_, _, role, text), fault in zip(rows[::-1], faults[::-1]):
        new = []
        for s in range(4):
            ways = [(best[s][0] + 4, "D" + best[s][1], best[s][2])]
            for a in FOLLOWS[s] if fault not in ("b", "d") else "":
                c, e, t = best[LEADS[a]]
                c += 3 * (fault == "t")
                if a in NAMES:
                    ways.append((c + 3, "R" + e, (f"{NAMES[a]}:{text}", *t)))
                if role[:1] == a:
                    ways.append((c, "K" + e, (f"{role}:{text}", *t)))
            new.append(min(ways, key=lambda x: x[:2]))
        best = with_inserts(new)
    initials = [r[2][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), *best[0][:2], hashlib.sha256("\n".join(best[0][2]).encode()).hexdigest())


def some_rows(rng, conversations):
    return [(c, rng.choice([None, 0, 1, 2, 3, 4, 5, 6, 9, 10**12]), rng.choice(["system", "user", "assistant", "tool", None, "", "user"]),
             rng.choice(["a.", "b", "", None, "c!\n", "\t", "d?", " e", "f.", "g "])) for c in conversations for _ in range(rng.choice([1, 5, 40]))]


def by_conversation(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((c, t, " " if role is None else role, " " if text is None else text))
    return out


@pytest.mark.parametrize("span", [3, 4096])
def test_repair_is_cheapest_and_audit_least(spark, span):
    rows = some_rows(random.Random(3), [None, *range(150)])
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "conv_id long, turn long, role string, text string, span string, cost int").repartition(6)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(df, span=span).collect()}
    assert got == {c: brute_repair(v) for c, v in by_conversation(rows).items()}


def test_damage_and_conversations_without_rows(spark):
    rows = some_rows(random.Random(8), [None, *range(300)])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    left = []
    for c, t, role, text in (r for v in by_conversation(rows).values() for r in v):
        what = repair_hash(c, t) % 20
        text = "" if what == 1 else "".join(x for x in text if x not in ".!?") if what == 2 else text
        left += [(c, t, "user" if what == 4 else role, text)] * ((what != 0) + (what == 3))
    assert sorted(map(repr, left)) == sorted(repr(tuple(r)) for r in repair.damaged(df).collect())
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damaged(df), df).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: none for c in by_conversation(rows)} | {c: brute_repair(v) for c, v in by_conversation(left).items()}
    assert got == want and none in got.values()
    assert repair.repair(repair.damaged(df.limit(0)), df.limit(0)).count() == 0


def repair_hash(c, t):
    import zlib

    return zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode())


def test_one_long_conversation(spark):
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["x.", f"{t}.", f"{t}"])) for t in range(1200)] + [(1, 7, "user", "same.")] * 400
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert [tuple(r)[1:] for r in repair.repair(df, span=64).collect()] == [brute_repair(rows)]
