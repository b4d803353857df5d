"""Operators over documents against brute force, and their edge cases."""

import math
import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mailvane.llm import decontam, langid, licenses, license_rules, quality, simhash, token_scan, wfst
from mailvane.llm import queries as Q

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, fp long, stats string, "
          "component_id long, token_ids string, _row string, label int")
MODEL = f"{Q.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def messy(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns whose names operators use."""
    texts = [(1, "the cat sat on the mat and the dog ran off"), (2, None), (3, ""), (4, " \n\t "), (5, "word " * 60_000), (6, "x" * 200_000),
             (7, "Ünïcödé ßtraße 日本語 🙂"), (1, "the cat sat on the mat and the dog ran off"), (None, "no id at all here"), (None, None),
             (None, "no id at all here"), (8, "the cat sat on the mat and the dog ran off"), (9, "12345 %%% ###")]
    rows = [(i, t, "en" if t else None, "s", len(t or ""), 0.5, 7, "s", 1, "t", "r", 0) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# ------------------------------------------------------------------ simhash

def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, max_bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= max_bits:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_majority_of_shingle_bits(messy, docs):
    for df in (messy, docs):
        for r in df.select("text", simhash.fingerprint_hex(simhash.fingerprint(F.col("text"))).alias("f")).collect():
            assert r["f"] == f"{brute_fp(r['text']):016x}"


def planted(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
@pytest.mark.parametrize("max_bits", [2, 4])
def test_links_join_what_pairs_would(spark, monkeypatch, bucket, max_bits):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = planted(60, bucket + max_bits)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = simhash.links(df, max_bits)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= max_bits for r in edges.collect())
    roots = {r.node: r.root for r in simhash.connected(edges).collect()}
    got = [roots.get(signed(x), signed(x)) for x in fps]
    want = brute_components(fps, max_bits)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_crowded_bucket_and_long_chain(spark):
    """One segment shared by hundreds of fingerprints, and a chain of steps of two bits."""
    crowd = [(0xABCD << 32) | (1 << a) | (1 << b) for a in range(32) for b in range(a, 32)]
    chain = [(0x77 << 56) | ((1 << 2 * i) - 1) for i in range(20)]
    df = spark.createDataFrame([(signed(x),) for x in crowd + chain], "fp long")
    roots = {r.node: r.root for r in simhash.connected(simhash.links(df)).collect()}
    assert all(len({roots.get(x, x) for x in group}) == 1 for group in (crowd, chain))


def test_groups_match_brute_force(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [brute_fp(t) for _, t in rows]
    want = {rows[i][0]: rows[root][0] for i, root in enumerate(brute_components(fps, 2))}
    got = simhash.simhash_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want.values())


def test_simhash_edge_cases(messy, empty):
    got = simhash.simhash_groups(messy).collect()
    assert len(got) == messy.count()
    by_id = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by_id[2, 0] == by_id[3, 0] == by_id[4, 0] == by_id[None, 0] == 2
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 9]
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_an_id_on_two_texts_keeps_a_row_of_each_group(spark):
    a, b, c = ("one text of its own with some words", "quite another thing that nobody wrote before now", "the third of these, unlike both")
    rows = [(5, a), (5, b), (3, b), (7, a), (6, c), (6, c), (6, a), (None, "x y z w"), (None, "x y z w")]
    kept = simhash.keep_one(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _kept_fp int"))
    assert sorted(map(repr, (tuple(r)[:2] for r in kept.collect()))) == sorted(map(repr, [(5, a), (3, b), (6, c), (None, "x y z w")]))


# --------------------------------------------------------------- language id

def test_grams_do_not_depend_on_chunks(monkeypatch):
    texts = ["Hello,  wörld! 42 times", "", "a", "...", "🙂𝔘nd so", "long " * 500]
    whole = {(r, int(g)) for row, gram in langid.grams(texts) for r, g in zip(row, gram)}
    want = [sum(len(x) for x, _ in [(g, r)]) for r, g in langid.grams(texts)]
    monkeypatch.setattr(langid, "CHUNK", 7)
    cut = [(r, int(g)) for row, gram in langid.grams(texts) for r, g in zip(row, gram)]
    assert set(cut) == whole and len(cut) == sum(want)


def brute_kn(text, order=4):
    """log P of each gram of a one-language corpus, by recursion over plain dictionaries."""
    from collections import Counter

    counts = {order: Counter(int(g) for _, gs in langid.grams([text]) for g in gs)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g & (1 << 16 * k) - 1 for g in counts[k + 1])
    disc = {}
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        disc[k] = min(0.9, n1 / (n1 + 2 * n2) if n1 else 0.5)

    def p(g, k):
        c = counts[k]
        if k == 0:
            return None
        same = {x: v for x, v in c.items() if x >> 16 == g >> 16}
        total = sum(same.values())
        low = 1 / (len(counts[1]) + 1) if k == 1 else p(g & (1 << 16 * (k - 1)) - 1, k - 1)
        return low if not total else max(c[g] - disc[k], 0) / total + disc[k] * len(same) / total * low

    return counts[order], lambda g: math.log(p(g, order))


def test_models_are_interpolated_kneser_ney(spark):
    import numpy as np

    text = "the cat sat on the mat and that cat ate the rat at tea"
    model = langid.Models(langid.estimate(langid.count_grams(spark.createDataFrame([("en", text)], "lang string, text string"))).toPandas())
    seen, logp = brute_kn(text)
    other = [int(g) for _, gs in langid.grams(["the zebra met a catfish"]) for g in gs]
    grams = np.array(sorted(set(seen) | set(other)), dtype=np.uint64)
    assert model.logp("en", grams) == pytest.approx([logp(int(g)) for g in grams], abs=1e-9)
    assert model.scores(grams)[:, 0] == pytest.approx(model.logp("en", grams), abs=1e-5)


def test_language_is_right_on_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Q.op3_langid(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, rejected = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.count_if("rejected")).first()
    assert n > 100 and right > 0.97 and rejected <= 0.02 * n
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_edge_cases(messy, empty):
    learned = langid.learn(messy)
    got = {r.doc_id: r for r in langid.identify(messy, learned).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 9)] == ["und"] * 4 and all(got[i].rejected and got[i].score == 0 for i in (2, 3, 4, 9))
    assert got[1].lang_pred == "en"
    kept = langid.keep_identified(messy, learned)
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()} >= {1, 8}
    nothing = langid.learn(empty)
    assert langid.identify(empty, nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(messy, nothing).collect()} == {"und"}


def test_a_model_kept_as_a_table_answers_alike(spark, docs, messy, empty, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 20_000)
    monkeypatch.setattr(langid, "RANGE", 9_000)
    whole, asked = langid.learn(docs), langid.learn(docs, max_broadcast=0)
    assert asked.table is not None and whole.table is None and asked.limits == pytest.approx(whole.limits)
    for df in (docs, messy, empty):
        a, b = ([tuple(r) for r in langid.identify(df, x).orderBy(*["doc_id", "letters"]).collect()] for x in (whole, asked))
        assert len(a) == len(b) and all(x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-5, nan_ok=True) for x, y in zip(a, b))
    kept = langid.keep_identified(messy, asked)
    assert kept.columns == messy.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, langid.keep_identified(messy, whole).collect()))


def test_no_two_grams_share_an_entry(spark):
    """Many more distinct grams than any hash table of a fixed size would tell apart at this rate."""
    import numpy as np

    rng = random.Random(0)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(6000))
    rows = langid.estimate(langid.count_grams(spark.createDataFrame([("zh", text)], "lang string, text string"))).toPandas()
    assert not rows.duplicated(["lang", "kind", "g"]).any() or rows[rows.kind != 0].duplicated(["lang", "kind", "g"]).sum() == 0
    model = langid.Models(rows)
    seen, logp = brute_kn(text)
    some = np.array(sorted(seen)[:300], dtype=np.uint64)
    other = some ^ np.uint64(0x11)
    assert model.logp("zh", some) == pytest.approx([logp(int(g)) for g in some], abs=1e-9)
    unseen = np.array([g for g in other if int(g) not in seen], dtype=np.uint64)
    assert model.logp("zh", unseen) == pytest.approx([logp(int(g)) for g in unseen], abs=1e-9)


def test_letters_beyond_the_basic_plane_have_symbols_of_their_own():
    assert {int(x) for x in langid._symbols("\U00020000\u8000\U0001F600")} == {langid.FAR + 0x20000 % langid.FAR_SYMBOLS, 0x8000, langid.GAP}


def test_a_language_only_in_the_calibration_part_is_learned(spark):
    import zlib

    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) // 5 % 8 == 0)
    rest = [i for i in range(60) if i != only]
    rows = [(i, "the cat sat on the mat", "en") for i in rest] + [(only, "der Hund lief über die Straße", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df, langid.learn(df)).filter(F.col("doc_id") == only).collect()} == {"de"}


# ------------------------------------------------------------------- quality

def test_rules_are_the_paths_of_printed_trees():
    tree = ("DecisionTreeClassificationModel: depth=2\n  If (feature 0 <= 1.5)\n   If (feature 2 <= 0.25)\n    Predict: 0.0\n"
            "   Else (feature 2 > 0.25)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n")
    a, c = quality.STATISTICS[0], quality.STATISTICS[2]
    assert quality._paths(tree) == [((a, True, 1.5),), tuple(sorted([(a, True, 1.5), (c, True, 0.25)])),
                                    tuple(sorted([(a, True, 1.5), (c, False, 0.25)])), ((a, False, 1.5),)]


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert n > 40 and right > 0.95
    assert got.filter("score < 0 or score > 1 or predicted != cast(score >= 0.3 as int)").count() == 0


def test_compiled_score_is_the_weighted_sum(spark, docs):
    rules = [(0.7, (("upper", False, 0.01), ("lines", True, 0.5))), (-1.2, (("log_words", True, 5.0),))]
    stats = quality.measured(docs)
    got = stats.select("stats", quality.RuleEnsemble(0.3, rules).score("stats").alias("p")).collect()
    for r in got:
        z = 0.3 + sum(w for w, rule in rules if all((r.stats[n] <= v) == le for n, le, v in rule))
        assert r.p == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_edge_cases(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (None, 0), (5, None), (99, 0), (7, 5)], "doc_id long, quality int")
    for labels in (none, one):
        assert quality.keep_good(messy, labels).columns == messy.columns
        assert quality.keep_good(messy, labels).count() == messy.count()
    assert quality.keep_good(empty, one).count() == 0
    assert quality.statistics("") == quality.statistics(None) == (0.0,) * len(quality.STATISTICS)


# ----------------------------------------------------------- decontamination

def edit_distance_inside(item, window):
    """Least edits between ``item`` and any part of ``window``, by the full table."""
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance_is_the_table():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        window = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        masks = {c: sum(1 << i for i, x in enumerate(item) if x == c) for c in set(item)}
        want = edit_distance_inside(item, window)
        got = decontam.best_match(item, masks, window, len(item))
        assert (got[0] if got else want) == want


def test_every_item_within_the_budget_is_found():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(20)]
    finder = decontam.Items(items)
    for _ in range(150):
        i, text = rng.choice(items)
        x = list(decontam.normal(text))
        for _ in range(rng.randint(0, math.floor(decontam.RATE * len(x)))):
            at = rng.randrange(len(x))
            x[at:at + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
        doc = " ".join(rng.choices(words, k=50)) + " " + "".join(x) + " " + " ".join(rng.choices(words, k=50))
        want = {j for j, t in items if edit_distance_inside(decontam.normal(t), decontam.normal(doc)) <= math.floor(decontam.RATE * len(decontam.normal(t)))}
        assert {j for j, _, _ in finder.find(doc)} == want and i in want


def test_decontamination_over_tables(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    texts = {r.item_id: decontam.normal(r.text) for r in items.collect()}
    exact = {(d.doc_id, i) for d in docs.collect() for i, t in texts.items() if t in decontam.normal(d.text)}
    assert exact and exact <= got
    left = {r.doc_id for r in decontam.keep_uncontaminated(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_decontamination_edge_cases(spark, messy, empty, monkeypatch):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the cat"), (4, "The cat sat on the mat, and the dog ran off."), (4, "no id at all here"),
                                   (None, "?!")], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in decontam.contaminated(messy, items).collect())
    assert got == [(0, 4, 0), (0, 4, 0), (1, 4, 0), (1, 4, 0), (8, 4, 0)]
    assert decontam.keep_uncontaminated(messy, items).columns == messy.columns
    assert decontam.keep_uncontaminated(messy, items).count() == messy.count() - 5
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(messy, items.limit(0)).count() == 0


def test_items_of_any_length_are_found(spark, monkeypatch):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(10_000))
    assert len(long) > 50_000
    near = long[:20_000] + "zz" + long[20_003:]
    items = spark.createDataFrame([(1, long), (2, "Who wrote Hamlet?"), (3, "2+2=4"), (4, "東京の首都"), (5, "art is"), (6, "Seoul"), (7, "café noir")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + near + " after"), (2, "Quiz: who wrote  Hamlet, and when?"), (3, "so 2 + 2 = 4 holds, 12+2=4 does not"),
                                  (4, "これは東京の首都です"), (5, "who wrote hamlets"), (6, "start is"), (7, "seoul"), (8, "in Seoul"), (9, "a café noire"),
                                  (10, "12+2=4")], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 40_000)
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(docs, items).collect()}
    assert 0 < got.pop((1, 1)) <= 3
    assert got == {(2, 2): 0, (3, 3): 0, (4, 4): 0, (7, 6): 0, (8, 6): 0}
    assert sorted(r.doc_id for r in decontam.keep_uncontaminated(docs, items).collect()) == [5, 6, 9, 10]


# ------------------------------------------------------------- SentencePiece

def test_paths_are_the_librarys_encoding(docs):
    import sentencepiece

    sp, t = sentencepiece.SentencePieceProcessor(model_file=MODEL), wfst.compiled(wfst.load(MODEL))
    rng = random.Random(2)
    texts = [r.text for r in docs.select("text").collect()] + [" " * n for n in range(80)] + ["x" + " " * n + "the" for n in range(80)]
    texts += ["".join(rng.choice("abcdethe ing  \nßñ日本,.🙂한 tion\x01▁") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for x in texts:
        ids = t.encode(x).tolist()
        assert ids == sp.encode(x), x
        assert t.decode(ids) == x.replace("▁", " ")


def test_unigram_takes_the_cheapest_path():
    def field(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    import struct
    pieces = [("<unk>", 0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -5.0, 1), ("▁a", -2.2, 1), ("abb", -4.0, 1)]
    body = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    t = wfst.Transducer(body + field(2, bytes([3 << 3, 1])) + field(3, bytes([4 << 3, 0])))
    assert t.encode("ab").tolist() == [5, 3]
    assert t.encode("abb").tolist() == [5, 3, 3] or t.encode("abb").tolist() == [1, 6]
    assert t.encode("aéb").tolist() == [5, 0, 3]


def test_sentencepiece_edge_cases(spark, messy, empty):
    out = corpus_pipeline.sentencepiece(spark, messy, "")
    assert set(out.columns) == {*messy.columns, "n_tokens"} and out.count() == messy.count()
    decode = wfst.decoder(spark, wfst.load(MODEL))
    for r in out.select("text", "n_tokens", "token_ids", decode("token_ids").alias("back")).collect():
        assert r.back == (r.text or "") and r.n_tokens == len(r.token_ids)
    assert corpus_pipeline.sentencepiece(spark, empty, "").count() == 0
    bad = spark.createDataFrame([([-1, 10**6, None, 261],), (None,), ([],)], "ids array<int>")
    assert [r.t for r in bad.select(decode("ids").alias("t")).collect()] == ["t", "", ""]


# -------------------------------------------------------------- token counts

@pytest.mark.parametrize("size", [1, 3, 50, 1 << 20])
def test_scan_stitches_across_ranges(spark, tmp_dir, size, monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_scan, "STEP", 4)
    rng = random.Random(size)
    want = {}
    for name in ("a", "b", "c"):
        lengths = [rng.choice([0, 0, 1, 2, 7, 30]) for _ in range(40 if name != "c" else 0)]
        ids = [x for n in lengths for x in [5] * n + [9]] + [5] * (3 if name == "b" else 0)
        np.array(ids, dtype="<u2").tofile(f"{tmp_dir}/{name}.tokens")
        want |= {(f"{name}.tokens", i): (n, True) for i, n in enumerate(lengths)}
        if name == "b":
            want[f"{name}.tokens", 40] = (3, False)
    got = token_scan.scan(spark, tmp_dir, separator=9, range_tokens=size).collect()
    assert {(r.file, r.ordinal): (r.n_tokens, r.terminated) for r in got} == want and len(got) == len(want)


def test_token_counts_are_the_encoders(spark, messy, docs, empty):
    with open(f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        enc = token_scan._encoding(f.read())
    for df in (docs, messy.withColumn("text", F.concat("text", F.lit("<|endoftext|>")))):
        files = token_scan.write_token_files(df, f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken")
        got = files.order.join(token_scan.scan(spark, files.path, range_tokens=997), ["file", "ordinal"])
        want = sorted((r.doc_id or 0, len(enc.encode_ordinary(r.text or ""))) for r in df.collect())
        assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == want
    files = token_scan.write_token_files(empty, f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert token_scan.scan(spark, files.path).count() == 0


# ------------------------------------------------------------------ licenses

def brute_licenses(text):
    """All rule places by plain regular expressions, then suppression by comparing every pair."""
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = " ".join(words)
    found, base = [], []
    for n, r in enumerate(license_rules.rules()):
        for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", joined):
            a, b = joined[:m.start()].count(" "), joined[:m.end()].count(" ")
            p, conf = license_rules.KINDS[r.kind]
            found.append((a, -b, -p, n, r.label, conf))
            if r.kind == "base":
                base.append((a, r.label))
    found.sort()
    kept = [d for i, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:i])]
    labels = {x for _, x in base} | {d[4] for d in kept}
    return (len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})),
            ",".join(sorted(labels)), max((d[5] for d in kept), default=0.0))


def test_licenses_match_brute_force(spark, docs, messy):
    texts = ["", None, "MIT License. Licensed under the Apache License, Version 2.0 (the License)", "GNU General Public License v3 or GNU GPL 2",
             "SPDX-License-Identifier: Apache-2.0", "https://www.apache.org/licenses/LICENSE-2.0 apache license", "cc by cc by sa 4.0 cc-by-nc",
             "mit mit license mit license license", "BSD 3-Clause License and new BSD license 1", "distributed under the terms of the GNU Lesser General Public License 2.1",
             "apache license " * 3000, "Kelvin K license İ mit LİCENSE"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    df = df.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(messy.select("doc_id", "text"))
    got = sorted(map(repr, (tuple(r) for r in licenses.report(licenses.scan(df)).collect())))
    assert got == sorted(repr((r.doc_id, *brute_licenses(r.text))) for r in df.collect())
    assert len(license_rules.rules()) > 300


HEADERS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions"),
    ("bsd-3-clause", "Neither the name of the University nor the names of its contributors\nmay be used to endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it"),
    ("apache", "you may not use this file except in compliance with the License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("agpl", "See the\n// GNU Affero General Public License for more details."),
    ("mit,apache-2-0", "// SPDX-License-Identifier: (MIT OR Apache-2.0)"),
    ("gpl-2-0,mit,zlib,bsd-3-clause", "SPDX-License-Identifier: GPL-2.0-or-later OR MIT AND (Zlib OR BSD-3-Clause)"),
    ("apache-2-0,mit", "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception OR MIT"),
    ("mit", "SPDX-License-Identifier: MIT\nYou may use Python or Ruby and Vim"),
    ("", "It is MIT or Zlib. Permission granted to redistribute freely."),
]


def test_license_headers_without_a_title(spark):
    for p in (q for patterns in license_rules.WORDING.values() for q in patterns):
        assert license_rules._rare(p), p
    df = spark.createDataFrame(list(enumerate(t for _, t in HEADERS)), "doc_id long, text string")
    rows = licenses.report(licenses.scan(df)).collect()
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in rows}
    for n, (want, text) in enumerate(HEADERS):
        assert got[n] >= set(filter(None, want.split(","))), (text, got[n])
    assert [len(got[n]) for n in (9, 10, 11, 12, 13)] == [2, 4, 2, 1, 0]
    assert [tuple(r) for r in sorted(rows)[:9]] == [(n, *brute_licenses(t)) for n, (_, t) in enumerate(HEADERS[:9])]


def test_licenses_empty(empty):
    assert licenses.report(licenses.scan(empty)).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages_in_order(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "simhash_dedup", "decontaminate", "sentencepiece"]
    taken = []

    def watched(stage):
        def f(session, before, sf_dir):
            taken.append({r.doc_id for r in before.select("doc_id").collect()})
            assert before.columns == docs.columns
            return stage(session, before, sf_dir)
        return f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(f)) for n, f in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, sf)
    taken.append({r.doc_id for r in out.collect()})
    assert all(b <= a and len(b) > 0.6 * len(a) for a, b in zip(taken, taken[1:]))
    assert out.columns == [*docs.columns, "token_ids", "n_tokens"]


def test_pipeline_on_a_messy_table(spark, messy):
    df = messy
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "token_ids"} <= set(df.columns) and {r.doc_id for r in df.collect()} >= {1}
