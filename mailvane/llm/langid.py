"""Language identification with interpolated Kneser-Ney character models.

One 4-gram model per language is counted over every learnable document,
estimated with DataFrame aggregations and stored as arrays sorted by the 64-bit
code of a gram, which keeps all of its letters. A text gets the language with
the lowest cross-entropy per letter.

A model of up to MAX_BROADCAST entries is sent to the tasks whole. A larger one
stays a table: blocks of documents ask for their distinct grams, the table,
dealt by gram, answers, and each block scores its texts from the answers. Both
ways give the same numbers; no entry is left out or merged.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and is rejected; languages tied on cross-entropy go to the first by name;
documents with a null lang or id teach nothing; without any learnable document
every text is ``und``; repeated rows count as often as they occur. Columns
other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import learnable, materialise, text_batches

ORDER = 4
GAP, PAD = 0, 1
#: Characters handled at a time; bounds memory whatever the length of a text.
CHUNK = 1 << 17
#: Distinct grams that a counting task holds, and places of the table of grams met before.
HELD, MET_BITS = 200_000, 18
#: Entries of a model that is sent to the tasks (16 bytes each); a larger one is asked by blocks of documents.
MAX_BROADCAST = 4_000_000
#: Characters of a block of documents, and entries of the model for each range of grams, where blocks ask.
BLOCK, RANGE = 1 << 24, 1 << 20
#: Symbols of letters beyond U+FFFF: code units that no letter below has (surrogates and private use), taken in turn.
FAR, FAR_SYMBOLS = 0xD800, 0xF900 - 0xD800
MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
#: Letters from which a text's cross-entropy is held against the rejection threshold.
MIN_LETTERS = 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """Symbol of each code unit below 65,536: the lower-cased letter, or GAP."""
    low = (chr(c).lower()[0] if chr(c).isalpha() else "\0" for c in range(65_536))
    return np.array([min(ord(x), 0xFFFF) for x in low], dtype=np.uint64)


def _symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _letters()[np.minimum(cp, 0xFFFF)]
    if (far := cp > 0xFFFF).any():
        out[far] = [FAR + c % FAR_SYMBOLS if chr(c).isalpha() else GAP for c in cp[far].tolist()]
    return out


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
    """Lists of (row, text before, text) of about CHUNK characters; a long text comes in several."""
    now, size = [], 0
    for row, t in enumerate(texts):
        for at in range(0, len(t), CHUNK):
            now.append((row, t[max(0, at - 64):at], t[at:at + CHUNK]))
            size += len(now[-1][2])
            if size >= CHUNK:
                yield now
                now, size = [], 0
    if now:
        yield now


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each gram, gram): one 4-gram of 16-bit symbols ends at every letter and gap of a text.

    Runs of other characters are one gap; a text begins after a gap and padding.
    """
    for part in _pieces(texts):
        rows, codes = [], []
        for row, before, text in part:
            lead = before or "\0"
            sym = _symbols(lead + text)
            keep = np.ones(sym.size, dtype=bool)
            np.logical_or(sym[1:] != GAP, sym[:-1] != GAP, out=keep[1:])
            at = 2 + int(np.count_nonzero(keep[:len(lead)]))
            sym = np.concatenate([[np.uint64(PAD)] * 2, sym[keep]])
            if sym.size > at:
                codes.append(sym[at - 3:-3] << np.uint64(48) | sym[at - 2:-2] << np.uint64(32)
                             | sym[at - 1:-1] << np.uint64(16) | sym[at:])
                rows.append(np.full(codes[-1].size, row, dtype=np.int64))
        if codes:
            yield np.concatenate(rows), np.concatenate(codes)


def _has_letter(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(0xFFFF)) > PAD


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, g, n) over the whole texts of ``docs`` (text, lang); a task sends each gram once per HELD distinct ones."""
    def run(batches):
        seen: dict[str, list] = {}

        def out():
            for lang, (g, n) in seen.items():
                yield pd.DataFrame({"lang": lang, "g": g.view(np.int64), "n": n})

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for _, codes in grams(texts.tolist()):
                    g, n = np.unique(codes, return_counts=True)
                    if lang in seen:
                        g, at = np.unique(np.concatenate([seen[lang][0], g]), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([seen[lang][1], n])).astype(np.int64)
                    seen[lang] = [g, n.astype(np.int64)]
            if sum(len(g) for g, _ in seen.values()) > HELD:
                yield from out()
                seen = {}
        yield from out()

    text_batches(docs)
    rows = docs.select("lang", "text").filter("lang is not null and text is not null")
    return rows.mapInPandas(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def mixed(gram: np.ndarray) -> np.ndarray:
    """A 64-bit hash of grams."""
    g = gram.astype(np.uint64)
    g = (g ^ (g >> np.uint64(31))) * MIX
    g ^= g >> np.uint64(29)
    return g * MIX


def estimate(counts: DataFrame) -> DataFrame:
    """(lang, kind, g, value): interpolated Kneser-Ney in the parts that a probability is added up from.

    Kind k holds what a seen k-gram has of its own, kind -k the weight that a
    context of a k-gram leaves to the order below, kind 0 the even share below
    the first order. The highest order uses counts, lower ones the number of
    different letters before a gram. The absolute discount of an order is
    n1 / (n1 + 2 n2). A context has as many grams as there are letters at most.
    """
    def low(k: int) -> Column:
        return F.col("g") if k == ORDER else F.col("g").bitwiseAND((1 << (16 * k)) - 1)

    shorter = F.array(*[F.struct(F.lit(k).alias("k"), low(k).alias("g"), low(k + 1).alias("longer")) for k in range(1, ORDER)])
    fewer = counts.select("lang", F.inline(shorter)).distinct().groupBy("lang", "k", "g").agg(F.count("*").alias("n"))
    n = materialise(counts.select("lang", F.lit(ORDER).alias("k"), "g", "n").unionByName(fewer), "kn-counts")
    d = n.groupBy("lang", "k").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    share = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    d = d.select("lang", "k", F.least(share, F.lit(0.9)).alias("d"))
    same = Window.partitionBy("lang", "k", "ctx")
    here = n.withColumn("ctx", F.shiftrightunsigned("g", 16)).select(
        "*", F.sum("n").over(same).alias("total"), F.count("*").over(same).alias("types"), (F.row_number().over(same.orderBy("g")) == 1).alias("first"))

    def entry(kind: Column, g: Column, value: Column) -> Column:
        return F.struct(kind.cast("int").alias("kind"), g.cast("long").alias("g"), value.cast("double").alias("value"))

    own = entry(F.col("k"), F.col("g"), (F.col("n") - F.col("d")) / F.col("total"))
    left = entry(-F.col("k"), F.col("ctx"), F.col("d") * F.col("types") / F.col("total"))
    even = entry(F.lit(0), F.lit(0), 1 / (F.col("types") + 1))
    entries = F.array(own, F.when(F.col("first"), left), F.when(F.col("first") & (F.col("k") == 1), even))
    return materialise(here.join(d, ["lang", "k"]).select("lang", F.inline(entries)).filter("kind is not null"), "kn-model")


_NO_KEYS, _NO_VALUES = np.zeros(0, dtype=np.uint64), np.zeros(0)
#: Kinds with one entry a language, the same for every gram.
CONSTANT = (0, -1)


def _tables(lang: str, rows: pd.DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Sorted arrays by (language, kind) from one language's entries (kind, g, value)."""
    kind, g, value = rows["kind"].to_numpy(np.int8), rows["g"].to_numpy(np.int64).view(np.uint64), rows["value"].to_numpy(np.float64)
    out = {}
    for k in np.unique(kind).tolist():
        at = np.flatnonzero(kind == k)
        at = at[np.argsort(g[at])]
        out[lang, k] = g[at], value[at]
    return out


class Models:
    """Per language and kind, a sorted array of grams and their values."""

    def __init__(self, rows: pd.DataFrame):
        langs, code = np.unique(rows["lang"].to_numpy(dtype=str), return_inverse=True)
        tables = {}
        for i, lang in enumerate(langs.tolist()):
            tables |= _tables(lang, rows[code == i])
        self._set(langs.tolist(), tables)

    @classmethod
    def of(cls, langs: list[str], tables: dict) -> Models:
        """Models from their sorted arrays by (language, kind)."""
        out = cls.__new__(cls)
        out._set(langs, tables)
        return out

    def _set(self, langs, tables):
        self.langs, self.tables, self._keys, self._values = langs, tables, None, None

    def _find(self, lang: str, kind: int, gram: np.ndarray, otherwise: float) -> np.ndarray:
        keys, values = self.tables.get((lang, kind), (_NO_KEYS, _NO_VALUES))
        if not keys.size:
            return np.full(gram.size, otherwise)
        at = np.minimum(np.searchsorted(keys, gram), keys.size - 1)
        return np.where(keys[at] == gram, values[at], otherwise)

    def _p(self, lang: str, gram: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(gram.size, self.tables[lang, 0][1][0])
        lower, back = np.unique(gram & np.uint64((1 << (16 * (k - 1))) - 1), return_inverse=True)
        below = self._p(lang, lower, k - 1)[back]
        return self._find(lang, k, gram, 0.0) + self._find(lang, -k, gram >> np.uint64(16), 1.0) * below

    def logp(self, lang: str, gram: np.ndarray) -> np.ndarray:
        """log P(last symbol | the symbols before): each order's own part, and the weight left to the order below."""
        return np.log(self._p(lang, gram, ORDER))

    def scores(self, gram: np.ndarray) -> np.ndarray:
        """log P of each gram (rows) in each language (columns); grams met before come from a table of 2**MET_BITS places."""
        if self._keys is None:
            self._keys = np.zeros(1 << MET_BITS, dtype=np.uint64)
            self._values = np.zeros((1 << MET_BITS, len(self.langs)), dtype=np.float32)
        shift = np.uint64(64 - MET_BITS)
        at = (mixed(gram) >> shift).astype(np.int64)
        new = self._keys[at] != gram
        if not new.any():
            return self._values[at]
        uniq = np.unique(gram[new])
        places, first = np.unique((mixed(uniq) >> shift).astype(np.int64), return_index=True)
        self._keys[places] = uniq[first]
        self._values[places] = self._direct(uniq[first])
        out = self._values[at]
        shared = self._keys[at] != gram
        if shared.any():
            out[shared] = self._direct(gram[shared])
        return out

    def _direct(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([self.logp(lang, gram) for lang in self.langs], axis=1)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of each text, cross-entropy per symbol of each text and language)."""
        texts = [t or "" for t in texts]
        letters, n = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        for row, gram in grams(texts):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            letters[row[starts]] += np.add.reduceat(_has_letter(gram), starts, dtype=np.int64)
            n[row[starts]] += np.diff(starts, append=row.size)
            total[row[starts]] -= np.add.reduceat(self.scores(gram), starts, axis=0, dtype=np.float64)
        return letters, total / np.maximum(n, 1)[:, None]


def _evidence(letters: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How far the best language is ahead: log(1 + nats), nats over the whole text."""
    two = np.sort(h, axis=1)[:, :2]
    gap = two[:, 1] - two[:, 0] if h.shape[1] > 1 else np.full(len(h), 1.0)
    return np.log1p(letters * gap)


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of P(right | evidence) from (evidence, right, wrong) counts; a prior keeps it finite."""
    x = np.array([b[0] for b in bins] + [0.0, 6.0])
    right, wrong = np.array([b[1] for b in bins] + [1, 2.0]), np.array([b[2] for b in bins] + [1, 0.02])
    w = np.array([0.0, 1.0])
    a = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        m = right + wrong
        step = np.linalg.solve(a.T @ (a * (m * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (right - m * p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return float(w[1]), float(w[0])


class LanguageId:
    """A learned identifier: models, calibration of the score and rejection thresholds.

    ``models`` holds all entries, or (with ``table``, the entries as written) only what is the same for every gram.
    """

    def __init__(self, models: Models, table: DataFrame | None = None, entries: int = 0):
        self.models, self.table, self.entries = models, table, entries
        self.slope, self.offset, self.limits = 1.0, 0.0, {}

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def predict(self, texts: list[str | None], models: Models | None = None) -> pd.DataFrame:
        models = models or self.models
        langs = models.langs
        if not langs:
            return pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "entropy": np.nan, "letters": 0, "evidence": 0.0, "rejected": True},
                                index=range(len(texts)))
        letters, h = models.entropies(texts)
        best = h.argmin(axis=1)
        evidence = _evidence(letters, h)
        none = letters == 0
        low = h[np.arange(len(h)), best]
        limit = np.array([self.limits.get(lang, math.inf) for lang in langs])[best]
        score = 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))
        return pd.DataFrame({"lang_pred": np.where(none, UNKNOWN, np.array(langs, dtype=object)[best]), "score": np.where(none, 0.0, score),
                             "entropy": np.where(none, np.nan, low), "letters": letters, "evidence": evidence,
                             "rejected": none | ((letters >= MIN_LETTERS) & (low > limit))})


SCHEMA = "lang_pred string, score double, entropy double, letters long, evidence double, rejected boolean"


def predicted(docs: DataFrame, learned: LanguageId) -> DataFrame:
    """(row: the whole row, p: struct of SCHEMA) of every row of ``docs`` (text)."""
    text_batches(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    if learned.table is not None:
        return _asked(rows, learned)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    @pandas_udf(SCHEMA)
    def f(text: pd.Series) -> pd.DataFrame:
        return shared.value.predict(text.tolist())

    return rows.select("row", f("text").alias("p"))


def _keys_of(gram: np.ndarray) -> dict[int, np.ndarray]:
    """Every entry by kind that the probability of these grams may need."""
    out = {}
    for k in range(ORDER, 0, -1):
        out[k] = np.unique(gram & np.uint64((1 << (16 * k)) - 1))
        if k > 1:
            out[-k] = np.unique(out[k] >> np.uint64(16))
    return out


def _asked(rows: DataFrame, learned: LanguageId) -> DataFrame:
    """Predictions from a model that is a table: each block of texts asks for its distinct grams.

    Rows are written once, numbered by block and place. An answer holds the
    entries of one block in one range of grams, so no task holds the model.
    """
    langs, constants = learned.models.langs, learned.models.tables

    def number(batches):
        block, place, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, places = [], []
            for n in batch["text"].str.len().fillna(0).astype(int).tolist():
                if size and size + n > BLOCK:
                    block, place, size = block + 1, 0, 0
                blocks.append(block)
                places.append(place)
                place, size = place + 1, size + n + 1
            yield batch.assign(block=blocks, place=places)

    schema = T.StructType(rows.select("row", "text").schema.fields + [T.StructField("block", T.LongType()), T.StructField("place", T.LongType())])
    kept = materialise(rows.mapInPandas(number, schema), "langid-rows")
    texts = kept.select("block", "place", "text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = 1 + max(learned.entries, chars // 8) // RANGE

    @pandas_udf("long")
    def range_of(g: pd.Series) -> pd.Series:
        return pd.Series(_range(g.to_numpy(np.int64).view(np.uint64), ranges))

    def ask(key, batch):
        seen = _NO_KEYS
        for _, gram in grams([t or "" for t in batch["text"]]):
            seen = np.unique(np.concatenate([seen, gram]))
        out = []
        for kind, keys in _keys_of(seen).items():
            which = _range(keys, ranges)
            out += [(int(r), int(key[0]), kind, keys[which == r].tobytes()) for r in np.unique(which)]
        return pd.DataFrame(out, columns=["part", "block", "kind", "keys"])

    def answer(model, asks):
        if not len(asks):
            return pd.DataFrame({"block": [], "kind": [], "keys": [], "values": []}).astype({"block": "int64", "kind": "int32"})
        places = {lang: i for i, lang in enumerate(langs)}
        held = {}
        for kind, part in model.groupby("kind"):
            keys, at = np.unique(part["g"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
            values = np.full((keys.size, len(langs)), np.nan)
            values[at, part["lang"].map(places).to_numpy()] = part["value"].to_numpy()
            held[kind] = keys, values
        out = []
        for block, kind, keys in zip(asks["block"], asks["kind"], asks["keys"]):
            if kind in held:
                wanted, (known, values) = np.frombuffer(keys, dtype=np.uint64), held[kind]
                at = np.minimum(np.searchsorted(known, wanted), known.size - 1)
                hit = known[at] == wanted
                out.append((block, kind, wanted[hit].tobytes(), values[at[hit]].tobytes()))
        return pd.DataFrame(out, columns=["block", "kind", "keys", "values"])

    def score(batch, answers):
        tables = dict(constants)
        for kind, part in answers.groupby("kind"):
            keys = np.frombuffer(b"".join(part["keys"]), dtype=np.uint64)
            values = np.frombuffer(b"".join(part["values"]), dtype=np.float64).reshape(-1, len(langs))
            order = np.argsort(keys)
            for i, lang in enumerate(langs):
                seen = order[~np.isnan(values[order, i])]
                tables[lang, int(kind)] = keys[seen], values[seen, i]
        found = learned.predict(batch["text"].tolist(), Models.of(langs, tables))
        return found.assign(block=batch["block"].to_numpy(), place=batch["place"].to_numpy())

    model = learned.table.filter(~F.col("kind").isin(*CONSTANT)).select("lang", "kind", "g", "value", range_of("g").alias("part"))
    asks = texts.groupBy("block").applyInPandas(ask, "part long, block long, kind int, keys binary")
    answers = model.groupBy("part").cogroup(asks.groupBy("part")).applyInPandas(answer, "block long, kind int, keys binary, values binary")
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, f"{SCHEMA}, block long, place long")
    names = [f.name for f in T.StructType.fromDDL(SCHEMA)]
    return kept.select("row", "block", "place").join(found.select("block", "place", F.struct(*names).alias("p")), ["block", "place"]).select("row", "p")


def _range(gram: np.ndarray, ranges: int) -> np.ndarray:
    return ((mixed(gram) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _fetched(table: DataFrame) -> Models:
    """The whole model, fetched language by language so that the driver never holds it as rows."""
    langs = sorted(r["lang"] for r in table.filter("kind = 0").select("lang").collect())
    tables = {}
    for lang in langs:
        tables |= _tables(lang, table.filter(F.col("lang") == lang).select(F.col("kind").cast("byte").alias("kind"), "g", "value").toPandas())
    return Models.of(langs, tables)


def learn(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> LanguageId:
    """Learn from the learnable documents of ``docs`` (doc_id, text, lang).

    Seven eighths of them (by crc32 of the id) are counted, all of their text,
    and all of a language that has documents in the last eighth only. That
    eighth calibrates: a logistic curve from evidence to the share of right
    answers, and per language a threshold as far above the 99.9th percentile of
    cross-entropy as that is above the median.
    """
    rows = docs.select("doc_id", "text", "lang").filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spare = (F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5).cast("long") % 8 == 0
    taught = rows.filter(~spare)
    untaught = rows.groupBy("lang").agg(F.bool_and(spare).alias("only_spare")).filter("only_spare").select("lang")
    if not untaught.isEmpty():  # a small part of the last eighth, and of no other row
        taught = taught.unionByName(rows.filter(spare).join(untaught, "lang", "left_semi"))
    counts = materialise(count_grams(taught), "grams")
    table = estimate(counts)
    entries = table.count()
    if entries <= max_broadcast:
        learned = LanguageId(_fetched(table))
    else:  # two constants a language come to the driver
        learned = LanguageId(Models(table.filter(F.col("kind").isin(*CONSTANT)).toPandas()), table, entries)
    if not learned.models.langs:
        return learned
    told = predicted(rows.filter(spare).select("lang", "text"), learned).select("row.lang", "p.*").filter("letters > 0")
    told = materialise(told, "calibration")
    right = F.col("lang") == F.col("lang_pred")
    bins = told.groupBy(F.round(F.col("evidence") * 4).alias("b")).agg(F.count_if(right).alias("r"), F.count_if(~right).alias("w"))
    learned.slope, learned.offset = _logistic([(r["b"] / 4, r["r"], r["w"]) for r in bins.collect()])
    spread = told.filter(right & (F.col("letters") >= MIN_LETTERS)).groupBy("lang_pred").agg(
        F.percentile_approx("entropy", F.array(F.lit(0.5), F.lit(0.999)), 10_000).alias("q"))
    learned.limits = {r["lang_pred"]: 2 * r["q"][1] - r["q"][0] for r in spread.collect()}
    return learned


def identify(docs: DataFrame, learned: LanguageId) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, letters, evidence, rejected) of every row."""
    return predicted(docs.select("doc_id", "text"), learned).select("row.doc_id", "p.*")


def keep_identified(docs: DataFrame, learned: LanguageId) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns unchanged."""
    return predicted(docs, learned).filter(~F.col("p.rejected")).select("row.*")
