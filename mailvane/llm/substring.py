"""Removal of repeated passages, found by difference-cover anchors.

A window is WINDOW consecutive words of one document. A word goes if some
window over it also starts earlier: in a smaller doc_id, or earlier in the
same document. Short word sequences (anchors) are hashed only where their
position modulo a period lies in a difference cover. Any two equal windows,
wherever they start, then share an anchor at one aligned position. Anchors that
occur twice are extended to the windows around them, and those are compared.

How it runs: texts are written once, in blocks of bounded size, bucketed by
block, and never shuffled. A block asks about each distinct hash once, packed
by hash range; the answer is one bit a hash. So a passage of a third of all
documents costs one entry a block, no pairs are made and no group of copies
meets in one task. Hashes of windows have 128 bits; those of anchors only select.

Defined results: a null or blank text has no words; a document with fewer words
than a window keeps all; rows with one doc_id and one text are one document and
get the same result, once a row; rows with one doc_id and different texts go by
a hash of the text; a null doc_id comes before all others; an empty table gives
an empty result. Other columns are not read. Memory of a task follows the size
of a block, or of the longest text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialise, text_batches

WINDOW = 20
# --- fixed values: perfect difference covers, by period ---
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
# --- end fixed values ---
#: Characters of a block, and of all texts for each hash range (at least one range a shuffle partition).
BLOCK, RANGE = 1 << 21, 1 << 24
#: Bytes hashed at a time.
CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_ODD = np.random.default_rng(20).integers(1, 1 << 62, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _MIX = int(_ODD[62]), _ODD[63]


def _powers(base: int) -> np.ndarray:
    """base**i modulo 2**64 for i below CHUNK."""
    out = np.full(CHUNK, _U(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    return h ^ (h >> _U(29))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offset, 64-bit hash) of every word of a UTF-8 text; words are what ASCII white space separates."""
    if not _TABLES:
        _TABLES.extend([_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))])
    up, down = _TABLES
    buf = np.frombuffer(text, dtype=np.uint8)
    gap = np.concatenate([[True], _SPACE[buf], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    out = np.zeros(starts.size, dtype=np.uint64)
    i = 0
    while i < starts.size:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > CHUNK:  # one word longer than a chunk
            out[i] = xxhash.xxh3_64_intdigest(text[lo:hi])
        else:
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((buf[lo:hi].astype(np.uint64) + _U(1)) * up[:hi - lo], out=sums[1:])
            at = starts[i:j] - lo
            out[i:j] = _mix((sums[ends[i:j] - lo] - sums[at]) * down[at])
        i = j
    return starts, out


def _rolled(h: np.ndarray, width: int, first: int = 0) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes."""
    n = max(h.size - width + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width if n else 0):
        out += h[k:k + n] * _ODD[first + k]
    return _mix(out)


class Block:
    """The documents of one block, in order, their words and where windows and anchors may start."""

    def __init__(self, ids: list, texts: list, window: int, period: int):
        keys = [(i is not None and i == i, int(i) if i is not None and i == i else 0, (t or "").encode("utf-8", "surrogatepass")) for i, t in zip(ids, texts)]
        keys = [(known, i, xxhash.xxh3_64_intdigest(t), t) for known, i, t in keys]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.rows, docs = np.zeros(len(keys), dtype=np.int64), []
        for k in order:
            if not docs or docs[-1] != keys[k]:
                docs.append(keys[k])
            self.rows[k] = len(docs) - 1
        self.texts = [d[3] for d in docs]
        self.known = np.array([d[0] for d in docs], dtype=np.uint8)
        self.ids, self.tie = np.array([d[1] for d in docs], dtype=np.int64), np.array([d[2] for d in docs], dtype=np.uint64)
        offsets = np.cumsum([0] + [len(t) + 1 for t in self.texts])
        starts, self.words = word_hashes(b"\n".join(self.texts))
        self.bounds = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(docs)), np.diff(self.bounds))
        self.place = np.arange(self.words.size) - self.bounds[self.doc]
        size = np.diff(self.bounds)[self.doc]
        self.window, self.period, self.width = window, period, window - period + 1
        self.full = self.place + window <= size
        cover = np.isin(np.arange(period), COVERS[period])
        self.anchors = np.flatnonzero((size >= window) & (self.place + self.width <= size) & cover[self.place % period])
        hashes = _rolled(self.words, self.width)[self.anchors]
        self.hashes, self.which, n = np.unique(hashes, return_inverse=True, return_counts=True)
        self.local = n > 1

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Words at which a window starts that has a repeated anchor; ``repeated`` is by distinct anchor hash."""
        p = self.anchors[repeated[self.which]]
        step = np.zeros(self.words.size + 1, dtype=np.int64)
        np.add.at(step, np.maximum(p - (self.period - 1), self.bounds[self.doc[p]]), 1)
        np.add.at(step, p + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & self.full)

    def firsts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the first start of each distinct window, its two hashes), in the order of the starts."""
        h = _rolled(self.words, self.window)[at]
        g = _rolled(_mix(self.words + _MIX), self.window, self.window)[at]
        order = np.lexsort((at, g, h))
        new = np.ones(at.size, dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        one = np.sort(order[new])
        return at[one], h[one], g[one]


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash; it does not fall as the hash rises."""
    return ((h >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _parts(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places of its members, in order)."""
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[order], prepend=-1))
    for i, part in zip(cuts, np.split(order, cuts[1:])):
        yield int(which[order[i]]), part


def _bits(rows: pd.DataFrame, which: np.ndarray) -> np.ndarray:
    """Answers of all ranges, put back in the order in which the block asked."""
    told = dict(zip(rows["range"].tolist(), rows["bits"]))
    out = np.zeros(which.size, dtype=bool)
    for r, part in _parts(which):
        out[part] = np.unpackbits(np.frombuffer(told[r], dtype=np.uint8), count=part.size).astype(bool)
    return out


def _answer(block: list, sizes: list[int], yes: np.ndarray) -> pd.DataFrame:
    parts = np.split(yes, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"block": block, "bits": [np.packbits(p).tobytes() for p in parts]})


def _low5(h: np.ndarray) -> bytes:
    """The lower five bytes of each hash."""
    return h.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, block): texts written once in blocks of about BLOCK characters, bucketed by block."""
    def run(batches):
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for n in batch["text"].str.len().fillna(0).astype(int).tolist():
                if size and size + n > BLOCK:
                    number, size = number + 1, 0
                size += n + 1
                out.append(number)
            yield batch.assign(block=out)

    spark = docs.sparkSession
    text_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, text string, block long")
    name = f"passages_{uuid.uuid4().hex[:12]}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    rows.write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are where they were written
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs`` (doc_id, text); ``kept`` has single spaces."""
    if period not in COVERS or not period <= window <= 31:
        raise ValueError("the period must be a known one, and the window from the period to 31 words")
    spark = docs.sparkSession
    texts = _blocks(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE)

    def block_of(rows: pd.DataFrame) -> Block:
        return Block([None if pd.isna(i) else i for i in rows["doc_id"]], rows["text"].tolist(), window, period)

    def ask_anchors(key, rows):
        b = block_of(rows)
        out = [(r, int(key[0]), _low5(b.hashes[p]), np.packbits(b.local[p]).tobytes()) for r, p in _parts(_range_of(b.hashes, ranges))]
        return pd.DataFrame(out, columns=["range", "block", "hashes", "more"])

    def tell_anchors(rows):
        rows = rows.sort_values("block")
        sizes = [len(h) // 5 for h in rows["hashes"]]
        h = np.zeros((sum(sizes), 8), dtype=np.uint8)
        h[:, :5] = np.frombuffer(b"".join(rows["hashes"]), dtype=np.uint8).reshape(-1, 5)
        more = [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=n) for m, n in zip(rows["more"], sizes)]
        _, which, n = np.unique(h.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        return _answer(rows["block"].tolist(), sizes, (n[which] > 1) | np.concatenate(more).astype(bool)).assign(range=rows["range"].iat[0])

    def ask_windows(key, rows, told):
        b = block_of(rows)
        at, h, g = b.firsts(b.windows(_bits(told, _range_of(b.hashes, ranges))))
        doc = b.doc[at]
        out = [(r, int(key[0]), h[p].tobytes(), g[p].tobytes(), b.known[doc[p]].tobytes(), b.ids[doc[p]].tobytes(), b.tie[doc[p]].tobytes(),
                np.diff(b.place[at[p]], prepend=0).astype(np.int64).tobytes()) for r, p in _parts(_range_of(h, ranges))]
        return pd.DataFrame(out, columns=["range", "block", "h", "g", "known", "ids", "tie", "steps"])

    def tell_windows(rows):
        rows = rows.sort_values("block")
        sizes = [len(k) for k in rows["known"]]
        h, g, tie = (np.frombuffer(b"".join(rows[c]), dtype=np.uint64) for c in ("h", "g", "tie"))
        known, ids = np.frombuffer(b"".join(rows["known"]), dtype=np.uint8), np.frombuffer(b"".join(rows["ids"]), dtype=np.int64)
        start = np.concatenate([np.cumsum(np.frombuffer(s, dtype=np.int64)) for s in rows["steps"]])
        order = np.lexsort((start, tie, ids, known, g, h))
        new = np.ones(h.size, dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        least = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first of each one's group
        yes = np.zeros(h.size, dtype=bool)
        yes[order] = (start[order] == start[least]) & (tie[order] == tie[least]) & (ids[order] == ids[least]) & (known[order] == known[least])
        return _answer(rows["block"].tolist(), sizes, yes).assign(range=rows["range"].iat[0])

    def cut(rows, told):
        b = block_of(rows)
        at = b.windows(_bits(told[told["stage"] == 1], _range_of(b.hashes, ranges)))
        first, h, _ = b.firsts(at)
        keep = np.zeros(b.words.size, dtype=bool)
        keep[first[_bits(told[told["stage"] == 2], _range_of(h, ranges))]] = True
        again = at[~keep[at]]
        step = np.zeros(b.words.size + 1, dtype=np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + window, -1)
        left = np.cumsum(step[:-1]) == 0
        out = []
        for d, text in enumerate(b.texts):
            mask = left[b.bounds[d]:b.bounds[d + 1]]
            out.append((mask.size, int(mask.size - mask.sum()), b" ".join(compress(text.split(), mask.tolist())).decode("utf-8", "replace")))
        found = [out[d] for d in b.rows.tolist()]
        return pd.DataFrame({"doc_id": rows["doc_id"], "n_words": [x[0] for x in found], "n_removed": [x[1] for x in found], "kept": [x[2] for x in found]})

    by_block = texts.groupBy("block")
    asked = by_block.applyInPandas(ask_anchors, "range long, block long, hashes binary, more binary")
    anchors = asked.groupBy("range").applyInPandas(tell_anchors, "block long, bits binary, range long")
    anchors = materialise(anchors, "anchors")
    asked = by_block.cogroup(anchors.groupBy("block")).applyInPandas(
        ask_windows, "range long, block long, h binary, g binary, known binary, ids binary, tie binary, steps binary")
    passages = asked.groupBy("range").applyInPandas(tell_windows, "block long, bits binary, range long")
    told = anchors.withColumn("stage", F.lit(1)).unionByName(materialise(passages, "windows").withColumn("stage", F.lit(2)))
    return by_block.cogroup(told.groupBy("block")).applyInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


#: The same rows from DuckDB: every window as text.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') END AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
k AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS win FROM p),
r AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM k),
g AS (SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM r),
s AS (SELECT doc_id, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
