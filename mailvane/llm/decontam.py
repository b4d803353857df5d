"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Texts and items are compared in one form: lower case, UTF-8 bytes, every run of
ASCII bytes that are not letters or digits one blank. An item of m bytes may
differ in ``rate`` * m edits. Split into one piece more than that, at least one
piece stands unchanged in every such occurrence; an automaton finds all pieces
in a text, and Myers' distance verifies the text around each hit.

Defined results: a null or empty text has no hit; an item that is null or
without a letter or digit is in no text; an item shorter than MIN_BYTES is
found without an edit and between word boundaries only; items may be of any
length, one word included; of several places of
an item in a text the one of the smallest distance, then smallest position, is
given; repeated rows and repeated items give repeated hits; empty tables give
no hits. Columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import text_batches

RATE = 0.08
MIN_BYTES = 24
#: Items and characters of one pass over the texts, which bound what is broadcast; a longer item is in a pass whole.
BLOCK_ITEMS = 4_000
BLOCK_CHARS = 2_000_000
#: Code points of scripts written without blanks between words.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x9FFF),
             (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))

_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def normal(text: str | None) -> str:
    """The compared form of a text, one character per byte."""
    b = (text or "").lower().encode("utf-8", "surrogatepass")
    return b" ".join(b.translate(_FOLD).split()).decode("latin-1")


def _inside_word(x: str, at: int) -> bool:
    """Whether a word of the compared form ``x`` goes on over the place ``at``; unspaced scripts have a boundary everywhere."""
    sides = (x[max(0, at - 4):at].encode("latin-1").decode("utf-8", "ignore")[-1:], x[at:at + 4].encode("latin-1").decode("utf-8", "ignore")[:1])
    return all(c and unicodedata.category(c)[0] in "LNM" and not any(a <= ord(c) <= b for a, b in _UNSPACED) for c in sides)


def places_of(item: str) -> dict[str, int]:
    """For each character of ``item`` its places as bits."""
    back = item[::-1].encode("latin-1")
    return {chr(c): int(back.translate(bytes(49 if i == c else 48 for i in range(256))), 2) for c in set(back)}


def best_match(item: str, masks: dict[str, int], window: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the closest part of ``window``, the first of several, or None beyond ``budget``.

    Myers' recurrence: one integer holds the vertical differences of a column.
    """
    m = len(item)
    top, full = 1 << (m - 1), (1 << m) - 1
    up, down, dist = full, 0, m
    best = None
    for end, ch in enumerate(window, 1):
        eq = masks.get(ch, 0)
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        plus, minus = down | (full & ~(diag | up)), up & diag
        if plus & top:
            dist += 1
        elif minus & top:
            dist -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diag | plus)), plus & diag
        if dist <= budget and (best is None or dist < best[0]):
            best = (dist, end)
    return best


class Items:
    """The automaton over all pieces of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = RATE):
        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in rows:
            x = normal(text)
            if not x:
                continue
            k = math.floor(rate * len(x)) if len(x) >= MIN_BYTES else 0
            cuts = [round(j * len(x) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[x[a:b]].append((len(self.items), a))
            self.items.append((item_id, x, k, places_of(x) if k else {}))
        self.automaton = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.automaton.add_word(p, (len(p), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the compared form) of every item in ``text``."""
        x = normal(text)
        out: list[tuple[int, int, int]] = []
        if not self.items or not x:
            return out
        best: dict[int, tuple[int, int]] = {}
        bands: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(x):
            for which, offset in places:
                start = end + 1 - size - offset
                _, item, k, _ = self.items[which]
                if which in best:
                    continue
                if start >= 0 and x.startswith(item, start):
                    if len(item) >= MIN_BYTES or not (_inside_word(x, start) or _inside_word(x, start + len(item))):
                        best[which] = (0, start + len(item))
                elif k:
                    bands[which].add(start // (k + 1))
        # one window serves all hits whose starts share a band of k places; windows that meet are searched as one
        for which, at in bands.items():
            _, item, k, masks = self.items[which]
            if which in best:
                continue
            windows: list[list[int]] = []
            for band in sorted(at):
                a, b = max(0, band * (k + 1) - k), band * (k + 1) + k + len(item) + k
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                if min(b, len(x)) - a >= len(item) - k and (found := best_match(item, masks, x[a:b], k)):
                    best[which] = min(best.get(which, (k + 1, 0)), (found[0], a + found[1]))
        return out + [(self.items[w][0], d, e) for w, (d, e) in best.items()]


def blocks(items: DataFrame) -> list[DataFrame]:
    """``items`` dealt by a hash into blocks of about BLOCK_ITEMS rows and BLOCK_CHARS characters at most, each of which one pass handles."""
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) for i in range(parts)]


def finder(block: DataFrame, rate: float = RATE):
    """A column function text -> array of (item_id, distance, at) for one block of items."""
    rows = [(r["item_id"], r["text"]) for r in block.select("item_id", "text").filter("text is not null").toLocalIterator()]
    shared = block.sparkSession.sparkContext.broadcast((rows, rate))
    made: dict[int, Items] = {}

    @pandas_udf("array<struct<item_id: long, distance: int, at: long>>")
    def f(text: pd.Series) -> pd.Series:
        if not made:
            made[0] = Items(*shared.value)
        return pd.Series([[{"item_id": i, "distance": d, "at": e} for i, d, e in made[0].find(t)] for t in text])

    return f


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, at) of every benchmark item found in a document."""
    text_batches(docs)
    out = None
    for block in blocks(items):
        hits = docs.select("doc_id", F.inline(finder(block, rate)("text")))
        out = hits if out is None else out.unionByName(hits)
    return out


def keep_uncontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged. No row is shuffled."""
    text_batches(docs)
    for block in blocks(items):
        rows = docs.select(F.struct("*").alias("_row"), finder(block, rate)("text").alias("_hits"))
        docs = rows.filter(F.size("_hits") == 0).select("_row.*")
    return docs
