"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

A model file compiles into three parts: the normaliser (blank to U+2581, dummy
prefix, extra blanks), the pieces as arcs from strings to ids, and byte
fallback arcs for characters that no piece covers. Encoding composes them with
one input and takes the shortest path in the tropical semiring. For a unigram
model an arc weighs its negative score. For a BPE model an arc weighs 0 after
the pieces beside which the merge order leaves it standing and infinity after
all others; exactly one path is finite, and it is the segmentation that
merging by rank gives. Paths are taken per word, as no piece of such a model
crosses a blank, and are remembered up to a bound.

Defined results: a null or empty text has no ids; decoding gives the text back
but for U+2581, which becomes a blank, and what the normaliser removes; a lone
surrogate is encoded as U+FFFD; control pieces are never output for text that
spells them; an id outside the model or null decodes to nothing; repeated rows
are handled one by one. Columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

BLANK = "▁"
#: Words whose paths one Python worker remembers (up to twice as many), and the longest word remembered.
REMEMBERED, LONGEST = 200_000, 64
#: Size bound of a model that is sent to the executors.
MAX_MODEL_BYTES = 64 << 20
#: Kinds of pieces and models in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_START = -1
_SURROGATE = re.compile("[\ud800-\udfff]")


def _fields(b: bytes):
    """(field number, value) of one encoded message: integers as int, the rest as bytes."""
    def varint(i):
        value = shift = 0
        while True:
            value |= (b[i] & 0x7F) << shift
            shift += 7
            i += 1
            if b[i - 1] < 0x80:
                return value, i

    i = 0
    while i < len(b):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, i = varint(i)
            value, i = b[i:i + size], i + size
        yield tag >> 3, value


class _Paths(dict):
    """Remembered words and their ids as native 32-bit numbers; when full, words not met since it was last full are forgotten."""

    def __init__(self, path):
        self.path, self.before = path, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = array("i", self.path(word)).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        self.arcs: dict[str, int] = {}
        self.score: list[float] = []
        self.bytes: list[int] = [0] * 256
        self.unknown, self.fallback = 0, False
        out: list[bytes] = []
        kind_of_model, prefix, squeeze, escape = UNIGRAM, True, True, True
        for field, value in _fields(model):
            if field == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                i, text, kind = len(self.score), piece[1].decode("utf-8"), piece[3]
                self.score.append(struct.unpack("<f", piece[2])[0])
                out.append(text.replace(BLANK, " ").encode("utf-8") if kind in (NORMAL, USER) else b"")
                if kind in (NORMAL, USER):
                    self.arcs[text] = i
                elif kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = i
                    out[i], self.fallback = bytes([int(text[3:5], 16)]), True
                elif kind == UNKNOWN:
                    self.unknown = i
            elif field == 2:
                kind_of_model = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                prefix, squeeze, escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        if kind_of_model not in (UNIGRAM, BPE) or not escape:
            raise ValueError("only unigram and BPE models with escaped blanks are supported")
        self.out, self.prefix, self.squeeze = out, prefix, squeeze
        self.merges = kind_of_model == BPE
        if any(BLANK in p.lstrip(BLANK) for p in self.arcs):
            raise ValueError("a piece crosses a blank")
        self.text = [p for p, _ in sorted(self.arcs.items(), key=lambda x: x[1])]
        self.text = dict(zip(sorted(self.arcs.values()), self.text))
        self.blanks = max((len(p) for p in self.arcs if not p.strip(BLANK)), default=1)
        breaks = "" if any("\n" in p for p in self.arcs) else "\n"
        self.words = re.compile(f"{BLANK}*[^{BLANK}{breaks}]+|{BLANK}+|\n")
        self.agreed: dict[int, bool] = {}
        arcs = self.arcs
        if self.merges:
            arcs = {p: i for p, i in arcs.items() if len(p) == 1 or self._merge(p) == [p]}
        self.single = {p for p in arcs if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in arcs.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.paths, self.behind_blank = _Paths(self._word), _Paths(self._behind_blank)

    def _merge(self, s: str) -> list[str]:
        """Merging by rank of a short string, used to compile which pieces can stand side by side."""
        parts = list(s)
        while True:
            best, where = None, None
            for k in range(len(parts) - 1):
                i = self.arcs.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, where = self.score[i], k
            if where is None:
                return parts
            parts[where:where + 2] = [parts[where] + parts[where + 1]]

    def _agree(self, left: int, right: int) -> bool:
        """Whether the merge order leaves ``left`` and ``right`` standing side by side."""
        a, b = self.text[left], self.text[right]
        ok = self.agreed[left << 20 | right] = self._merge(a + b) == [a, b]
        return ok

    def shortest(self, s: str) -> list[int]:
        """Ids on the shortest path through all arcs composed with ``s``; uncovered characters stand alone."""
        if self.single.issuperset(s):
            return self._covered(s) if s else []
        ids: list[int] = []
        at = 0
        for i, ch in enumerate(s):
            if ch not in self.single:
                if at < i:
                    ids += self._covered(s[at:i])
                ids += self._uncovered(ch)
                at = i + 1
        return ids + self._covered(s[at:]) if at < len(s) else ids

    def _covered(self, s: str) -> list[int]:
        n = len(s)
        last, back = [_START] * (n + 1), [0] * (n + 1)
        if self.merges:
            # one finite path: an end is settled by the first arc that agrees with what stands before it
            agreed, agree, settled = self.agreed, self._agree, 0
            for end, (size, arc) in self.automaton.iter(s):
                if end < settled:
                    continue
                j = end + 1 - size
                left = last[j]
                if j:
                    ok = agreed.get(left << 20 | arc)
                    if not (agree(left, arc) if ok is None else ok):
                        continue
                settled = end + 1
                last[settled], back[settled] = arc, j
        else:
            dist = [0.0] + [math.inf] * n
            for end, (size, arc) in self.automaton.iter(s):
                d = dist[end + 1 - size] - self.score[arc]
                if d < dist[end + 1]:
                    dist[end + 1], last[end + 1], back[end + 1] = d, arc, end + 1 - size
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return ids[::-1]

    def _uncovered(self, ch: str) -> list[int]:
        if not self.fallback:
            return [self.unknown]
        return [self.bytes[b] for b in ch.encode("utf-8", "replace")]

    def _run(self, r: int) -> list[int]:
        """Ids of ``r`` blanks that no other character joins."""
        most = [self.arcs[BLANK * self.blanks]] * max(0, (r - 4 * self.blanks) // self.blanks)
        rest = r - len(most) * self.blanks
        return most + ([self.arcs[p] for p in self._merge(BLANK * rest)] if rest else [])

    def _word(self, w: str) -> list[int]:
        if not self.merges:
            return self.shortest(w)
        r = len(w) - len(w.lstrip(BLANK))
        if r == len(w):
            return self._run(r)
        ids = self.shortest(w[r - 1:] if r else w)
        if r < 2:
            return ids
        if ids[0] == self.arcs.get(BLANK):
            return self._run(r) + ids[1:]
        return self._run(r - 1) + ids

    def _behind_blank(self, w: str) -> list[int]:
        """Ids of a blank and ``w``, which has none."""
        if "\n" in w:
            return [i for x in self.words.findall(BLANK + w) for i in np.frombuffer(self.paths[x], dtype=np.intc).tolist()]
        return self.shortest(BLANK + w) if w else self._word(BLANK)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(BLANK, " ")).strip(" ")
        if not text.isascii():
            text = text.encode("utf-8", "replace").decode("utf-8") if _SURROGATE.search(text) else text
        if self.prefix and "  " not in text and text[:1] != " " and text[-1:] != " " and BLANK not in text:
            return np.frombuffer(b"".join(map(self.behind_blank.__getitem__, text.split(" "))), dtype=np.intc)
        s = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        return np.frombuffer(b"".join(map(self.paths.__getitem__, self.words.findall(s))), dtype=np.intc)

    def decode(self, ids) -> str:
        if ids is None:
            return ""
        n, out = len(self.out), self.out
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        try:
            b = b"".join([out[i] for i in ids]) if min(ids, default=0) >= 0 else None
        except (IndexError, TypeError):
            b = None
        if b is None:
            b = b"".join(out[int(i)] for i in ids if i is not None and i == i and 0 <= i < n)
        text = b.decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(2)
def compiled(model: bytes) -> Transducer:
    """The transducer of a model; a Python worker compiles it once."""
    return Transducer(model)


def load(path: str) -> bytes:
    """A model file, held against MAX_MODEL_BYTES."""
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the model is too large to send to every executor")
    return model


def encoder(spark: SparkSession, model: bytes):
    """A column function text -> array of ids."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("array<int>")
    def f(text: pd.Series) -> pd.Series:
        t = compiled(shared.value)
        return pd.Series([t.encode(x) for x in text], dtype=object)

    return f


def decoder(spark: SparkSession, model: bytes):
    """A column function array of ids -> text."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("string")
    def f(ids: pd.Series) -> pd.Series:
        t = compiled(shared.value)
        return pd.Series([t.decode(x) for x in ids], dtype=object)

    return f



def coder(spark: SparkSession, model: bytes):
    """A column function text -> struct of its ids and the text decoded from them; encodes once."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("ids array<int>, text string")
    def f(text: pd.Series) -> pd.DataFrame:
        t = compiled(shared.value)
        ids = [t.encode(x) for x in text]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "text": pd.Series([t.decode(x) for x in ids], dtype=object)})

    return f
