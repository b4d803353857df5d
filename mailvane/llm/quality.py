"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled documents, every path from a root becomes a
conjunctive rule, a lasso logistic regression weighs the rules, and the rules
with a weight are compiled into one Spark column expression.

Defined results: a null text counts as empty, and an empty text has all
statistics zero and is scored like any other; labels other than 0 and 1, null
labels and labels of unknown documents teach nothing; with no label, or labels
of one class only, every score is that class's share (no label: 1, so that
nothing is rejected unlearned); repeated rows are scored one by one. Columns
other than those named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import learnable, materialise, text_batches

#: Bound on the labelled rows that the trees and weights are fitted on; above it, rows are taken by a hash of their id.
MAX_FIT_ROWS = 40_000
THRESHOLD = 0.3
STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "stop", "strange", "pipe", "bang", "non_ascii",
              "distinct_words", "top_word", "longest_run", "repeat_pairs", "lines", "repeat_lines", "marked_words", "upper_words")

_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARK, _STRANGE = b",.;:'\"?!-()", b"#$%&*+/<=>@[\\]^_`{|}~"
_ASCII = bytes(range(128))


def _share(b: bytes, chars: bytes) -> float:
    return (len(b) - len(b.translate(None, chars))) / len(b)


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS for one whole text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, count = len(words), Counter(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    pairs = max(1, n - 1)
    marked = sum(c for w, c in count.items() if w[-1] in _STRANGE or w[-2:] == b"!!")
    upper = sum(c for w, c in count.items() if len(w) > 1 and w.isupper())
    return (math.log1p(len(b)), math.log1p(n), len(b) / n, _share(b, _UPPER), _share(b, _DIGIT), _share(b, _MARK),
            b.count(b".") / n, _share(b, _STRANGE), b.count(b"|") / n, b.count(b"!") / n, 1 - _share(b, _ASCII),
            len(count) / n, max(count.values()) / n, max(sum(1 for _ in g) for _, g in groupby(words)) / n,
            1 - len(set(zip(words, words[1:]))) / pairs if n > 1 else 0.0, len(lines) / n, 1 - len(set(lines)) / len(lines),
            marked / n, upper / n)


def statistics_of(text: Column) -> Column:
    """A struct of STATISTICS of a text column."""
    @pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.array([statistics(t) for t in s]).reshape(len(s), -1), columns=list(STATISTICS))

    return f(text)


Condition = tuple[str, bool, float]  # statistic, whether it is at most the value, value


class RuleEnsemble:
    """An offset and weighted conjunctions of conditions."""

    def __init__(self, offset: float, rules: list[tuple[float, tuple[Condition, ...]]]):
        self.offset, self.rules = offset, rules

    def score(self, stats: str) -> Column:
        """P(label 1) over the struct column ``stats``."""
        total = F.lit(self.offset)
        for weight, rule in self.rules:
            total = total + F.when(_holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: tuple[Condition, ...], stats: str) -> Column:
    cond = F.lit(True)
    for name, at_most, value in rule:
        c = F.col(f"{stats}.{name}")
        cond = cond & ((c <= value) if at_most else (c > value))
    return cond


def _paths(tree: str) -> list[tuple[Condition, ...]]:
    """Every path of one or more conditions from the root of a printed tree."""
    out, path = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            del path[len(m[1]) - 2:]
            path.append((STATISTICS[int(m[2])], m[3] == "<=", float(m[4])))
            out.append(tuple(sorted(path)))
    return out


def rules_of(forest) -> list[tuple[Condition, ...]]:
    """The distinct rules of all trees, in a fixed order."""
    found: set[tuple[Condition, ...]] = set()
    for tree in forest.trees:
        found.update(_paths(tree.toDebugString))
    return sorted(found)


def taught(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the learnable rows of ``labels`` (doc_id, quality) whose document is in ``docs``.

    Above MAX_FIT_ROWS, rows are taken by a hash of their id. Reads no text.
    """
    y = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter(learnable(F.col("doc_id")) & F.col("label").isin(0.0, 1.0))
    known = materialise(y.join(docs.select("doc_id"), "doc_id", "left_semi"), "quality-labels")
    part = min(1.0, MAX_FIT_ROWS / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(part * 1_000_000))


def fit(stats: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 3, lasso: float = 1e-3) -> RuleEnsemble:
    """Fit on the rows of ``stats`` (doc_id, stats) that ``labels`` (doc_id, label) names."""
    known = materialise(stats.select("doc_id", "stats").join(labels, "doc_id").select("label", "stats"), "quality-fit")
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = ones / n if n else 1.0
        return RuleEnsemble(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), [])
    vectors = known.select("label", "stats", array_to_vector(F.array(*[F.col(f"stats.{s}") for s in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=7).fit(vectors)
    rules = rules_of(forest)
    if not rules:
        share = ones / n
        return RuleEnsemble(math.log(share / (1 - share)), [])
    hits = known.select("label", array_to_vector(F.array(*[_holds(r, "stats").cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=40, standardization=False).fit(materialise(hits, "quality-rules"))
    return RuleEnsemble(float(model.intercept), [(float(w), r) for w, r in zip(model.coefficients, rules) if w])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written to the shared folder: texts are read once."""
    text_batches(docs)
    return materialise(docs.select("doc_id", statistics_of(F.col("text")).alias("stats")), "quality-stats")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns unchanged.

    For the fit only the texts that are fitted on are measured; their ids are at
    most about MAX_FIT_ROWS, which bounds the broadcast.
    """
    known = taught(docs, labels)
    ids = F.broadcast(known.select("doc_id").distinct())
    ensemble = fit(measured(docs.join(ids, "doc_id", "left_semi")), known)
    text_batches(docs)
    rows = docs.select(F.struct("*").alias("_row"), statistics_of(F.col("text")).alias("_stats"))
    return rows.filter(ensemble.score("_stats") >= threshold).select("_row.*")
