"""License scan: ordered signature rules over the words of whole texts, in Spark columns only.

A text's words are joined by single blanks. Words that can begin a rule's gate
select the rules worth a look; a rule whose pattern occurs marks its places in
the text, which gives word intervals. A detection inside one of the same or a
higher priority is suppressed; places of base phrases are counted regardless.
There is no shuffle: a row is scanned on its own.

Defined results: a null text is empty; a text without words has no detection,
n_words 0 and score 0; of equal intervals the higher priority stays, then the
first rule's; repeated rows are scanned one by one; an empty table gives no
row. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import KINDS, Rule, operands, rules

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"


def words(text: Column) -> Column:
    """The text's words, A-Z in lower case, joined by single blanks."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(low, GAP, " "))


def _rule(n: int, r: Rule) -> Column:
    priority, confidence = KINDS[r.kind]
    return F.struct(F.lit(rf"(?<![^ ])(?:{r.pattern})(?![^ ])").alias("pattern"), F.array(*map(F.lit, r.gate)).alias("gate"),
                    F.lit(priority).alias("priority"), F.lit(n).alias("rule"), F.lit(r.label).alias("label"),
                    F.lit(r.kind).alias("kind"), F.lit(confidence).alias("confidence"))


def _detections(joined: Column, r: Column) -> Column:
    """Word intervals of one rule, in an order in which an interval comes before all those inside it."""
    marked = F.split(F.regexp_replace(joined, r["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}")), " ")

    def places(mark: str) -> Column:
        return F.filter(F.transform(marked, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())

    return F.transform(F.arrays_zip(places(_OPEN).alias("start"), places(_CLOSE).alias("end")), lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("back"), (-r["priority"]).alias("rank"), r["rule"].alias("rule"),
        r["label"].alias("label"), r["kind"].alias("kind"), r["confidence"].alias("confidence")))


def _kept(found: Column) -> Column:
    """Detections of a sorted array that no earlier one of the same or a higher priority contains."""
    levels = max(p for p, _ in KINDS.values())
    empty = F.filter(found, lambda d: F.lit(False))
    start = F.struct(F.array_repeat(F.lit(-1), levels).alias("reach"), empty.alias("kept"))

    def step(s: Column, d: Column) -> Column:
        end = -d["back"]
        inside = F.element_at(s["reach"], -d["rank"]) >= end
        reach = F.transform(s["reach"], lambda x, i: F.when(i < -d["rank"], F.greatest(x, end)).otherwise(x))
        return F.struct(reach.alias("reach"), F.when(inside, s["kept"]).otherwise(F.concat(s["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, start, step, lambda s: s["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, detections) of every row.

    ``base`` holds (start, label) of every place of a base phrase; ``detections``
    (start, end, label, kind, confidence) what is left of all rules, words from 0,
    end inclusive.
    """
    table = rules() + operands()
    gates = sorted({w for r in table for w in r.gate})
    firsts = {r.gate[0] for r in table}
    numbered = list(enumerate(table))
    by_first = F.create_map(*[c for w in sorted(firsts) for c in (
        F.lit(w), F.array(*[_rule(n, r) for n, r in numbered if r.gate[0] == w]))])
    rows = docs.select("doc_id", words(F.col("text")).alias("joined"))
    rows = rows.select("doc_id", "joined", F.split("joined", " ").alias("words"))
    rows = rows.select("doc_id", "joined", F.when(F.col("joined") == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
                       F.array_intersect("words", F.array(*map(F.lit, gates))).alias("seen"))
    starts = F.array_intersect("seen", F.array(*map(F.lit, sorted(firsts))))
    near = F.filter(F.flatten(F.transform(starts, lambda w: F.element_at(by_first, w))),
                    lambda r: F.forall(r["gate"], lambda g: F.array_contains(F.col("seen"), g)))
    rows = rows.select("doc_id", "joined", "n_words", near.alias("near"))
    hit = F.filter("near", lambda r: F.regexp_like(F.col("joined"), r["pattern"]))
    rows = rows.select("doc_id", "joined", "n_words", hit.alias("hit"))
    found = F.array_sort(F.flatten(F.transform("hit", lambda r: _detections(F.col("joined"), r))))
    rows = rows.select("doc_id", "n_words", found.alias("found"))
    base = F.transform(F.filter("found", lambda d: d["kind"] == "base"), lambda d: F.struct(d["start"].alias("start"), d["label"].alias("label")))
    kept = F.transform(_kept(F.col("found")), lambda d: F.struct(
        d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["kind"].alias("kind"), d["confidence"].alias("confidence")))
    return rows.select("doc_id", "n_words", base.alias("base"), kept.alias("detections"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts, places, labels and score per row of ``scan``; the score is the confidence of the best detection left."""
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    labels = F.transform("base", lambda b: b["label"])
    every = F.array_union(labels, F.transform("detections", lambda d: d["label"]))
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"), F.coalesce(best, F.lit(0.0)).cast("double").alias("score"))
