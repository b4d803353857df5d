"""Repair of the structure of conversations, by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``. Keep costs 0,
Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant
turn) 3; blank and duplicate rows must be deleted, and a truncated row that stays
adds 3. Of the cheapest edit sequences the one whose initials (D, I, K, R) come
first in ASCII order is taken.

What has been written decides one of four states (nothing, a system turn, a user
turn, an assistant turn). Costs run forward from the beginning and backward from
the end as vectors of four and meet in the middle, where the crossing with the
cheapest total is chosen, of equal ones that with the least audit; both halves
are then solved alike. A half ends with the edit of its last row, so no audit of
a first half is the beginning of another, and the order of audits is carried as
a rank of each state. No table of rows by states is kept.

The same holds for spans of rows in place of rows: a span has the cheapest cost
and the rank from each state to each state. So a conversation is cut into spans
of bounded size, in order; spans, partitions and groups of partitions are
composed upward, crossings chosen downward, and every span is rebuilt on its own.
Only the audit and the hash of a conversation, which are sequential by nature,
are put together by one task, from finished pieces in a stream.

Defined results: null roles and texts are one space; turns are ordered nulls
first, rows of one turn by role, then by the SHA-256 of the text; rows repeated
whole are next to each other; an empty role has an empty initial; rows with a
null conv_id are one conversation; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import materialise, text_batches

NO_PATH = 1 << 60
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: What a row allows: any edit, any edit at the cost of a truncated row, deletion only.
FREE, CUT, DROP = range(3)
#: Rows and characters of a span.
SPAN, SPAN_CHARS = 4096, 1 << 22
#: Levels above spans: a span's number holds its partition in the upper bits.
LEVELS = (32, 44, 63)
BLANKS = " \t\n\x0b\x0c\r"
CONV = ("known", "conv")
#: Cost and edits with which each state ends a conversation.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")


def _next(state: int) -> int:
    """The state after a user or assistant turn that fits."""
    return ASSISTANT if state == USER else USER


def _step(initial: str, allows: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state, state) -> least (cost, edits) of one row and the inserts before it."""
    out: dict = {}
    more = TRUNCATED if allows == CUT else 0
    for start in range(4):
        state = start
        for n in range(3):
            ways = [(state, DELETE, "D")]
            if allows != DROP:
                ways.append((_next(state), REROLE + more, "R"))
                if initial == "s" and state == NOTHING:
                    ways.append((SYSTEM, more, "K"))
                elif initial in ("u", "a") and _next(state) == {"u": USER, "a": ASSISTANT}[initial]:
                    ways.append((_next(state), more, "K"))
            for end, cost, edit in ways:
                way = (cost + n * INSERT, "I" * n + edit)
                if way < out.get((start, end), (NO_PATH, "")):
                    out[start, end] = way
            state = _next(state)
    return out


def _ranked(keys: list) -> list[int]:
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [order[k] for k in keys]


class Part:
    """Least cost, and rank of the audit, from each state (index // 4) to each state (index % 4)."""

    __slots__ = ("cost", "rank")

    def __init__(self, cost, rank):
        self.cost, self.rank = cost, rank


_STEPS = {(i, a): _step(i, a) for i in ("s", "u", "a", "") for a in (FREE, CUT, DROP)}


def _row_part(step: dict) -> Part:
    cost = [step.get((s, t), (NO_PATH, ""))[0] for s in range(4) for t in range(4)]
    rank = [r for s in range(4) for r in _ranked([step.get((s, t), (NO_PATH, "~"))[1] for t in range(4)])]
    return Part(cost, rank)


_ROWS = {k: _row_part(v) for k, v in _STEPS.items()}


def _deletes(n: int) -> Part:
    return Part([DELETE * n if i % 5 == 0 else NO_PATH for i in range(16)], [0 if i % 5 == 0 else 1 for i in range(16)])


def forward(parts: list[Part], lo: int, hi: int, cost: list, rank: list) -> tuple[list, list]:
    """Costs and ranks of the states behind ``parts[lo:hi]``."""
    for p in parts[lo:hi]:
        c, r = p.cost, p.rank
        best = [min((cost[s] + c[4 * s + t], rank[s], r[4 * s + t]) for s in range(4)) for t in range(4)]
        cost, rank = [min(b[0], NO_PATH) for b in best], _ranked([b[1:] if b[0] < NO_PATH else (9, 9) for b in best])
    return cost, rank


def backward(parts: list[Part], lo: int, hi: int, cost: list) -> list:
    """Costs from the states before ``parts[lo:hi]``, given those behind."""
    for p in reversed(parts[lo:hi]):
        c = p.cost
        cost = [min(min(c[4 * s + t] + cost[t] for t in range(4)), NO_PATH) for s in range(4)]
    return cost


def _only(state: int) -> list:
    return [0 if s == state else NO_PATH for s in range(4)]


def crossings(parts: list[Part], entry: int, end: list) -> list[int]:
    """The state behind every part on the cheapest way, of equal ones that with the least audit."""
    out = [0] * len(parts)
    todo = [(0, len(parts), entry, end)]
    while todo:
        lo, hi, entry, end = todo.pop()
        mid = (lo + hi + 1) // 2
        if hi - lo < 1:
            continue
        cost, rank = forward(parts, lo, mid, _only(entry), [0] * 4)
        rest = backward(parts, mid, hi, end)
        state = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
        out[mid - 1] = state
        if hi - lo > 1:
            todo += [(lo, mid, entry, _only(state)), (mid, hi, state, end)]
    return out


def composed(parts: list[Part]) -> Part:
    """Several parts as one."""
    cost, rank = [], []
    for s in range(4):
        c, r = forward(parts, 0, len(parts), _only(s), [0] * 4)
        cost, rank = cost + c, rank + r
    return Part(cost, rank)


def _end(state: int) -> list:
    """The costs behind a part that is left in ``state``, or (below 0) ends the conversation."""
    return list(END) if state < 0 else _only(state)


def row_parts(initials: list[str], allows: list[int], counts: list[int]) -> tuple[list[Part], list[tuple]]:
    """(parts, (row, step) of each) of rows; of repeated rows all but the first can only be deleted."""
    parts, steps = [], []
    for i, (a, k, n) in enumerate(zip(initials, allows, counts)):
        if k != DROP:
            key = (a if a in ("s", "u", "a") else "", k)
            parts.append(_ROWS[key])
            steps.append((i, _STEPS[key], 1))
            n -= 1
        if n:
            parts.append(_deletes(n))
            steps.append((i, None, n))
    return parts, steps


def rebuilt(roles: list[str], texts: list[str], allows: list[int], counts: list[int], entry: int, leave: int) -> tuple[str, list[str]]:
    """(audit, repaired turns) of a span entered in state ``entry`` and left in ``leave`` (below 0: the end)."""
    parts, steps = row_parts([r[:1] for r in roles], allows, counts)
    audit, out, state = [], [], entry
    for after, (i, step, n) in zip(crossings(parts, entry, _end(leave)), steps):
        edits = "D" * n if step is None else step[state, after][1]
        audit.append(edits)
        for e in edits if step else "":
            if e != "D":
                to = SYSTEM if e == "K" and roles[i][:1] == "s" else _next(state)
                out.append((roles[i] if e == "K" else ROLES[to]) + ":" + ("" if e == "I" else texts[i]))
                state = to
        state = after
    if leave < 0:
        for e in TAIL[state]:
            state = _next(state)
            audit.append(e)
            out.append(ROLES[state] + ":")
    return "".join(audit), out


# ------------------------------------------------------------------ on Spark

def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()
_PART = _fields(cost=T.ArrayType(_LONG), rank=T.ArrayType(_INT))
_WAYS = T.ArrayType(_fields(id=_LONG, entry=_INT, leave=_INT))
_PIECE = _fields(audit=_STRING, turns=_STRING, n_turns=_LONG, illegal=_LONG, first=_STRING, last=_STRING, cost=_LONG)


def _numbered(most: int):
    """A step that numbers the spans of sorted rows; a span has at most ``most`` rows, of one conversation."""
    def run(batches):
        span, now, size, chars = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            spans, places = [], []
            for known, conv, n in zip(batch["known"].tolist(), batch["conv"].tolist(), batch["text"].str.len().tolist()):
                if (known, conv) != now or size >= most or chars + n > SPAN_CHARS and size:
                    span, now, size, chars = span + (now is not None), (known, conv), 0, 0
                spans.append(span)
                places.append(size)
                size, chars = size + 1, chars + n
            yield batch.assign(span=spans, place=places)

    return run


@pandas_udf(_PART)
def _span_part(initials: pd.Series, allows: pd.Series, counts: pd.Series) -> pd.DataFrame:
    found = [composed(row_parts(list(a), list(k), list(n))[0]) for a, k, n in zip(initials, allows, counts)]
    return pd.DataFrame({"cost": [p.cost for p in found], "rank": [p.rank for p in found]})


def _parts(costs, ranks) -> list[Part]:
    return [Part([int(x) for x in c], [int(x) for x in r]) for c, r in zip(costs, ranks)]


@pandas_udf(_PART)
def _composed(costs: pd.Series, ranks: pd.Series) -> pd.DataFrame:
    found = [composed(_parts(c, r)) for c, r in zip(costs, ranks)]
    return pd.DataFrame({"cost": [p.cost for p in found], "rank": [p.rank for p in found]})


@pandas_udf(_WAYS)
def _chosen(ids: pd.Series, costs: pd.Series, ranks: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.Series:
    out = []
    for i, c, r, e, x in zip(ids, costs, ranks, entry, leave):
        states = crossings(_parts(c, r), int(e), _end(int(x)))
        ends = states[:-1] + [int(x)]
        out.append([{"id": int(a), "entry": b, "leave": d} for a, b, d in zip(i, [int(e)] + states[:-1], ends)])
    return pd.Series(out)


@pandas_udf(_PIECE)
def _pieces(rows: pd.Series, allows: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.DataFrame:
    out = []
    for r, k, e, x in zip(rows, allows, entry, leave):
        roles, texts, counts = [a["role"] for a in r], [a["text"] for a in r], [int(a["n"]) for a in r]
        k = [int(a) for a in k]
        audit, turns = rebuilt(roles, texts, k, counts, int(e), int(x))
        initials = [a[:1] for a in roles]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials)) + sum(n - 1 for n in counts)
        stays = [row for row, edit in zip([i for i, n in enumerate(counts) for _ in range(n)], audit.replace("I", "")) if edit != "D"]
        cost = sum({"I": INSERT, "R": REROLE, "D": DELETE, "K": 0}[a] for a in audit) + TRUNCATED * sum(k[i] == CUT for i in stays)
        out.append((audit, "\n".join(turns), len(turns), illegal, initials[0], initials[-1], cost))
    return pd.DataFrame(out, columns=["audit", "turns", "n_turns", "illegal", "first", "last", "cost"])


def _joined(batches):
    """Finished pieces in order -> one row of each conversation; texts pass through a running hash."""
    now, audit, digest, some, illegal, cost, last = None, [], hashlib.sha256(), False, 0, 0, None
    names = ["known", "conv", "illegal", "cost", "audit", "repaired_sha256"]

    def row():
        return (*now, illegal, cost, "".join(audit), digest.hexdigest())

    for batch in batches:
        out = []
        for r in batch.itertuples():
            if (r.known, r.conv) != now:
                if now is not None:
                    out.append(row())
                now, audit, digest, some, illegal, cost, last = (r.known, r.conv), [], hashlib.sha256(), False, 0, 0, None
            audit.append(r.audit)
            if r.n_turns:
                digest.update((("\n" if some else "") + r.turns).encode("utf-8", "surrogatepass"))
                some = True
            illegal += r.illegal + (last is not None and last + r.first not in ("su", "ua", "au"))
            cost, last = cost + r.cost, r.last
        if out:
            yield pd.DataFrame(out, columns=names)
    if now is not None:
        yield pd.DataFrame([row()], columns=names)


def _spans(df: DataFrame, key: Column, *names: str) -> DataFrame:
    """Nodes of a level with their children in order, as one array for each name."""
    grouped = df.groupBy(*CONV, key.alias("parent")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("c"))
    return grouped.select(*CONV, "parent", *[F.col(f"c.{n}").alias(f"{n}s") for n in names])


def _entries(spans: DataFrame) -> DataFrame:
    """(known, conv, span, entry, leave) of every span: the states in which it is entered and left."""
    many = spans.groupBy(*CONV).agg(F.count("*").alias("n")).filter("n > 1").select(*CONV)
    if many.isEmpty():
        return spans.select(*CONV, "span", F.lit(NOTHING).alias("entry"), F.lit(-1).alias("leave"))
    single = spans.join(many, list(CONV), "left_anti").select(*CONV, "span", F.lit(NOTHING).alias("entry"), F.lit(-1).alias("leave"))
    p = _span_part("rows.initial", "rows.allows", "rows.n")
    levels = [materialise(spans.join(many, list(CONV), "left_semi").select(*CONV, F.col("span").alias("id"), p.alias("p"))
                          .select(*CONV, "id", "p.*"), "repair-spans")]
    shifts = [0, *LEVELS]
    groups = []
    for below, above in zip(shifts, LEVELS):
        groups.append(_spans(levels[-1], F.shiftright("id", above - below), "id", "cost", "rank"))
        up = groups[-1].select(*CONV, F.col("parent").alias("id"), _composed("costs", "ranks").alias("p")).select(*CONV, "id", "p.*")
        levels.append(materialise(up, "repair-levels"))
    ways = levels[-1].select(*CONV, F.col("id").alias("parent"), F.lit(NOTHING).alias("entry"), F.lit(-1).alias("leave"))
    for g in reversed(groups):
        down = g.join(ways, [*CONV, "parent"]).select(*CONV, F.inline(_chosen("ids", "costs", "ranks", "entry", "leave")))
        ways = materialise(down.withColumnRenamed("id", "parent"), "repair-ways")
    return single.unionByName(ways.withColumnRenamed("parent", "span"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` (conv_id, turn, role, text) after damage by the hash of conversation and turn."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    what = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", what.alias("what")).filter("what <> 0")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def repair(rows: DataFrame, conversations: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows`` has conv_id, turn, role and text. ``conversations`` (conv_id) may
    name conversations without rows, which come back empty. ``span`` bounds the
    rows that one step solves at a time; results do not depend on it.
    """
    text_batches(rows)
    keyed = rows.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
                        F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    once = keyed.groupBy("known", "conv", "timed", "turn", "role", "text").agg(F.count("*").alias("n"))
    order = ("known", "conv", "timed", "turn", "role", "digest")
    sorted_rows = once.withColumn("digest", F.sha2("text", 256)).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "known boolean, conv long, timed boolean, turn long, role string, text string, n long, digest string, span long, place int"
    table = materialise(sorted_rows.mapInPandas(_numbered(span), schema), "repair-rows")

    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    facts = table.select("known", "conv", "timed", "turn", "role", "digest", "n", "span", "place", (said == "").alias("blank"),
                         (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"))
    first = facts.groupBy("known", "conv", "role", "digest").agg(F.min(F.struct("timed", "turn")).alias("m")).select(
        "known", "conv", "role", "digest", "m.timed", "m.turn", F.lit(True).alias("is_first"))
    facts = facts.join(first, ["known", "conv", "role", "digest", "timed", "turn"], "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
    stays = ~F.col("blank") & F.col("is_first")
    facts = facts.withColumn("allows", F.when(~stays, DROP).when(F.col("cut"), CUT).otherwise(FREE))
    facts = materialise(facts, "repair-facts")

    spans = facts.groupBy(*CONV, "span").agg(F.array_sort(F.collect_list(F.struct(
        "place", F.substring("role", 1, 1).alias("initial"), "allows", "n"))).alias("rows"))
    spans = materialise(spans, "repair-codes")
    texts = table.groupBy(*CONV, "span").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text", "n"))).alias("said"))
    ways = _entries(spans)
    pieces = (texts.join(spans.select(*CONV, "span", F.col("rows.allows").alias("allows")), [*CONV, "span"]).join(ways, [*CONV, "span"])
              .select(*CONV, "span", _pieces("said", "allows", "entry", "leave").alias("p")).select(*CONV, "span", "p.*"))
    whole = pieces.repartition(*CONV).sortWithinPartitions(*CONV, "span").mapInPandas(
        _joined, "known boolean, conv long, illegal long, cost long, audit string, repaired_sha256 string")

    turns = F.when(F.col("timed"), F.col("turn"))
    wide = F.max(turns).cast("decimal(20,0)") - F.min(turns).cast("decimal(20,0)") + 1 - F.count_distinct(turns)
    counts = facts.groupBy(*CONV).agg(
        F.least(F.coalesce(wide, F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("is_first").cast("int"))).alias("duplicate"),
        F.sum(F.when(stays & F.col("cut"), 1).otherwise(0)).alias("truncated"))
    every = (rows if conversations is None else conversations).select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")).distinct()
    found = every.join(counts, list(CONV), "left").join(whole, list(CONV), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same rows from DuckDB: the cheapest edits chosen from the last row backward, with whole audits as text.

    ``v`` holds for each of the four states (from 1) the least (cost, edits, repaired turns) of the rows that follow.
    """
    def way(cost: str, edit: str, turn: str, rest: str) -> str:
        return f"{{'c': {cost} + {rest}.c, 'e': '{edit}' || {rest}.e, 't': {turn} || {rest}.t}}"

    kept, more = "chr(10) || r.role || ':' || r.text", "CASE r.fault WHEN 't' THEN 3 ELSE 0 END"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    consumed = f"""list_transform([1, 2, 3, 4], lambda s: list_min(list_concat([{way('4', 'D', "''", 'd.v[s]')}],
      CASE WHEN r.fault IN ('b', 'd') THEN [] WHEN r.a = 's' AND s = 1 THEN [{way(more, 'K', kept, 'd.v[2]')}]
        WHEN r.a = 'u' AND s <> 3 THEN [{way(more, 'K', kept, 'd.v[3]')}] WHEN r.a = 'a' AND s = 3 THEN [{way(more, 'K', kept, 'd.v[4]')}] ELSE [] END,
      CASE WHEN r.fault IN ('b', 'd') THEN [] WHEN s = 3 THEN [{way('3 + ' + more, 'R', assistant + ' || r.text', 'd.v[4]')}]
        ELSE [{way('3 + ' + more, 'R', user + ' || r.text', 'd.v[3]')}] END)))"""
    inserted = f"""list_transform([1, 2, 3, 4], lambda s: list_min([n[s],
      CASE s WHEN 3 THEN {way('3', 'I', assistant, 'n[4]')} ELSE {way('3', 'I', user, 'n[3]')} END,
      CASE s WHEN 3 THEN {way('6', 'II', assistant + ' || ' + user, 'n[3]')} ELSE {way('6', 'II', user + ' || ' + assistant, 'n[4]')} END]))"""
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS what FROM k),
g AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE what <> 0),
o AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS a, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM g),
r AS MATERIALIZED (SELECT *, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(a) OVER (PARTITION BY conv_id ORDER BY i) || a AS pair FROM o),
f AS (SELECT conv_id, max(i) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count_if(fault = 'b') AS blank,
    count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
d AS (SELECT conv_id, n AS i, [{{'c': 0, 'e': '', 't': ''}}, {{'c': 6, 'e': 'II', 't': {user} || {assistant}}},
    {{'c': 3, 'e': 'I', 't': {assistant}}}, {{'c': 0, 'e': '', 't': ''}}] AS v FROM f
  UNION ALL
  SELECT conv_id, i - 1, {inserted}
  FROM (SELECT d.conv_id, d.i, {consumed} AS n FROM d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i) z)
SELECT c.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank, CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(d.v[1].c, 0) AS BIGINT) AS cost,
  coalesce(d.v[1].e, '') AS audit, sha256(coalesce(substr(d.v[1].t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = 0
"""


ORACLE_SQL = _oracle()
