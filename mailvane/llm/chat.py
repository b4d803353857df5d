"""Chat formatting into token-budgeted windows of whole turns.

Prefix sums of turn tokens choose the turns of a window: turns (system turn
aside) whose tokens begin in one stretch of ``step`` tokens are its new turns.
Before them a window repeats the system turn and those turns that begin in the
last ``history`` tokens before the stretch, as far as the new turns leave room;
repeats carry no loss. The step of a
conversation is half of what its system turn and the history leave of the
budget; a long system turn shortens the history first, to a third of the rest.
Only texts of new assistant turns are under the loss mask, so each is a target
exactly once.

Defined results: turns are taken by turn, then role and text (null first);
null role or text counts as empty; an empty turn still has the tokens of its
marks; the first system turn of a conversation is the retained one, later ones
are ordinary turns; a turn longer than a step is kept whole and makes its
window longer than the budget; a null conv_id is a conversation of its own;
repeated rows are repeated turns; an empty table has no window. Columns other
than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import text_batches

NEW, AGAIN, END = "<|turn|>", "<|again|>", "<|end|>"
#: Strings that would mark or end something here or in common templates (fixed values); none occurs in formatted texts.
CONTROL = (NEW, AGAIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|startoftext|>", "<|endoftext|>")
BUDGET, HISTORY = 1024, 256
#: Tokens that the marks of a turn take.
MARKS = 4
#: Turn numbers that one step of the prefix sum covers.
SPAN = 256

_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)


def escape(text: str) -> str:
    """Double every backslash and put one behind the first character of every control string."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_window(turns) -> tuple[str, list[dict]]:
    """(text, loss spans) of (repeated, role, text) turns; a role's line breaks are escaped as well."""
    parts, spans, at = [], [], 0
    for again, role, text in turns:
        head = (AGAIN if again else NEW) + escape(role).replace("\n", "\\\n") + "\n"
        body = escape(text)
        if role == "assistant" and not again:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_window(text: str):
    """(repeated, role, text, start of the text) of every turn, read from a formatted window."""
    at = 0
    while at < len(text):
        again = text.startswith(AGAIN, at)
        role_at = at + len(AGAIN if again else NEW)
        nl = role_at
        while text[nl] != "\n":
            nl += 2 if text[nl] == "\\" else 1
        end = text.index(END, nl + 1)
        yield again, unescape(text[role_at:nl]), unescape(text[nl + 1:end]), nl + 1
        at = end + len(END) + 1


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_tokens, text, loss) of all conversations; loss holds (start, end) places in text.

    A conversation is not gathered: sums run within SPAN turn numbers first and
    then over the sums, and only the turns of one window meet.
    """
    if not 0 <= history <= (budget - history) // 2:
        raise ValueError("history must fit into half of what it leaves of the budget")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(r"\w+|[^\w\s]")) + MARKS)
    turns = turns.withColumn("span", F.expr(f"coalesce(turn div {SPAN}, -9223372036854775808)"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv_id", "span").orderBy(*order)
    system = F.when(F.col("role") == "system", 1).otherwise(0)
    turns = turns.withColumn("sys_in", F.sum(system).over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "sum_in", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("row_in", F.row_number().over(inside))
    spans = turns.groupBy(F.col("conv_id").alias("c"), F.col("span").alias("s")).agg(
        F.sum("tokens").alias("t"), F.sum(system).alias("y"), F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    for name, of in (("t0", "t"), ("y0", "y"), ("n0", "n")):
        spans = spans.withColumn(name, F.coalesce(F.sum(of).over(before), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s"))
    turns = turns.join(spans, same).select(
        "conv_id", "role", "text", "tokens", (F.col("n0") + F.col("row_in")).alias("place"),
        (F.col("t0") + F.coalesce("sum_in", F.lit(0))).alias("from"),
        ((F.col("role") == "system") & (F.col("y0") + F.coalesce("sys_in", F.lit(0)) == 0)).alias("kept"))
    # the retained system turn stands first; sums of the turns behind it leave it out
    kept = turns.filter("kept").select(F.col("conv_id").alias("kc"), F.col("role").alias("krole"), F.col("text").alias("ktext"),
                                       F.col("tokens").alias("ktokens"), F.col("place").alias("kplace"))
    turns = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kc")), "left")
    at = F.col("from") - F.when(F.col("place") > F.col("kplace"), F.col("ktokens")).otherwise(0)
    room = F.greatest(F.lit(budget) - F.coalesce("ktokens", F.lit(0)), F.lit(0))
    history = F.least(F.lit(history), F.floor(room / 3))
    step = F.greatest(F.floor((room - history) / 2), F.lit(1))
    turns = turns.withColumn("at", at).withColumn("window", F.floor(at / step))
    uses = F.array(F.struct("window", F.lit(False).alias("again")),
                   F.struct(F.when(~F.col("kept") & ((F.col("window") + 1) * step - F.col("at") <= history), F.col("window") + 1).alias("window"),
                            F.lit(True).alias("again")))
    turns = turns.withColumn("room", room + F.when(F.col("kept"), F.col("tokens")).otherwise(0))
    placed = turns.select("conv_id", "role", "text", "tokens", "place", "kept", "room", F.inline(uses)).filter("window is not null")
    packed = placed.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("place", "again", "role", "text", "kept", "tokens"))).alias("turns"),
        F.sum(F.when(~F.col("again"), F.col("tokens"))).alias("new"), F.max("room").alias("room")).filter("new is not null")

    def total(turns: Column) -> Column:
        return F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + t["tokens"])

    # of the repeated turns the last ones that the new turns leave room for
    fits = F.filter("turns", lambda t: ~t["again"] | (total(F.filter("turns", lambda u: u["again"] & (u["place"] >= t["place"]))) <= F.col("room") - F.col("new")))
    packed = packed.withColumn("turns", fits).withColumn("tokens", total(F.col("turns")))
    packed = packed.join(kept, F.col("conv_id").eqNullSafe(F.col("kc")), "left").select(
        "conv_id", "window", "tokens", F.transform("turns", lambda t: F.struct(t["again"], t["role"], t["text"])).alias("turns"),
        F.exists("turns", lambda t: t["kept"]).alias("has"), "krole", "ktext", "ktokens", "kplace",
        F.element_at(F.filter("turns", lambda t: ~t["again"]), 1)["place"].alias("first"))
    repeat = ~F.col("has") & (F.col("kplace") < F.col("first"))
    system_turn = F.array(F.struct(F.lit(True).alias("again"), F.col("krole").alias("role"), F.col("ktext").alias("text")))
    turns = F.when(F.coalesce(repeat, F.lit(False)), F.concat(system_turn, "turns")).otherwise(F.col("turns"))

    @pandas_udf("text string, loss array<struct<start: int, end: int>>")
    def formatted(all_turns: pd.Series) -> pd.DataFrame:
        out = [format_window((t["again"], t["role"], t["text"]) for t in turns) for turns in all_turns]
        return pd.DataFrame(out, columns=["text", "loss"])

    text_batches(rows)
    tokens = F.col("tokens") + F.when(F.coalesce(repeat, F.lit(False)), F.col("ktokens")).otherwise(0)
    return packed.select("conv_id", "window", tokens.alias("n_tokens"), formatted(turns).alias("f")).select(
        "conv_id", "window", "n_tokens", "f.text", "f.loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: turns, loss and length, read from text and loss mask alone.

    A digest runs through a conversation's turns in order, so its windows stream
    through one task in order; nothing of them is kept but the digests.
    """
    def run(batches):
        now, state = object(), None

        def row():
            return {"conv": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                    "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for batch in batches:
            out = []
            for conv, text, loss in zip(batch["conv"], batch["text"], batch["loss"]):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for again, role, body, _ in parse_window(text):
                    if not again:
                        state[0] += 1
                        state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    body = unescape(text[span["start"]:span["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield pd.DataFrame(out)
        if state is not None:
            yield pd.DataFrame([row()])

    text_batches(formatted)
    rows = formatted.select(F.col("conv_id").cast("string").alias("conv"), "window", "text", "loss")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "window")
    out = rows.mapInPandas(run, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    kind = formatted.schema["conv_id"].dataType
    return out.select(F.col("conv").cast(kind).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
