"""Chat formatting in budgeted windows, on DataFrame functions only.

Template: ``<|im_start|>role`` newline, text ``<|im_end|>`` newline.  In roles and texts every
backslash is doubled and ``<|`` becomes ``<`` backslash ``|``, so a control string in a text can't be taken
for one of the template, and reading back is exact; a newline in a role also gets a backslash.

Windows are spans of whole turns.  Prefix sums of turn tokens choose them: the turns that start in
one cell of half the room form a window, and a turn longer than a cell has a window of its own.  So a
window stays in the budget unless one turn alone is longer than it (or the system turn leaves no
room).  The budget counts the units of ``token_count``: with 512 (history 96) the largest window of
sf0.01 had 1,101 tokens of the byte BPE.  Each window keeps the system turn, repeats the turns of the last ``history`` tokens before
it, and masks both: every assistant text is under the loss mask once.

Defined cases: null text or role is empty; turns of equal number go by role, then text; a null
conv_id is a conversation of its own; rows that repeat are turns of their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quality import let

START, END = "<|im_start|>", "<|im_end|>"
TURN_TOKENS = 4  # of the template, for each turn


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_count(text: Column) -> Column:
    """Words, each further eight characters of a long word, and signs: a unit of its own, no bound on a tokenizer's tokens.

    On the conversations of sf0.01 the byte BPE makes 112,307 tokens of 57,318 units (1.96 times).
    """
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{N}]{1,8}", "w"), r"\s+", "")).cast("long")


def numbered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns with their number ``i``, tokens ``t``, tokens before them ``s``, and whether they are the system turn."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("t", token_count(F.col("text")) + TURN_TOKENS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("system", (F.col("i") == 1) & (F.col("role") == "system"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("system"), F.lit(0)).otherwise(F.col("t"))
    kept = F.max(F.when(F.col("system"), F.col("t"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("s", F.coalesce(F.sum(own).over(before), F.lit(0))).withColumn("kept", F.coalesce(kept, F.lit(0)))


def windows_of(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with the number ``w`` of their window."""
    cell = F.greatest((F.lit(budget) - F.col("kept") - history) / 2, F.lit(1)).cast("long")
    order = Window.partitionBy("conv_id").orderBy("i")
    rows = turns.withColumn("cell", F.floor(F.col("s") / cell)).withColumn("long", (F.col("t") > cell) & ~F.col("system"))
    last = lambda c: F.lag(c).over(order)
    # the system turn opens the first window, whatever its length
    first = last("cell").isNull()
    begins = first | (~last("system") & ((F.col("cell") != last("cell")) | F.col("long") | last("long")))
    return rows.withColumn("begins", begins).withColumn("w", F.sum(F.col("begins").cast("int")).over(order)).drop("cell", "long")


def window_turns(turns: DataFrame, history: int) -> DataFrame:
    """Turns of every window: its own, repeated ones and the system turn; ``new`` marks its own.

    A window begins within ``history`` tokens after the turns that it repeats, so both meet in cells of
    that length; each holds at most ``history / TURN_TOKENS`` turns.
    """
    own = turns.select("conv_id", "w", "i", "role", "text", F.lit(True).alias("new"))
    starts = turns.where("begins AND w > 1").select(F.col("conv_id").alias("c"), F.col("w").alias("w2"), F.col("s").alias("s2"))
    if history > 0:
        near = starts.withColumn("cell", F.explode(F.array(F.floor(F.col("s2") / history), F.floor(F.col("s2") / history) - 1)))
        past = turns.where(~F.col("system")).withColumn("cell2", F.floor(F.col("s") / history))
        meet = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("cell2")) & (F.col("w2") > F.col("w")) & (F.col("s2") - F.col("s") <= history)
        own = own.union(past.join(near, meet).select("conv_id", F.col("w2").alias("w"), "i", "role", "text", F.lit(False)))
    system = turns.where("system").select("conv_id", "i", "role", "text")
    return own.union(system.join(starts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.col("w2").alias("w"), "i", "role", "text", F.lit(False)))


def chat_windows(conversations: DataFrame, budget: int = 512, history: int = 96, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window, text, loss, n_repeated): loss has the spans (start, end) of masked-in text in code points."""
    turns = cut_lineage(windows_of(numbered_turns(conversations, conv_col, turn_col, role_col, text_col), budget, history))
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    body = escaped(F.col("text"))
    parts = window_turns(turns, history).select(
        "conv_id", "w", "i", "new", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), body.alias("body"), ((F.col("role") == "assistant") & F.col("new")).alias("learn"),
    )
    each = F.sort_array(F.collect_list(F.struct("i", "new", "head", "body", "learn")))  # a window: bounded by the budget
    grouped = parts.groupBy("conv_id", "w").agg(each.alias("p"))
    piece = lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("loss"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(x["learn"], F.concat(a["loss"], span)).otherwise(a["loss"]).alias("loss"))

    return grouped.select(
        "conv_id", F.col("w").alias("window"), F.array_join(F.transform("p", piece), "").alias("text"),
        F.aggregate("p", start, step)["loss"].alias("loss"), F.size(F.filter("p", lambda x: ~x["new"])).alias("n_repeated"),
    )


def read_turns(text: Column) -> Column:
    """Turns (role, text) of one window's text."""
    turns = F.slice(F.split(text, r"<\|im_start\|>", -1), 2, F.length(text) + 1)
    head = r"(?s)^((?:[^\\\n]++|\\.)*+)\n(.*)<\|im_end\|>\n$"
    return F.transform(turns, lambda t: F.struct(unescaped(F.regexp_extract(t, head, 1)).alias("role"), unescaped(F.regexp_extract(t, head, 2)).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask."""
    piece = lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(loss, piece), "")


def read_conversations(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_text, loss_text, formatted_chars), read from the windows alone.

    A conversation's digest needs all its turns in order, so they meet in one row.
    """
    # repeated turns, and the system turn that is kept, lead a window
    fresh = let(read_turns(F.col("text")), lambda t: F.slice(t, F.col("n_repeated") + 1, F.size(t) + 1))
    shown = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    rows = windows.select("conv_id", "window", fresh.alias("t"), read_loss(F.col("text"), F.col("loss")).alias("loss"), F.length("text").cast("long").alias("chars"))
    rows = rows.select("conv_id", F.struct("window", F.array_join(F.transform("t", shown), "").alias("turns"), "loss").alias("x"), F.size("t").cast("long").alias("n"), "chars")
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select("conv_id", "n_turns", F.array_join("x.turns", "").alias("turns_text"), F.array_join("x.loss", "").alias("loss_text"), "formatted_chars")
