"""Secret scans on DataFrame functions only: fixed patterns, then character Markov models.

Spans of a pattern follow from the pieces between its matches, whose lengths add up to positions in
code points.  Two Markov chains over characters are trained on labelled samples: the values that
the patterns find are random strings, the words of documents without any are ordinary identifiers.
A run of key characters whose log-likelihood ratio passes a threshold is a further span, of kind
``model``.  Scores are integers in thousandths, so results do not depend on the order of sums.

Defined cases: null text is empty; no pattern spans in the whole table: nothing to learn from, and no
model spans; a model span never overlaps a pattern's; rows that repeat are scanned one by one; an
empty table gives no rows.  Columns of the input stay, except those named like a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quality import let

# The patterns of the base rules, in the order of their kinds
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind -> (pattern, group whose length counts, least length, pattern that every hit contains)
KINDS = {
    "assign": (ASSIGN, 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    "access": (ACCESS, 0, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (HEX, 0, 24, r"[0-9a-f]{24}"),
}
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KEY_RUN = r"[A-Za-z0-9+/_=-]"
STATES = len(KEY_CHARS) + 1  # 0 is any other character
SPAN = "struct<start:long,kind:int,end:long>"
NAMES = (*KINDS, "model")


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans (start, kind, end) of leftmost matches, without those whose group is too short."""
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    lengths = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("hit"), F.transform(part, lambda m: F.length(m)).alias("part"))

    def placed(rows: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
        walk = F.aggregate(rows, start, lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts")))
        return let(walk["starts"], lambda starts: F.filter(F.transform(rows, lambda x, i: F.when(
            x["part"] >= least, F.struct(F.get(starts, i).alias("start"), F.lit(kind).alias("kind"), (F.get(starts, i) + x["hit"]).alias("end")).cast(SPAN))), lambda s: s.isNotNull()))

    return let(lengths, placed)


def pattern_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(f"array<{SPAN}>")
    return {k: F.when(text.rlike(hint), matches(text, p, g, least, i)).otherwise(none) for i, (k, (p, g, least, hint)) in enumerate(KINDS.items())}


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def state(char: Column) -> Column:
    return F.instr(F.lit(KEY_CHARS), char)


def transitions(values: DataFrame) -> list:
    """Counts (a, b, n) of neighbouring states over the strings ``value``; each starts from state 0."""
    padded = values.select(F.concat(F.array(F.lit(" ")), characters(F.col("value"))).alias("c"))
    pairs = F.arrays_zip(F.col("c").alias("a"), F.slice("c", 2, F.size("c")).alias("b"))
    each = padded.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("b IS NOT NULL")
    return each.groupBy(state(F.col("a")).alias("a"), state(F.col("b")).alias("b")).agg(F.count("*").alias("n")).collect()  # at most STATES squared


def log_chain(counts: list) -> list[float]:
    """Log transition probabilities, row by row.

    A row leans on the shares of its next states over all rows, as if it had seen STATES of them; so a
    state that a class rarely holds is unlikely after any other.
    """
    seen = [[0] * STATES for _ in range(STATES)]
    for r in counts:
        seen[r.a][r.b] += r.n
    total = sum(map(sum, seen)) + STATES
    share = [(sum(row[b] for row in seen) + 1) / total for b in range(STATES)]
    return [math.log((n + STATES * p) / (sum(row) + STATES)) for row in seen for n, p in zip(row, share, strict=True)]


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    name = lambda kind: F.element_at(F.array(*[F.lit(n) for n in NAMES]), kind + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def ratio_table(docs: DataFrame, text: Column, scanned: DataFrame, samples: int) -> list[int] | None:
    """Log-likelihood ratios of transitions, from at most ``samples`` distinct found values and as many documents without any.

    The samples are those of the lowest hashes, so they do not depend on the partitions.
    """
    value = lambda s: F.substr(F.col("_text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    hits = scanned.where(F.size("_base") > 0).select(F.explode(F.transform("_base", lambda s: F.when(s["kind"] == 0, F.regexp_extract(value(s), ASSIGN, 2)).otherwise(value(s)))).alias("value"))
    random = hits.where(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).distinct().orderBy(F.xxhash64("value"), "value").limit(samples)
    found = transitions(random)
    if not found:
        return None
    hashed = docs.select(text.alias("t")).withColumn("h", F.xxhash64("t"))
    last = hashed.select("h").distinct().orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    plain = hashed.where(F.col("h") <= last).dropDuplicates(["h"])
    plain = plain.where(F.size(F.concat(*pattern_spans(F.col("t")).values())) == 0)
    words = plain.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z_][A-Za-z0-9_-]{3,}"), F.lit(0))).alias("value"))
    return [round(1000 * (x - y)) for x, y in zip(log_chain(found), log_chain(transitions(words)), strict=True)]


def model_spans(text: Column, base: Column, table: list[int], least_run: int, least_score: int) -> Column:
    """Runs of key characters with letters and digits whose summed ratio reaches ``least_score`` thousandths."""
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded to one literal
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("score"))

    def score(value: Column) -> Column:
        step = lambda a, s: F.struct(s.alias("state"), (a["score"] + F.get(ratios, a["state"] * STATES + s)).alias("score"))
        return F.aggregate(F.transform(characters(value), state), start, step)["score"]

    def random(s: Column) -> Column:
        value = F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        free = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return free & let(value, lambda v: F.when(v.rlike("[0-9]") & v.rlike("[A-Za-z]"), score(v) >= least_score).otherwise(F.lit(False)))

    run = f"{KEY_RUN}{{{least_run},}}"
    return F.when(text.rlike(run), F.filter(matches(text, run, 0, least_run, len(KINDS)), random)).otherwise(F.array().cast(f"array<{SPAN}>"))


def secret_scan(docs: DataFrame, samples: int = 2_000, least_run: int = 20, least_score: int = 15_000, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with n_assign, n_access, n_hex, ``base_spans`` and ``all_spans``."""
    results = ("n_assign", "n_access", "n_hex", "base_spans", "all_spans")
    own = [c for c in (docs.columns if keep is None else keep) if c not in results]
    kept = [F.col(f"`{c}`") for c in own]
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(*kept, text.alias("_text"), *[c.alias(f"_{k}") for k, c in pattern_spans(text).items()])
    found = found.select(*kept, "_text", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*[F.col(f"_{k}") for k in KINDS]).alias("_base"))
    # texts are scanned once; only those that hold a span or a run are looked at again
    again = (F.size("_base") > 0) | F.col("_text").rlike(f"{KEY_RUN}{{{least_run}}}")
    scanned = cut_lineage(found.withColumn("_text", F.when(again, F.col("_text"))))
    table = ratio_table(docs, text, scanned, samples)
    none = F.array().cast(f"array<{SPAN}>")
    model = F.when(F.col("_text").isNotNull(), model_spans(F.col("_text"), F.col("_base"), table, least_run, least_score)).otherwise(none) if table else none
    return scanned.select(*kept, *[f"n_{k}" for k in KINDS], F.col("_base").alias("base_spans"), F.concat("_base", model).alias("all_spans"))


def redacted(docs: DataFrame, mask: str = "[secret]", text_col: str = "text", **settings) -> DataFrame:
    """Documents with every span replaced by ``mask``; spans that overlap become one."""
    inner = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    rows = secret_scan(docs.withColumnsRenamed(inner), text_col=inner[text_col], **settings)
    text = F.col(inner[text_col])
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit(mask)).alias("out"))
        joined = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when((s["start"] >= a["at"]), new).otherwise(joined)

    tail = lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size("all_spans") > 0, F.aggregate(F.sort_array("all_spans"), first, step, tail)).otherwise(text)
    return rows.select(*[(clean if c == text_col else F.col(i)).alias(c) for c, i in inner.items()])
