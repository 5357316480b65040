"""Quality rules with thresholds that adapt to each language and source, on DataFrame functions only.

Base rules are fixed: too few words, or too many words in repeated three-word windows.  The other
measures get their cut-offs from quantile sketches: a sketch counts values by their eight leading
binary digits, so its relative error is below 1/128, its size is bounded, and sketches of parts add
up to the sketch of the whole.  A document fails a measure beyond the upper quartile plus
``reach`` times the distance from the median to it (or ``least_spread``, if larger); the length of
words is also bounded from below.  Small groups use the merged sketch of their language, and small
languages that of the corpus.

Defined cases: null or empty text has no words and fails; null language and null source are groups of
their own; repeated rows count and are judged one by one; an empty table gives no rows.  Columns of
the input stay, except those named like a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

UNIT = 10_000  # measures are integers in ten-thousandths
#: measure -> (least spread, bounded from below too)
MEASURES = {"symbols": (100, False), "dup_lines": (1_000, False), "repeats": (500, False), "word_length": (2_500, True)}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GROUP = ("_lang", "_source")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(windows: Column) -> Column:
    """Words covered by windows (array of hashes) that occur twice or more."""

    def positions(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counted = let(let(placed, positions), covered)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), counted).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, group columns, base counts and the measures of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.regexp_replace(text, r"[\x09-\x0D]", " ")
    own = [F.col(f"`{c}`") for c in keep]
    groups = [F.col(lang_col).alias(GROUP[0]), F.col(source_col).alias(GROUP[1])]
    split = docs.select(
        *own, *groups, F.array_remove(F.split(spaced, " ", -1), "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    counted = split.select(
        *own, *GROUP, "n_symbols", F.size(words).cast("long").alias("n_words"), F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        F.size(lines).alias("_n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), windows.alias("_windows"),
    )
    full = counted.withColumn("n_repeat_words", repeated_words(F.col("_windows"))).drop("_windows")
    share = lambda a, b: F.when(b > 0, F.floor(F.lit(UNIT) * a / b)).otherwise(0).cast("long")
    return full.select(
        *own, *GROUP, *BASE,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share(F.col("n_symbols"), F.col("word_chars")).alias("_symbols"), share(F.col("n_dup_lines"), F.col("_n_lines")).alias("_dup_lines"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("_repeats"), share(F.col("word_chars"), F.col("n_words")).alias("_word_length"),
    )


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by (group, measure, value cut to eight leading binary digits)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_{m}").alias("v")) for m in MEASURES]))
    long = rows.select(*GROUP, each.alias("x")).select(*GROUP, "x.*").withColumn("s", F.greatest(F.length(F.bin("v")) - 8, F.lit(0)))
    return long.withColumn("v", F.expr("shiftleft(shiftright(v, s), s)")).groupBy(*GROUP, "measure", "v").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of each sketch, and its count; a sketch has a bounded number of values."""
    merged = sketch.groupBy(*keys, "measure", "v").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(whole.orderBy("v"))).withColumn("total", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("v")))
    return ranked.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"), F.max("total").alias("total"))


def cut_offs(sketch: DataFrame, reach: int, least_group: int) -> DataFrame:
    """One row per group: ``_high_<measure>`` and ``_low_<measure>``."""
    own, lang, every = (quartiles(sketch, keys) for keys in (list(GROUP), [GROUP[0]], []))
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    joined = own.join(named(lang, "l"), F.col("_lang").eqNullSafe(F.col("l__lang")) & (F.col("measure") == F.col("l_measure"))).join(named(every, "e"), F.col("measure") == F.col("e_measure"))
    pick = lambda q: F.when(F.col("total") >= least_group, F.col(q)).when(F.col("l_total") >= least_group, F.col(f"l_{q}")).otherwise(F.col(f"e_{q}"))
    spread = F.element_at(F.create_map(*[F.lit(x) for m, (s, _) in MEASURES.items() for x in (m, s)]), F.col("measure"))
    bounds = joined.select(*GROUP, "measure", *[pick(q).alias(q) for q in ("q1", "q2", "q3")]).select(
        *GROUP, "measure", (F.col("q3") + reach * F.greatest(F.col("q3") - F.col("q2"), spread)).alias("high"), (F.col("q1") - reach * F.greatest(F.col("q2") - F.col("q1"), spread)).alias("low"),
    )
    one = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"_{c}_{m}")
    return bounds.groupBy(*GROUP).agg(*[one(m, "high") for m in MEASURES], *[one(m, "low") for m, (_, both) in MEASURES.items() if both])


def judged(rows: DataFrame, reach: int, least_group: int) -> DataFrame:
    """Measured rows with ``kept``; the cut-offs come from rows that pass the base rules."""
    bounds = cut_lineage(cut_offs(sketches(rows.where(~F.col("base_failed"))), reach, least_group))
    at = bounds.withColumnsRenamed({g: f"b{g}" for g in GROUP})
    same = F.col("_lang").eqNullSafe(F.col("b_lang")) & F.col("_source").eqNullSafe(F.col("b_source"))
    failed = F.col("base_failed")
    for m, (_, both) in MEASURES.items():
        failed = failed | (F.col(f"_{m}") > F.col(f"_high_{m}"))
        if both:
            failed = failed | (F.col(f"_{m}") < F.col(f"_low_{m}"))
    return rows.join(at, same, "left").withColumn("kept", ~failed)


def quality_rules(docs: DataFrame, reach: int = 6, least_group: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with the base counts, ``base_failed`` and ``kept``."""
    own = [c for c in (docs.columns if keep is None else keep) if c not in (*BASE, "base_failed", "kept")]
    rows = cut_lineage(measured(docs, text_col, lang_col, source_col, own))  # texts are measured once
    return judged(rows, reach, least_group).select(*[F.col(f"`{c}`") for c in own], *BASE, "base_failed", "kept")


def kept_documents(docs: DataFrame, reach: int = 6, least_group: int = 50) -> DataFrame:
    """The documents that pass, with the columns of the input."""
    inner = {c: f"_in{i}" for i, c in enumerate(docs.columns)}  # whatever their names, they meet no result's name
    rows = docs.withColumnsRenamed(inner)
    kept = quality_rules(rows, reach, least_group, inner["text"], inner["lang"], inner["source"]).where("kept")
    return kept.select(*[F.col(i).alias(c) for c, i in inner.items()])
