"""Groups of spelling variants: near words by exact partition-and-enumerate signatures of letter multisets.

A word is taken as a binary vector with one place for each (letter, how-manieth of it).  One replaced
letter moves the vector by two places, one inserted or deleted letter by one.  The alphabet is cut
into parts of about equal use; two vectors that differ in at most two places agree on all parts but
two, so words with equal letters on some choice of all but two parts (all but one, if lengths differ)
are all candidates: no near pair is missed.  A signature also holds the length and the half of the
word that the edit leaves alone (the first or the last), which keeps its groups small; all signatures
of a word are enumerated, equal ones are joined, and each pair is verified by edit distance.

Steps: words and their numbers of occurrences, parts from the counts of letters (one row per letter
reaches the driver), signatures, joins, the most frequent near word as the form, and forms followed to
the root by doubling.  A form is at least ``lead`` times as frequent, so chains are short and end.

Defined cases: null or empty text has no words; a null doc_id counts as the empty text where words are
altered; repeated rows count again; ties go to the smaller word in code-point order; a word of any
length is compared whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"


def letter_runs(docs: DataFrame, least_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run) of every maximal run of at least ``least_chars`` letters, A-Z lowered."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def thinned(runs: DataFrame, every: int) -> DataFrame:
    """Runs as words; where ``every`` divides the checksum of document and run, the letter that it points to is gone."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    gone = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, gone).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, least_chars: int, least_count: int) -> DataFrame:
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def alphabet_parts(words: DataFrame, parts: int) -> list[str]:
    """Letters dealt to parts of about equal use, the most used first."""
    used = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    load, letters = [0] * parts, [""] * parts
    for r in sorted(used.collect(), key=lambda r: (-r.n, r.letter)):  # one row per letter
        least = load.index(min(load))
        load[least] += r.n
        letters[least] += r.letter
    return letters


def by_part(words: DataFrame, letters: list[str]) -> DataFrame:
    """The sorted letters of each part as columns: equal texts are equal multisets."""
    ordered = words.withColumn("ordered", F.array_join(F.array_sort(F.split("word", "")), ""))
    every = "".join(letters)
    others = ["".join(c for c in every if c not in own) for own in letters]
    return ordered.select(*words.columns, *(F.translate("ordered", other, "").alias(f"part_{i}") for i, other in enumerate(others)))


def signatures(words: DataFrame, parts: int, apart: int, length: Column) -> DataFrame:
    """(signature, word, n): all choices of all but ``apart`` parts, with the half of a word of ``length`` letters that stays."""
    half = F.floor(length / 2).cast("int")
    rest = (length - half).cast("int")
    halves = [("first", F.substring(F.col("word"), F.lit(1), half)), ("last", F.substring(F.col("word"), F.length("word") - rest + 1, rest))]
    found = [
        F.xxhash64(F.lit(f"{side} {chosen}"), length, text, *(F.col(f"part_{i}") for i in chosen))
        for chosen in itertools.combinations(range(parts), parts - apart) for side, text in halves
    ]
    return words.select("word", "n", F.explode(F.array(*found)).alias("signature"))


def near_pairs(words: DataFrame, parts: int = 4) -> DataFrame:
    """(word, n, other, other_n) of all pairs that differ by one inserted, deleted or replaced letter, both ways round."""
    cut = cut_lineage(by_part(words, alphabet_parts(words, parts)))
    length = F.length("word")
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    pair = [F.col("a.word"), F.col("a.n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")]
    replaced = signatures(cut, parts, 2, length)
    same = replaced.alias("a").join(replaced.alias("b"), "signature").where((F.col("a.word") < F.col("b.word")) & near).select(*pair)
    short, long = signatures(cut, parts, 1, length), signatures(cut, parts, 1, length - 1)
    longer = short.alias("a").join(long.alias("b"), "signature").where((F.length("a.word") + 1 == F.length("b.word")) & near).select(*pair)
    once = cut_lineage(same.union(longer).distinct())  # a pair may share several signatures
    return once.union(once.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling: each round replaces the end by the end's own."""
    ends = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(ends.join(onward, "root", "left"))
        if joined.where("next IS NOT NULL").isEmpty():
            return ends
        ends = joined.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, lead: int = 10, parts: int = 4) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words with their numbers of occurrences."""
    words = cut_lineage(words)
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("form")))
    near = near_pairs(words, parts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left").withColumn("form_n", -F.col("best.rank"))
    has_form = F.col("form_n") >= lead * F.col("n")
    known = cut_lineage(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.form")).alias("form"), F.when(has_form, F.col("form_n")).alias("form_n")))
    found = known.join(roots(known.where("form IS NOT NULL")), "word", "left")
    return found.withColumn("root", F.coalesce("root", "word"))
