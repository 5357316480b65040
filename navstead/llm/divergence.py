"""Which sources of a language use its words differently, by chunk factorization.

White space cuts texts into chunks, and chunks repeat far more often than documents do: a task counts
chunks document by document, equal chunks of all tasks meet by shuffle, and each globally distinct
chunk is cut into terms once, where its rows lie side by side.  Its terms then take over its counts.
Only letters of ASCII and characters beyond it make a term, so no term spans white space.

A term needs a number of documents, not their names: a row carries at most ``min_docs`` - 1 distinct
ids, and none once there are more.  Fewer ids are the complete list, so the test stays exact when
chunks of one document share a term, and nothing about the documents of frequent chunks is kept.

Sums over all kept terms of a language need no row for a term that a group lacks: such a term has the
same smoothed share everywhere in the group.  A sum is split into terms of both groups, of one (by
the histogram of their counts) and of none (by their number).  All arithmetic is in integers.

Defined cases: null text, language or source counts as ''; a group without terms and a language
without kept terms take part, with distance 0 where nothing is kept; rows that repeat a doc_id are one
document, and so are all rows without one, but every occurrence counts; texts and chunks of any length
are read whole; ties go to the smaller name in byte order; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # bytes of UTF-8
HELD = 1_500_000  # (group, chunk) counts that a task holds before it passes them on
ROWS = 10_000
NO_ID = -(2**63)  # stands for a missing doc_id
#: Most chunks of a task have one source and one document, which stand beside the lists of the others; no ``id`` means enough documents.
HOLDERS = "source string, n long, sources array<string>, counts array<long>, id long, ids array<long>"
NAMES = ["source", "n", "sources", "counts", "id", "ids"]


def first_and_rest(values: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, pa.ListArray]:
    """Of consecutive runs of the given sizes: their first values, and lists of the others; both null where there are none."""
    starts = np.cumsum(sizes) - sizes
    others = np.ones(len(values), bool)
    others[starts[sizes > 0]] = False
    more = np.maximum(sizes - 1, 0)
    rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(more)]), pa.int32()), values.filter(pa.array(others)), mask=pa.array(more == 0))
    return values.take(pa.array(starts, pa.int64(), mask=sizes == 0)), rest


def with_first(first: pa.Array, rest: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All values and the row that each belongs to, rows' first values leading."""
    n = np.asarray(pc.fill_null(rest.value_lengths(), 0))
    present = np.flatnonzero(np.asarray(first.is_valid()))
    return pa.concat_arrays([first.drop_null(), rest.flatten()]), np.concatenate([present, np.repeat(np.arange(len(n)), n)])


def in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, ROWS):
        yield batch.slice(a, ROWS)


def chunk_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """A row per (language, chunk) of a task: its sources with their counts, and the ids of its documents if they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = {}
        holders: dict[str, dict[bytes, list]] = {}
        enough: dict[str, set[bytes]] = {}  # chunks with enough documents, which need no further look

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, ids in holders.items():
                place = {c: i for i, c in enumerate(ids)}
                sources = list(counts[lang])
                at = np.concatenate([np.fromiter((place[c] for c in counts[lang][s]), np.int64) for s in sources])
                n = np.concatenate([np.fromiter(counts[lang][s].values(), np.int64) for s in sources])
                own = np.repeat(np.arange(len(sources)), [len(counts[lang][s]) for s in sources])
                order = np.argsort(at, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(ids)))])
                few = [x if len(x) < min_docs else () for x in ids.values()]
                flat = pa.array(np.fromiter((i for x in few for i in x), np.int64))
                holders_of = (
                    *first_and_rest(pa.array(sources, pa.string()).take(pa.array(own[order])), np.diff(ends)), *first_and_rest(pa.array(n[order]), np.diff(ends)),
                    *first_and_rest(flat, np.fromiter(map(len, few), np.int64)))
                columns = [pa.array([lang] * len(ids), pa.string()), pa.array(list(ids), pa.binary()), *(holders_of[i] for i in (0, 2, 1, 3, 4, 5))]
                yield from in_slices(pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", *NAMES]))
            counts.clear()
            holders.clear()
            enough.clear()

        held = 0
        for batch in batches:
            for doc, text, lang, source in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                lang, doc = lang.as_py(), doc.as_py() if doc.is_valid else NO_ID
                chunks = text.as_py().split()  # bytes split at ASCII white space alone
                if not chunks:
                    continue
                own, ids = counts.setdefault(lang, {}).setdefault(source.as_py(), Counter()), holders.setdefault(lang, {})
                held -= len(own)
                own.update(chunks)
                held += len(own)
                full = enough.setdefault(lang, set())
                for chunk in set(chunks) - full:
                    some = ids.get(chunk)
                    if some is None:
                        ids[chunk] = [doc]
                    elif doc not in some:
                        some.append(doc)
                        if len(some) >= min_docs:
                            full.add(chunk)
                if held >= HELD:
                    yield from passed_on()
                    held = 0
        yield from passed_on()

    text, lang, source = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, lang, source).mapInArrow(run, f"lang string, chunk binary, {HOLDERS}")


def chunk_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """A row per (language, chunk, term): equal chunks lie side by side, are summed, and each is cut once for all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, terms = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, langs = batch.column(1).dictionary_encode(), batch.column(0).dictionary_encode()
            own = chunks.dictionary.to_pylist()
            cut = [terms if c == last else TERM.findall(c.lower()) for c in own]  # bytes.lower() changes A-Z alone
            last, terms = own[-1], cut[-1]
            code, lang = (np.asarray(x.indices) for x in (chunks, langs))
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (lang[1:] != lang[:-1])]))  # of each (chunk, language)
            run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
            names, row = with_first(batch.column(2), batch.column(4))
            names, width = names.dictionary_encode(), batch.num_rows + len(names)
            pair, back = np.unique(run_of[row] * width + np.asarray(names.indices), return_inverse=True)
            total = np.bincount(back, with_first(batch.column(3), batch.column(5))[0].to_numpy()).astype(np.int64) if len(pair) else np.zeros(0, np.int64)
            sizes = np.bincount(pair // width, minlength=len(first))
            ids, row = with_first(batch.column(6), batch.column(7))
            ids, order = ids.to_numpy(), run_of[row]
            at = np.lexsort((ids, order))
            ids, order = ids[at], order[at]
            once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (order[1:] != order[:-1])]) if len(ids) else np.zeros(0, bool)
            held = np.bincount(order[once], minlength=len(first))
            many = held >= min_docs
            many[run_of[~np.asarray(batch.column(6).is_valid())]] = True
            once &= ~many[order]
            summed = (
                *first_and_rest(names.dictionary.take(pa.array(pair % width)), sizes), *first_and_rest(pa.array(total), sizes),
                *first_and_rest(pa.array(ids[once]), np.where(many, 0, held)))
            rows = pa.array(cut, pa.list_(pa.binary())).take(pa.array(code[first]))
            at = pc.list_parent_indices(rows)
            columns = [batch.column(0).take(pa.array(first)).take(at), rows.flatten().cast(pa.string()), *(summed[i].take(at) for i in (0, 2, 1, 3, 4, 5))]
            yield from in_slices(pa.RecordBatch.from_arrays(columns, names=["lang", "term", *NAMES]))  # a chunk may have any number of terms

    return counts.repartition("chunk").sortWithinPartitions("chunk", "lang").mapInArrow(run, f"lang string, term string, {HOLDERS}")


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n) of the terms that enough documents of the language hold."""
    term = Window.partitionBy("lang", "term")
    ids = F.array_distinct(F.concat(F.collect_list("id").over(term), F.flatten(F.collect_list("ids").over(term))))
    enough = F.max(F.col("id").isNull()).over(term) | (F.size(ids) >= min_docs)
    dealt = chunk_terms(chunk_counts(docs, min_docs), min_docs).repartition("lang", "term")
    kept = dealt.withColumn("kept", enough).where("kept")
    own = F.array(F.struct(F.col("source"), F.col("n")))
    others = F.coalesce(F.transform(F.arrays_zip("sources", "counts"), lambda s: F.struct(s["sources"].alias("source"), s["counts"].alias("n"))), F.array().cast("array<struct<source:string,n:bigint>>"))
    each = kept.select("lang", "term", F.explode(F.concat(own, others)).alias("s"))
    return each.groupBy("lang", "term", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n")).select("lang", "source", "term", "n")


def share(n: Column, total: Column, terms: Column, scale: int) -> Column:
    """Smoothed share of a term, in units of 1 / scale, from 1: 1 + floor(scale * (n + 2) / (total + 2 * terms))."""
    return F.call_function("div", F.lit(scale).cast("decimal(12,0)") * (n + 2).cast("decimal(22,0)"), (total + 2 * terms).cast("decimal(22,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, scale: int = 1_000_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and the group's most overused terms."""
    kept = cut_lineage(kept_counts(docs, min_docs))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    language = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = cut_lineage(language.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total")))
    stats = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "present", "terms", "lang_total"])
    n, zero = F.col("n"), F.lit(0).cast("long")
    absent = F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"), scale)).otherwise(1)
    stats = cut_lineage(stats.withColumn("absent", absent))  # one row per group
    shares = cut_lineage(kept.join(stats.select("lang", "source", "total", "terms", "absent"), ["lang", "source"]).select(
        "lang", "source", "term", "n", share(n, F.col("total"), F.col("terms"), scale).alias("p"), "absent"))

    # pairs of sources a < b of a language
    a, b = (stats.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "absent", "present")), "terms") for x in "ab")
    none = distance(F.col("absent_a"), F.col("absent_b"))
    both = cut_lineage(a.join(b.drop("terms"), "lang").where("source_a < source_b"))
    counted = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("number"))
    one = []
    for x, y in ("ab", "ba"):  # terms of x, as if y lacked them all
        own = both.join(counted.select("lang", F.col("source").alias(f"source_{x}"), "p", "number"), ["lang", f"source_{x}"])
        one.append(own.select("lang", "source_a", "source_b", ((distance(F.col("p"), F.col(f"absent_{y}")) - none) * F.col("number")).alias("value")))
    left, right = (shares.select("lang", "term", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "absent"))) for x in "ab")
    p, q, p0, q0 = (F.col(c) for c in ("p_a", "p_b", "absent_a", "absent_b"))
    shared = left.join(right, ["lang", "term"]).where("source_a < source_b").select(
        "lang", "source_a", "source_b", (distance(p, q) - distance(p, q0) - distance(p0, q) + none).alias("value"))
    parts = both.select("lang", "source_a", "source_b", (none * F.col("terms")).alias("value")).union(one[0]).union(one[1]).union(
        shared.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")))
    pairs = cut_lineage(parts.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")))
    by_value = [F.col("value").desc(), F.col("item")]
    pair = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value").union(
        pairs.select("lang", F.col("source_b").alias("source"), F.lit("pair").alias("part"), F.col("source_a").alias("item"), "value"))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))

    # terms that a group has more often than its language
    usual = language.join(langs, "lang").select("lang", "term", share(n, F.col("lang_total"), F.col("terms"), scale).alias("q"))
    over = shares.join(usual, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    term = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).where(F.col("rank") <= top)
    return pair.union(term)
