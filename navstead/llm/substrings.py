"""Repeated passages across documents, by content-defined chunks of a gear rolling hash.

A chunk ends where the rolling hash of the last 16 bytes is the strict maximum among ``reach`` places on
either side.  So ends depend on nearby bytes alone, lie more than ``reach`` apart, and an insertion shifts
no chunk beyond its neighbourhood.  A stretch without such a place is cut every ``longest`` bytes.
Chunks of one digest in two or more documents are repeated; adjoining ones form a span, and spans of
fewer than ``least_chars`` code points are left alone.  The smallest doc_id keeps a repeated chunk.

Defined cases: null or empty text has no chunks; a null doc_id takes no part; rows that repeat a doc_id
are one document, whose spans are those of all its rows; repeats inside one document are not reported;
an empty table gives no rows; other columns are ignored by the report and kept by the removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WINDOW = 16
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
CHUNKS = "doc_id long, start long, end long, hi long, lo long"


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last WINDOW bytes at each place: sums double their reach in each step."""
    h, reach = GEAR[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def strict_maxima(h: np.ndarray, reach: int) -> np.ndarray:
    """Places whose value exceeds all others within ``reach``."""
    if not len(h):
        return np.empty(0, np.int64)
    padded = np.concatenate([np.zeros(reach, h.dtype), h, np.zeros(reach, h.dtype)])
    best, width = padded, 1  # maximum of `width` places from each on
    while 2 * width <= reach:
        best = np.maximum(best[:-width], best[width:])
        width *= 2
    best = np.maximum(best[: len(best) - (reach - width)], best[reach - width :]) if reach > width else best
    n = len(h)
    return np.flatnonzero((h > best[:n]) & (h > best[reach + 1 : reach + 1 + n]))


def chunk_ends(data: np.ndarray, reach: int, longest: int) -> np.ndarray:
    """Ends (exclusive) of the chunks of one text; no character is cut."""
    ends = strict_maxima(rolling_hash(data), reach) + 1
    ends = ends[ends < len(data)]
    ends = np.r_[ends[data[ends] & 0xC0 != 0x80], len(data)]
    gaps = np.diff(ends, prepend=0)
    if (gaps > longest).any():
        extra = []
        for end, gap in zip(ends[gaps > longest].tolist(), gaps[gaps > longest].tolist(), strict=True):
            for cut in range(end - gap + longest, end, longest):
                while data[cut] & 0xC0 == 0x80:
                    cut -= 1
                extra.append(cut)
        ends = np.union1d(ends, extra).astype(np.int64)
    return ends


def chunks(docs: DataFrame, reach: int, longest: int) -> DataFrame:
    """(doc_id, start, end, hi, lo) per chunk; places in code points, digest in two halves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids, starts, stops, digests = [], [], [], []
                for doc, text in zip(batch.column(0).slice(a, 256), batch.column(1).slice(a, 256), strict=True):
                    raw = (text.as_py() or "").encode()
                    if not raw:
                        continue
                    data = np.frombuffer(raw, np.uint8)
                    ends = chunk_ends(data, reach, longest)
                    chars = np.cumsum(data & 0xC0 != 0x80)[ends - 1]
                    begins = [0, *ends[:-1].tolist()]
                    digests += [xxhash.xxh3_128_digest(raw[b:e]) for b, e in zip(begins, ends.tolist(), strict=True)]
                    ids.append(np.full(len(ends), doc.as_py()))
                    starts.append(np.r_[0, chars[:-1]])
                    stops.append(chars)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                flat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (ids, starts, stops)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*flat, halves[:, 0].copy(), halves[:, 1].copy())], names=["doc_id", "start", "end", "hi", "lo"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(cut, CHUNKS)


def repeated_spans(docs: DataFrame, least_chars: int = 100, reach: int = 24, longest: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_chunks, first_doc_id, removable) of every span that other documents repeat.

    ``first_doc_id`` is the smallest document that holds one of the span's chunks; ``removable`` lists
    the parts (start, end) that a smaller doc_id keeps.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = chunks(texts, reach, longest)  # cut twice rather than stored: the digests would take as much room as the texts
    shared = every.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hi", "lo", "first")
    hits = cut_lineage(every.join(shared, ["hi", "lo"]).select("doc_id", "start", "end", "first"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("new", F.coalesce(F.col("start") > upto, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.when(F.col("first") < F.col("doc_id"), F.struct("start", "end"))
    spans = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.min("first").alias("first_doc_id"), F.sort_array(F.collect_list(later)).alias("removable"),
    )
    return spans.where(F.col("end") - F.col("start") >= least_chars).drop("run")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Documents without the repeated parts that a smaller doc_id keeps."""
    parts = repeated_spans(docs, id_col=id_col, text_col=text_col, **settings)
    gone = parts.select("doc_id", F.explode("removable").alias("r")).groupBy("doc_id").agg(F.sort_array(F.collect_set("r")).alias("_gone"))
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    rows = docs.withColumnsRenamed(names).withColumn("_at", F.col(names[id_col]).cast("long")).join(gone.withColumnRenamed("doc_id", "_at"), "_at", "left")
    text = F.col(names[text_col])
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.substr(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), F.length(text)))
    left = F.when(F.col("_gone").isNotNull(), F.aggregate("_gone", first, step, rest)).otherwise(text)
    return rows.select(*[(left if c == text_col else F.col(i)).alias(c) for c, i in names.items()])
