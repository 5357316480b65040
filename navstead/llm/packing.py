"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made over a histogram of piece lengths, never over documents: best-fit places
whole groups of equal pieces into whole groups of equal gaps, so its work and its size depend
on the capacity alone.  Pieces then find their planned slot by a join on rank within length.

Defined cases: a null or empty text is the end token alone; a null doc_id packs like any other;
repeated rows are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, lo long, hi long, first_sequence long, per_sequence long, first_offset long"


@functools.lru_cache(maxsize=2)
def byte_level_encoder(path: str):
    """A byte-level BPE vocabulary file of the tokenizers library, loaded into the faster encoder.

    Both libraries give the same ids, which the tests compare.  Special tokens in a text are
    recognised, as the file's own library does.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(encoder, text: str | None, end_id: int) -> np.ndarray:
    """Little-endian unsigned ids of one text, closed by the end token."""
    ids = encoder.encode(text, allowed_special="all") if text and "<|" in text else encoder.encode_to_numpy(text) if text else ()
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = end_id
    return out


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: only documents over the capacity are cut, and their first piece takes the remainder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc = token_ids(encoder, text.as_py(), end_id), doc.as_py()
                begin, end, piece = 0, (len(ids) - 1) % capacity + 1, 0
                while begin < len(ids):
                    rows.append((doc, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                    begin, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``counts[length]`` pieces: (length, rank from, rank to, first sequence, pieces per sequence, offset).

    Longest first; each length goes to the tightest gap that holds it.  A sequence that takes one
    piece of a length is then the tightest for the next, so it takes as many as fit, and all
    sequences of one gap are filled alike.
    """
    gaps: list[int] = []  # sorted gap sizes that have sequences
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    plan, used = [], 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in open_at:
                bisect.insort(gaps, gap)
            open_at.setdefault(gap, []).append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap]
                    gaps.pop(at)
            else:
                gap, first, number = capacity, used, -(-left // (capacity // length))
                used += number
            each = gap // length
            full = min(number, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - gap))
                leave(gap - each * length, first, full)
                rank, left, first, number = rank + full * each, left - full * each, first + full, number - full
            if left and number:  # fewer pieces than one sequence takes
                plan.append((length, rank, rank + left, first, left, capacity - gap))
                leave(gap - left * length, first, 1)
                first, number, left = first + 1, number - 1, 0
            leave(gap, first, number)
    return plan


def ranked_in_length(pieces: DataFrame, rows_per_salt: int = 20_000, least_salts: int = 256) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with a gapless ``rank`` from 0 within their length, and the count of each length.

    One length may hold most pieces, so ranks are counted inside (length, salt) and shifted by the
    counts of the salts before; the number of salts follows the number of pieces.
    """
    salts = max(least_salts, pieces.count() // rows_per_salt)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = cut_lineage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("place", F.row_number().over(inside)).join(shifts, ["length", "salt"])
    return ranked.select(*pieces.columns, (F.col("shift") + F.col("place") - 1).alias("rank")), counts


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with the sequence it goes to and its offset there."""
    spark = docs.sparkSession
    pieces = cut_lineage(tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    ranked, counts = ranked_in_length(pieces)
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), PLAN)  # bounded by the capacity, whatever the input
    slots = F.broadcast(plan.withColumnRenamed("length", "_length"))
    here = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    return ranked.join(slots, here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )
