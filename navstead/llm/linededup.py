"""Line deduplication over levelled sorted runs of line hashes.

A run holds one row per line key: 128-bit hash, number of documents, largest doc_id.  A batch of
documents is aggregated by key, anti-joined with the settled keys of the runs (enough documents,
and a keeper that no document of the batch replaces) and what remains is written as a new sorted
run.  When a level has ``fanout`` runs they are merged into one run of the next level, so a key is
rewritten once per level.  The runs stay on disk between batches; later batches reuse them.

Defined cases: a null or empty text is one empty line; a null doc_id counts as one document below
all others; rows that repeat a doc_id are one document for counting and each keeps its own row; an
empty table gives no rows.  Columns of the input stay, except ``n_lines`` and ``n_dropped``, which
are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import TableScope, cut_lineage, drop_folder, shared_folder

BLANK = b" \t\n\v\f\r"
LOWEST = -(2**63)
SLICE = 1024  # texts at a time
KEYS = "doc_id long, hi long, lo long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line's key, or None if the key is too short; ASCII letters lose their case."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document and distinct key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch, ids, found = whole.slice(at, SLICE), [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    lines = (text.as_py() or "").encode().split(b"\n")
                    keys = {k for line in lines if (k := line_key(line, min_chars)) is not None}
                    ids += [doc] * len(keys)
                    found += keys
                halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["doc_id", "hi", "lo"])

    chosen = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(scan, KEYS)


class LineRuns:
    """Runs of line hashes by level, kept in a shared folder; ``add`` takes one batch."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int, fanout: int = 2) -> None:
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-{uuid.uuid4().hex}"
        run.sortWithinPartitions("hi", "lo").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def merged(self, paths: list[str]) -> DataFrame:
        """One row per key over some runs; counts add up, since a document is in one batch."""
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def all(self) -> DataFrame:
        return self.merged([p for level in self.levels for p in level])

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (doc_id, hi, lo), whose documents are in no other batch."""
        fresh = keys.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        if any(self.levels):
            settled = self.all().where(F.col("n_docs") >= self.min_docs).select("hi", "lo", F.col("keeper").alias("kept"))
            here = (F.col("f.hi") == F.col("s.hi")) & (F.col("f.lo") == F.col("s.lo")) & (F.col("kept") > F.col("keeper"))
            fresh = fresh.alias("f").join(settled.alias("s"), here, "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            paths, self.levels[level] = self.levels[level], []
            self._write(self.merged(paths), level + 1)
            for path in paths:  # what the next level holds now
                drop_folder(self.spark, path)
            level += 1


def drop_lines(docs: DataFrame, text_col: str, drops: str, min_chars: int) -> DataFrame:
    """``text_col`` without the lines whose digests ``drops`` lists (halves in turn); adds n_lines and n_dropped, removes ``drops``."""
    kept_fields = [f for f in docs.schema.fields if f.name != drops]
    names = [f.name for f in kept_fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields) + ", n_lines long, n_dropped long"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts, n_lines, n_dropped = [], [], []
                for text, drop in zip(batch.column(text_col), batch.column(drops), strict=True):
                    text, kept, lines = text.as_py() or "", [], []
                    if drop.is_valid:
                        digests = drop.values.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                        gone = {digests[i : i + 16] for i in range(0, len(digests), 16)}
                        lines = text.encode().split(b"\n")
                        kept = [line for line in lines if line_key(line, min_chars) not in gone]
                        text = b"\n".join(kept).decode()
                    n_lines.append(len(lines) if lines else text.count("\n") + 1)
                    n_dropped.append(len(lines) - len(kept))
                    texts.append(text)
                columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return docs.mapInArrow(strip, schema)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without lines that ``min_docs`` documents share; the largest doc_id keeps them.

    The batches are ranges of doc_id, highest first: later batches then find most shared keys settled.
    """
    spark = docs.sparkSession
    keys = cut_lineage(line_keys(docs, min_chars, id_col, text_col))
    ends = keys.agg(F.min(F.nullif("doc_id", F.lit(LOWEST))).alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).first()
    low, high = (ends.a or 0, ends.b or 0) if ends.n else (0, 0)
    if docs.select(id_col).count() > docs.select(id_col).distinct().count():
        keys = cut_lineage(keys.distinct())  # rows that repeat a doc_id are one document
    runs = LineRuns(spark, TableScope.note(f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"), min_docs)
    cuts = [low + (high - low + 1) * i // batches for i in range(1, batches)]
    for i in reversed(range(batches)):
        batch = keys if i == 0 else keys.where(F.col("doc_id") >= cuts[i - 1])
        runs.add(batch if i == batches - 1 else batch.where(F.col("doc_id") < cuts[i]))
    shared = runs.all().where(F.col("n_docs") >= min_docs)
    dropped = (
        keys.join(shared.hint("shuffle_hash"), ["hi", "lo"]).where(F.col("doc_id") < F.col("keeper"))
        .select("doc_id", F.array("hi", "lo").alias("key")).groupBy("doc_id").agg(F.flatten(F.collect_list("key")).alias("_drops"))  # at most a document's own lines
    )
    plain = docs.drop("n_lines", "n_dropped")
    joined = plain.withColumn("_at", F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))).join(dropped.withColumnRenamed("doc_id", "_at").hint("shuffle_hash"), "_at", "left")  # texts stream by: no sort
    return drop_lines(joined.select(*[F.col(f"`{c}`") for c in plain.columns], "_drops"), text_col, "_drops", min_chars)
