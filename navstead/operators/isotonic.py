"""Isotonic fit of a yes/no outcome on a score, as a mergeable summary of pooled blocks.

Pool-adjacent-violators may pool in any order: pooling neighbours that violate the order gives the
same blocks, whether they are rows or already blocks.  So equal scores are counted first, each
range of the score is pooled by its own task, and the blocks of neighbouring ranges are pooled
again, level by level, until one list is left.  Blocks are counts of rows and positives and rates
are compared as fractions of integers, so the result does not depend on how the rows were dealt.
A level hands on blocks, not scores; their number grows with about the cube root of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "part int, lower double, upper double, n long, positives long"
FAN_IN = 16
Block = tuple[float, float, int, int]


def pooled(rows: Iterable[Block], found: list[Block] | None = None) -> list[Block]:
    """Blocks of rising rate from (lower, upper, rows, positives) in rising order; ``found`` is pooled so far."""
    found = [] if found is None else found
    for block in rows:
        while found and found[-1][3] * block[2] >= block[3] * found[-1][2]:
            last = found.pop()
            block = (last[0], block[1], last[2] + block[2], last[3] + block[3])
        found.append(block)
    return found


def as_batch(part: int, blocks: list[Block]) -> pa.RecordBatch:
    columns = list(zip(*blocks, strict=True)) or [(), (), (), ()]
    kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
    arrays = [pa.array([part] * len(blocks), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "lower", "upper", "n", "positives"])


def pool_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool one range, read in order and held as blocks only."""
    found: list[Block] = []
    for batch in batches:
        p, n, positives = (c.to_pylist() for c in batch.columns)
        pooled(zip(p, p, n, positives, strict=True), found)
    yield as_batch(TaskContext.get().partitionId(), found)


def pool_neighbours(table: pa.Table) -> pa.Table:
    """Pool the blocks of neighbouring ranges."""
    ordered = table.sort_by("lower")
    part, *columns = (c.to_pylist() for c in ordered.columns)
    return pa.Table.from_batches([as_batch(part[0], pooled(zip(*columns, strict=True)))])


def isotonic_blocks(scored: DataFrame, p: str, label: str) -> DataFrame:
    """(lower, upper, n, positives) of the blocks of the isotonic fit; rows without a score or an outcome take no part."""
    counted = scored.where(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).cast("boolean")).alias("positives"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = counted.repartitionByRange(parts, "p").sortWithinPartitions("p").mapInArrow(pool_range, BLOCKS)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(pool_neighbours, BLOCKS)
    return blocks.select("lower", "upper", "n", "positives")
