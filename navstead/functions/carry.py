"""Carry-forward over ordered sources that may be far larger than one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(
    rows: DataFrame, source: Sequence[str], segment: str, order: str, columns: Sequence[str]
) -> DataFrame:
    """Last non-null value so far of each column within a source, in segment then row order.

    Segments are pieces of a source (a file split, a run of lines).  The window runs inside a
    segment; the value that enters a segment comes from a window over one row per segment.
    """
    keys = [*source, segment]
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows
    for c in columns:
        local = local.withColumn(f"_l_{c}", F.last(c, ignorenulls=True).over(inside))
    ends = rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(f"_e_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*source).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.select(
        *keys,
        *[F.last(F.col(f"_e_{c}")[c], ignorenulls=True).over(earlier).alias(f"_b_{c}") for c in columns],
    )
    joined = local.join(entering, keys, "left")
    kept = [c for c in rows.columns if c not in columns]
    return joined.select(*kept, *[F.coalesce(f"_l_{c}", f"_b_{c}").alias(c) for c in columns])
