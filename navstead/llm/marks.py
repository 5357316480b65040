"""Membership bitmaps of fixed size: rows that cannot be among given ids need no shuffle.

A text is far larger than its id, and a join of texts with a growing list of ids shuffles all of them.
Ids set bits of a map of ``MARK_BITS`` bits, which every task holds.  A row whose bit is not set is surely
not listed; the others, listed or not, go through an exact join.  No id reaches the driver, and the map
does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK_BITS = 25


def _spot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << MARK_BITS))


def with_mark(rows: DataFrame, listed: DataFrame, column: str = "doc_id", out: str = "_listed") -> DataFrame:
    """Rows with ``out``: false where ``column`` is surely not among ``listed`` (false for NULL)."""
    spot = _spot(column)
    maps = listed.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_bits"))
    held = rows.withColumn("_bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(maps), "_bucket", "left")
    at = F.bitmap_bit_position(spot)
    octet = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(octet / F.pow(F.lit(2), at % 8)) % 2 == 1
    return held.withColumn(out, F.coalesce(bit & F.col(column).isNotNull(), F.lit(False))).select(*rows.columns, out)
