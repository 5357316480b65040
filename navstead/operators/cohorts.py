"""Cohort lists kept once.

A row that names its whole cohort makes a table that grows with the square of the cohort.  Here a
row carries the id of its cohort, and members stand once in a table of their own.  The id follows
from the members alone, in any order: their number and two sums of 64-bit hashes, so it is built by
partial aggregation, no task holds a cohort, and equal cohorts of different runs meet under one id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def _marks(code: Column) -> tuple[Column, Column]:
    return F.xxhash64(code).cast("decimal(20,0)"), F.xxhash64(F.lit(1), code).cast("decimal(20,0)")


def _id(n: Column, first: Column, second: Column) -> Column:
    return F.md5(F.concat_ws(":", n.cast("string"), first.cast(WIDE).cast("string"), second.cast(WIDE).cast("string")).cast("binary"))


def id_of_codes(codes: Column | str) -> Column:
    """Id of a list of distinct codes; NULL of no list."""
    codes = F.col(codes) if isinstance(codes, str) else codes

    def total(which: int) -> Column:
        return F.aggregate(codes, F.lit(0).cast(WIDE), lambda s, c: (s + _marks(c)[which]).cast(WIDE))

    return F.when(codes.isNotNull(), _id(F.size(codes), total(0), total(1)))


def cohort_ids(members: DataFrame, keys: Sequence[str], code: str = "fund_id") -> DataFrame:
    """(keys, cohort_id) of cohorts given as one row per distinct member."""
    first, second = _marks(F.col(code))
    sums = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(first).alias("_a"), F.sum(second).alias("_b"))
    return sums.select(*keys, _id(F.col("_n"), F.col("_a"), F.col("_b")).alias("cohort_id"))


def with_codes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with ``cohort_codes`` in place of (cohort_id, cohort_added): the form of the exchanged file, not of the store."""
    lists = members.select("cohort_id", "fund_id").distinct().groupBy("cohort_id").agg(F.array_sort(F.collect_list("fund_id")).alias("_codes"))
    joined = rows.join(lists, "cohort_id", "left")
    own = F.when(F.col("cohort_added").isNull(), F.col("_codes")).otherwise(F.array_sort(F.array_append("_codes", F.col("cohort_added"))))
    return joined.select(*[c for c in rows.columns if c not in ("cohort_id", "cohort_added")], own.alias("cohort_codes"))
