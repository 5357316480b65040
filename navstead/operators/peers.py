"""Peer groups, leave-one-out composites, sector composites and benchmark resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import growth_rate, safe_divide, years_between
from ..functions.ranking import loo_median
from ..functions.text import lookup
from .series import read_offsets

SALTS = 32


def with_group_key(manifest: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """``gkey`` and ``group_kind`` per fund.

    Category, or sector when at least three funds share it, or one pooled thematic group.
    ``pinned`` fixes which sectors are large enough (the manifest without candidates).
    """
    thematic = F.col("category") == K.SECTOR_KEYED
    basis = manifest if pinned is None else pinned
    small = (
        basis.where(thematic & F.col("sector").isNotNull()).groupBy("sector")
        .agg(F.count(F.lit(1)).alias("_sector_n")).where(F.col("_sector_n") < K.SMALL_SECTOR_BELOW)
    )
    joined = manifest.join(small, "sector", "left")
    kind = (
        F.when(~thematic, "category").when(F.col("_sector_n").isNotNull(), "pooled_thematic").otherwise("sector")
    )
    return joined.withColumn("group_kind", kind).withColumn(
        "gkey",
        F.when(F.col("group_kind") == "category", F.concat(F.lit("category|"), "category"))
        .when(F.col("group_kind") == "sector", F.concat(F.lit("sector|"), F.coalesce("sector", F.lit("?"))))
        .otherwise("pooled_thematic"),
    ).select(*manifest.columns, "group_kind", "gkey")


def peer_quality(kind: Column | str) -> Column:
    return lookup(kind, {"category": "peer_category", "sector": "peer_sector", "pooled_thematic": "pooled_fallback"})


def group_day_totals(returns: DataFrame, members: DataFrame, group: str = "gkey") -> DataFrame:
    """Sum and count of member returns per group and date; partial sums leave each task first."""
    return returns.join(members.select("fund_id", group), "fund_id").groupBy(group, "dt").agg(
        F.sum("r").alias("total"), F.count("r").alias("n"))


def peer_days(returns: DataFrame, members: DataFrame) -> DataFrame:
    """(fund_id, dt, total, n, is_ref) on every date of the fund's group, printed or not.

    Only reference members (``is_ref``, all of them by default) enter the totals.  A group may
    hold a third of all funds, so members carry a salt and the small day totals are repeated
    once per salt.
    """
    if "is_ref" not in members.columns:
        members = members.withColumn("is_ref", F.lit(True))
    totals = group_day_totals(returns, members.where("is_ref")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.select("fund_id", "gkey", "is_ref").withColumn(
        "_salt", F.pmod(F.xxhash64("fund_id"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, ["gkey", "_salt"]).select("fund_id", "dt", "total", "n", "is_ref")


def loo_return(total: Column, n: Column, own: Column) -> Column:
    """Mean return of the peers without the fund itself, from two peers up."""
    peers = n - own.isNotNull().cast("int")
    return F.when(peers >= K.MIN_LOO_PEERS, (total - F.coalesce(own, F.lit(0.0))) / peers)


def loo_composite(returns: DataFrame, members: DataFrame) -> DataFrame:
    """Daily peer return of every fund (its own return left out) beside its own return."""
    grid = peer_days(returns, members).join(returns.select("fund_id", "dt", "r"), ["fund_id", "dt"], "left")
    own = F.when(F.col("is_ref"), F.col("r"))
    return grid.withColumn("peer_r", loo_return(F.col("total"), F.col("n"), own)).where(
        F.col("peer_r").isNotNull()).select("fund_id", "dt", "r", "peer_r")


def sector_composites(returns: DataFrame, manifest: DataFrame) -> DataFrame:
    """(series, dt, r): mean member return per sector, and over all sector-keyed funds as ``*``."""
    themed = manifest.where(F.col("category") == K.SECTOR_KEYED)
    names = themed.select("fund_id", F.explode(F.array_compact(F.array("sector", F.lit("*")))).alias("series"))
    return group_day_totals(returns, names, "series").select("series", "dt", safe_divide("total", "n").alias("r"))


def benchmark_name(category: Column | str, sector: Column | str) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    return F.when(c == K.SECTOR_KEYED, lookup(sector, K.SECTOR_BENCHMARKS)).otherwise(lookup(c, K.CATEGORY_BENCHMARKS))


def forward_returns(
    series: DataFrame, pairs: DataFrame, key: str, value: str, months: int = 12 * K.FORWARD_YEARS,
    min_years: float = K.MIN_FORWARD_YEARS, out: str = "r_fwd",
) -> DataFrame:
    """Annualised return from each anchor to the anchor plus ``months``; unmeasurable pairs drop."""
    ends = read_offsets(series, pairs, key, "anchor",
                        {"d0": F.col("anchor"), "d1": F.add_months("anchor", months)}, [value])
    span = years_between(F.col("d1.dt"), F.col("d0.dt"))
    ratio = safe_divide(F.col(f"d1.{value}"), F.col(f"d0.{value}"))
    ok = (F.col(f"d0.{value}") > 0) & (span >= min_years)
    return ends.select(key, "anchor", F.when(ok, growth_rate(ratio, span)).alias(out)).where(F.col(out).isNotNull())


def real_index_forward(bench: DataFrame, meta: DataFrame, anchors: DataFrame, names: DataFrame, months: int = 12 * K.FORWARD_YEARS,
                       min_years: float = K.MIN_FORWARD_YEARS) -> DataFrame:
    """(name, anchor, bench_fwd, bench_source) for indices that have a usable series."""
    usable = meta.where((F.col("source") != "NONE") & F.col("return_type").isin("fund_NAV", "PRI"))
    pairs = names.join(usable.select("name"), "name", "left_semi").select("name", "anchor").distinct()
    fwd = forward_returns(bench.join(usable.select("name"), "name", "left_semi"), pairs, "name", "level", months, min_years, "_r")
    price_only = F.col("return_type") == "PRI"
    return fwd.join(usable, "name").select(
        "name", "anchor",
        F.when(price_only, F.col("_r") + K.DIVIDEND_ADDBACK).otherwise(F.col("_r")).alias("bench_fwd"),
        F.when(price_only, "adj_pri").otherwise("fund_nav").alias("bench_source"),
    )


def peer_median(fwd: DataFrame) -> DataFrame:
    """Rows of (fund_id, anchor, gkey, r_fwd) with the median and number of the other peers."""
    medians = loo_median(fwd, ["gkey", "anchor"], "r_fwd", "peer_fwd", K.MIN_LOO_PEERS)
    return fwd.join(medians, ["gkey", "anchor", "r_fwd"], "left")


def benchmark_levels(names: DataFrame, bench: DataFrame, meta: DataFrame, start: Column) -> DataFrame:
    """(fund_id, dt, level) of each fund's index from ``start`` on; unmapped or absent gives no rows."""
    usable = bench.where(F.col("dt") >= start).join(meta.where(F.col("source") != "NONE").select("name"), "name", "left_semi")
    return names.select("fund_id", "name").join(usable, "name").select("fund_id", "dt", "level")
