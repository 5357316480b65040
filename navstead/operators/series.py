"""Price-series primitives: returns, as-of reads at many offsets, bounded calendars.

A series is long: (key, dt, value), unique on (key, dt).  That uniqueness bounds every window
partitioned by the key alone by the number of calendar days, however much data there is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ASOF_TOLERANCE_DAYS, MAX_FFILL_ROWS, MIN_SERIES_OBS
from ..functions.numeric import safe_divide


def by_date(key: str = "fund_id") -> Window:
    return Window.partitionBy(key).orderBy("dt")


def with_returns(levels: DataFrame, key: str = "fund_id", value: str = "nav", out: str = "r") -> DataFrame:
    """Simple return over the previous row of the series; NULL on the first."""
    previous = F.lag(value).over(by_date(key))
    return levels.withColumn(out, safe_divide(F.col(value), previous) - 1)


def daily_returns(levels: DataFrame, key: str = "fund_id", value: str = "nav", out: str = "r") -> DataFrame:
    return with_returns(levels, key, value, out).where(F.col(out).isNotNull()).select(key, "dt", out)


def usable_panel(nav: DataFrame, manifest: DataFrame, min_obs: int = MIN_SERIES_OBS) -> DataFrame:
    """Rows of manifest funds that have at least ``min_obs`` observations."""
    listed = nav.join(manifest.select("fund_id"), "fund_id", "left_semi")
    enough = listed.groupBy("fund_id").agg(F.count("nav").alias("_n")).where(F.col("_n") >= min_obs)
    return listed.join(enough, "fund_id", "left_semi")


def asof(
    series: DataFrame, probes: DataFrame, key: str, carry: Sequence[str], at: str,
    tolerance_days: int | None = ASOF_TOLERANCE_DAYS, out: str = "hit",
) -> DataFrame:
    """Last series row on or before each probe date, as struct ``out`` = (dt, *carry).

    Series and probes are unioned and one running window carries the latest row forward, so
    any number of probes costs one shuffle and one sort.
    """
    facts = series.select(key, F.col("dt").alias("_t"), F.lit(0).alias("_kind"),
                          F.struct("dt", *carry).alias("_row"))
    asked = probes.select(key, F.col(at).alias("_t"), F.lit(1).alias("_kind"),
                          F.struct(*probes.columns).alias("_probe"))
    running = Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        facts.unionByName(asked, allowMissingColumns=True)
        .withColumn("_found", F.last("_row", ignorenulls=True).over(running))
        .where(F.col("_kind") == 1)
    )
    hit = F.col("_found")
    if tolerance_days is not None:
        hit = F.when(F.datediff("_t", F.col("_found.dt")) <= tolerance_days, hit)
    return found.select("_probe.*", hit.alias(out))


def read_offsets(
    series: DataFrame, pairs: DataFrame, key: str, anchor: str, offsets: dict[str, Column],
    carry: Sequence[str], tolerance_days: int | None = ASOF_TOLERANCE_DAYS,
) -> DataFrame:
    """One column per named offset date of each (key, anchor): the as-of struct or NULL."""
    stops = F.explode(F.array(*[
        F.struct(F.lit(name).alias("offset"), date.alias("probe_dt")) for name, date in offsets.items()
    ])).alias("_s")
    probes = pairs.select(key, anchor, stops).select(key, anchor, "_s.offset", "_s.probe_dt")
    hits = asof(series, probes, key, carry, "probe_dt", tolerance_days)
    return hits.groupBy(key, anchor).agg(*[
        F.any_value(F.when(F.col("offset") == name, F.col("hit")), ignoreNulls=True).alias(name)
        for name in offsets
    ])


def business_calendar(
    levels: DataFrame, key: str = "fund_id", value: str = "nav", limit: int = MAX_FFILL_ROWS
) -> DataFrame:
    """Monday-to-Friday grid over the whole panel with at most ``limit`` rows carried forward."""
    first = levels.agg(F.min("dt")).scalar()
    last = levels.agg(F.max("dt")).scalar()
    grid = (
        levels.select(key).distinct()
        .withColumn("dt", F.explode(F.sequence(first, last)))
        .where(F.weekday("dt") < 5)
    )
    recent = by_date(key).rowsBetween(-limit, 0)
    return (
        grid.join(levels.select(key, "dt", value), [key, "dt"], "left")
        .withColumn(value, F.last(value, ignorenulls=True).over(recent))
    )


def joined_falls(pieces: DataFrame) -> DataFrame:
    """Disjoint sparse table of falls: (fund_id, level, piece, side) with high, low and fall of a run of pieces.

    At level k pieces lie in blocks of 2^(k+1) with a middle.  ``left`` runs from a piece to the middle
    of its block, ``right`` from the middle to a piece, so any span of pieces is one run of each kind
    side by side, at the level of the highest binary digit in which its ends differ.  Falls do not
    overlap well (a peak must come first), which is why the two runs must be disjoint.
    """
    counted = pieces.withColumn("_last", F.max("piece").over(Window.partitionBy("fund_id")))
    top = F.floor(F.log2(F.col("_last").cast("double") + 0.5)).cast("int")
    levels = counted.withColumn("level", F.explode(F.sequence(F.lit(0), top))).drop("_last")
    block = F.floor(F.col("piece") / F.pow(F.lit(2.0), F.col("level") + 1)).cast("bigint")
    half = F.floor(F.col("piece") / F.pow(F.lit(2.0), "level")).cast("bigint") % 2
    placed = levels.withColumn("block", block).withColumn("side", F.when(half == 0, "left").otherwise("right"))
    outward = Window.partitionBy("fund_id", "level", "block", "side").orderBy(F.when(half == 0, -F.col("piece")).otherwise(F.col("piece")))
    so_far, before = outward.rowsBetween(Window.unboundedPreceding, 0), outward.rowsBetween(Window.unboundedPreceding, -1)
    # a run grows away from the middle: to the left the new piece's high meets the run's low, to the right the other way round
    meets = F.when(F.col("side") == "left", F.min("low").over(before) / F.col("high")).otherwise(F.col("low") / F.max("high").over(before)) - 1
    grown = placed.withColumn("_step", F.least("fall", meets))
    return grown.select("fund_id", "level", "piece", "side", F.max("high").over(so_far).alias("high"), F.min("low").over(so_far).alias("low"),
                        F.min("_step").over(so_far).alias("fall"))


def window_drawdown(nav: DataFrame, pairs: DataFrame, months: int) -> DataFrame:
    """Deepest fall from a running peak over [as-of(anchor − months), anchor] per pair.

    Anchors and window starts cut each series into pieces.  A piece is reduced to (high, low, deepest
    fall); two neighbours combine as min(fallA, fallB, lowB / highA − 1).  Prices are read once, pieces
    are combined once per level, and each pair reads two ready runs by equi join, however many pieces
    its window spans.
    """
    stops = F.explode(F.array(
        F.struct(F.lit("start").alias("edge"), F.add_months("anchor", -months).alias("_t")),
        F.struct(F.lit("end").alias("edge"), F.col("anchor").alias("_t")),
    )).alias("_s")
    edges = pairs.select("fund_id", "anchor", stops).select(
        "fund_id", "anchor", "_s.edge", "_s._t", F.lit(1).alias("_kind"))
    facts = nav.select("fund_id", F.col("dt").alias("_t"), F.lit(0).alias("_kind"), "nav", "dt")
    ordered = Window.partitionBy("fund_id").orderBy("_t", "_kind")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("_kind") == 0) & F.coalesce(F.lag("_kind").over(ordered) == 1, F.lit(True))
    cut = (
        facts.unionByName(edges, allowMissingColumns=True)
        .withColumn("_opens", opens.cast("int"))
        .withColumn("piece", F.sum("_opens").over(running))  # from 1; at an edge, the last piece before it
        .withColumn("at", F.last(F.when(F.col("_kind") == 0, F.struct("dt", "nav")), ignorenulls=True).over(running))
    )
    inside = Window.partitionBy("fund_id", "piece").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        cut.where(F.col("_kind") == 0)
        .withColumn("fall", F.col("nav") / F.max("nav").over(inside) - 1)
        .groupBy("fund_id", "piece")
        .agg(F.max("nav").alias("high"), F.min("nav").alias("low"), F.min("fall").alias("fall"))
    )
    spans = cut.where(F.col("_kind") == 1).groupBy("fund_id", "anchor").agg(
        (F.max(F.when(F.col("edge") == "start", F.col("piece"))) + 1).alias("first"),
        F.max(F.when(F.col("edge") == "end", F.col("piece"))).alias("last"),
        F.any_value(F.when(F.col("edge") == "start", F.col("at")), ignoreNulls=True).alias("start"),
        F.any_value(F.when(F.col("edge") == "end", F.col("at")), ignoreNulls=True).alias("end"),
    )
    covered = F.datediff(F.add_months("anchor", -months), F.col("start.dt")) <= ASOF_TOLERANCE_DAYS
    apart = F.floor(F.log2(F.col("first").bitwiseXOR(F.col("last")).cast("double") + 0.5)).cast("int")
    asked = spans.where(covered).withColumn("level", F.when(F.col("first") < F.col("last"), apart).when(F.col("first") == F.col("last"), 0))
    table = joined_falls(pieces)
    run = F.struct("high", "low", "fall")
    ends = table.groupBy("fund_id", "level", "piece").agg(F.any_value(run).alias("run"))  # a piece has one side in a level
    left = ends.select("fund_id", "level", F.col("piece").alias("first"), F.col("run").alias("a"))
    right = ends.select("fund_id", "level", F.col("piece").alias("last"), F.col("run").alias("b"))
    read = asked.join(left, ["fund_id", "level", "first"], "left").join(right, ["fund_id", "level", "last"], "left")
    opening, two = F.col("start.nav"), F.col("first") < F.col("last")
    peak = F.greatest(opening, "a.high", F.when(two, F.col("b.high")))
    fall = F.least(F.lit(0.0), "a.fall", F.col("a.low") / opening - 1, F.when(two, F.least(F.col("b.fall"), F.col("b.low") / F.greatest(opening, "a.high") - 1)))
    return read.select("fund_id", "anchor", fall.alias("max_dd"), (F.col("end.nav") / peak - 1).alias("current_dd"))
