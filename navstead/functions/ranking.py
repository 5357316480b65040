"""Exact order statistics inside groups of any size.

A window ordered inside a group would put a whole group into one task, and one peer group,
one anchor or one feature may hold a large share of all rows.  Everything here therefore
works on *cells*: equal values of a group are first counted together (partial aggregation),
and a cell holds the values that agree in their leading binary digits.  Counts per cell are a
mergeable summary of the group's quantiles, with a relative error below 2^-DIGITS whatever
the magnitude or spread of the values, and they cut the group: a window runs inside a cell, a
second one over the cells' totals, and an equi join adds the two, which makes the result exact.
More rows meet more cells, and a group has at most 2^DIGITS of them per doubling of the value.
The cut is a pure function of the value, so a recomputed task lands in the same cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

DIGITS = 12
_ALL = "_all"
_LARGEST = 1.7976931348623157e308  # fixed value: the largest finite double
_OCTAVES = 1100  # more than the doublings below one


def cell_of(value: Column, digits: int = DIGITS) -> Column:
    """Sign, exponent and the first ``digits`` binary digits of a number, as one increasing integer.

    The exponent comes from a logarithm that may be off at a power of two; the digits then run to
    -1 or 2^digits, which is the neighbouring cell all the same.
    """
    size = F.least(F.abs(value.cast("double")), F.lit(_LARGEST))
    exponent = F.floor(F.log2(size))
    digit = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * float(2**digits))
    cell = (exponent + _OCTAVES) * 2**digits + digit + 1
    return F.when(size > 0, F.when(value > 0, cell).otherwise(-cell)).otherwise(F.lit(0)).cast("bigint")


def cumulative_counts(
    rows: DataFrame, keys: Sequence[str], value: str, tallies: dict[str, Column] | None = None, digits: int = DIGITS,
) -> DataFrame:
    """Per distinct value of each group: ``cnt``, ``below`` (rows with a smaller value) and
    ``n`` (rows in the group), and the same three for every extra tally ``t`` as ``t``,
    ``below_t`` and ``total_t``."""
    extra = tallies or {}
    keys = list(keys)
    if not keys:
        rows, keys = rows.withColumn(_ALL, F.lit(1)), [_ALL]
    counted = (
        rows.where(F.col(value).isNotNull()).groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("cnt"), *[c.alias(name) for name, c in extra.items()])
        .withColumn("_cell", cell_of(F.col(value), digits))
    )
    names = ["cnt", *extra]
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = counted.select(
        *keys, "_cell", value, *names,
        *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"_in_{t}") for t in names],
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy(*keys, "_cell").agg(*[F.sum(t).alias(t) for t in names])
        .select(
            *keys, "_cell",
            *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"_before_{t}") for t in names],
            *[F.sum(t).over(group).alias(f"_total_{t}") for t in names],
        )
    )
    out = local.join(offsets, [*keys, "_cell"])
    shown = [k for k in keys if k != _ALL]
    return out.select(
        *shown, value, *names,
        (F.col("_in_cnt") + F.col("_before_cnt")).alias("below"), F.col("_total_cnt").alias("n"),
        *[(F.col(f"_in_{t}") + F.col(f"_before_{t}")).alias(f"below_{t}") for t in extra],
        *[F.col(f"_total_{t}").alias(f"total_{t}") for t in extra],
    )


def average_rank(below: Column, cnt: Column) -> Column:
    return below + (cnt + F.lit(1)) / F.lit(2.0)


def with_percentile_rank(
    rows: DataFrame, keys: Sequence[str], value: str, out: str, ascending: bool = True,
    min_count: int = 1, missing: float | None = None, **cut,
) -> DataFrame:
    """Average-tie rank over the non-null count of the group, in (0, 1]."""
    table = cumulative_counts(rows, keys, value, **cut)
    low = F.col("below") if ascending else F.col("n") - F.col("below") - F.col("cnt")
    pct = F.when(F.col("n") >= min_count, average_rank(low, F.col("cnt")) / F.col("n"))
    ranked = table.select(*keys, value, pct.alias(out))
    joined = rows.join(ranked, [*keys, value], "left")
    filled = F.coalesce(F.col(out), F.lit(missing).cast("double"))
    return joined.select(*[F.col(c) for c in rows.columns if c != out], filled.alias(out))


def group_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], **cut
) -> DataFrame:
    """Linear-interpolation quantiles per group, plus the non-null count ``n``."""
    table = cumulative_counts(rows, keys, value, **cut)

    def at(position: Column) -> Column:
        hit = (F.col("below") <= position) & (position < F.col("below") + F.col("cnt"))
        return F.max(F.when(hit, F.col(value)))

    aggs = [F.max("n").alias("n")]
    for name, p in probs.items():
        spot = (F.col("n") - 1) * F.lit(p)
        aggs += [at(F.floor(spot)).alias(f"_lo_{name}"), at(F.ceil(spot)).alias(f"_hi_{name}")]
    picked = table.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys, "n",
        *[
            (F.col(f"_lo_{name}")
             + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
             * ((F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p)))).alias(name)
            for name, p in probs.items()
        ],
    )


def group_quantile_with_one_more(rows: DataFrame, keys: Sequence[str], value: str, p: float, out: str, **cut) -> DataFrame:
    """Per group: the count ``n``, the quantile ``out``, and ``out_more``, from which ``one_more`` reads the quantile with another value added."""
    table = cumulative_counts(rows, keys, value, **cut)
    n = F.col("n")

    def at(position: Column) -> Column:
        hit = (F.col("below") <= position) & (position < F.col("below") + F.col("cnt"))
        return F.max(F.when(hit, F.col(value)))

    own, more = (n - 1) * F.lit(p), n * F.lit(p)
    picked = table.groupBy(*keys).agg(
        F.max("n").alias("n"), at(F.floor(own)).alias("_lo"), at(F.ceil(own)).alias("_hi"),
        *[at(spot(more) + shift).alias(f"_{name}{shift + 1}") for name, spot in (("lo", F.floor), ("hi", F.ceil)) for shift in (-1, 0)])
    share = own - F.floor(own)
    quantile = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share
    around = F.struct(F.col("_lo0").alias("lo0"), F.col("_lo1").alias("lo1"), F.col("_hi0").alias("hi0"), F.col("_hi1").alias("hi1"), (more - F.floor(more)).alias("share"))
    return picked.select(*keys, "n", quantile.alias(out), around.alias(f"{out}_more"))


def one_more(around: Column, value: Column) -> Column:
    """Quantile of a group and one value more: that value moves the later ones up by one, so each place holds it or a neighbour."""

    def place(low: Column, high: Column) -> Column:
        return F.greatest(low, F.least(value, high))  # a missing end is no bound

    low, high = place(around["lo0"], around["lo1"]), place(around["hi0"], around["hi1"])
    return F.when(value.isNotNull(), low + (high - low) * around["share"])


def loo_median(
    rows: DataFrame, keys: Sequence[str], value: str, out: str, min_peers: int = 2, **cut
) -> DataFrame:
    """Median of the other rows of the group, per distinct value, with ``<out>_n`` peers.

    Removing one element of a sorted list shifts the later ones down by one, so the median of
    the rest is read from three middle order statistics.  Equal values are interchangeable,
    so one answer per (group, value) is enough.
    """
    table = cumulative_counts(rows, keys, value, **cut)
    half = F.floor(F.col("n") / 2)

    def middle(shift: int) -> Column:
        spot = half - 1 + F.lit(shift)
        hit = (F.col("below") <= spot) & (spot < F.col("below") + F.col("cnt"))
        return F.max(F.when(hit, F.col(value))).alias(f"_a{shift}")

    centre = table.groupBy(*keys).agg(middle(0), middle(1), middle(2))
    own, n = F.col("below") + 1, F.col("n")
    h = F.floor(n / 2)
    first = F.when(own > h, F.col("_a0")).otherwise(F.col("_a1"))
    second = F.when(own > h + 1, F.col("_a1")).otherwise(F.col("_a2"))
    median = F.when(n % 2 == 0, first).otherwise((first + second) / 2)
    return table.join(centre, list(keys)).select(
        *keys, value, F.when(n - 1 >= min_peers, median).alias(out), (n - 1).alias(f"{out}_n")
    )


def auc(rows: DataFrame, keys: Sequence[str], score: str, label: str, out: str = "auc", **cut) -> DataFrame:
    """Mann-Whitney AUC with averaged ties; NULL where only one class is present."""
    y = F.col(label).cast("int")
    table = cumulative_counts(
        rows.where(F.col(label).isNotNull()), keys, score,
        {"pos": F.sum(y), "neg": F.sum(F.lit(1) - y)}, **cut,
    )
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / F.lit(2.0)))
    pairs = F.max("total_pos") * F.max("total_neg")
    return table.groupBy(*keys).agg(F.when(pairs > 0, wins / F.when(pairs > 0, pairs)).alias(out))


def with_average_ranks(rows: DataFrame, keys: Sequence[str], value: str, out: str, **cut) -> DataFrame:
    table = cumulative_counts(rows, keys, value, **cut)
    ranks = table.select(*keys, value, average_rank(F.col("below"), F.col("cnt")).alias(out))
    return rows.join(ranks, [*keys, value], "left")


def spearman(rows: DataFrame, x: str, y: str, out: str = "spearman", **cut) -> DataFrame:
    """Correlation of average ranks over all rows: one row with ``out`` and ``n``."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = with_average_ranks(with_average_ranks(both, [], x, "_rx", **cut), [], y, "_ry", **cut)
    varied = (F.stddev_samp("_rx") > 0) & (F.stddev_samp("_ry") > 0)
    return ranked.agg(F.when(varied, F.corr("_rx", "_ry")).alias(out), F.count(F.lit(1)).alias("n"))


def tie_cell_of(rows: DataFrame, tie: str, digits: int = DIGITS) -> Column:
    """A non-decreasing cell of the ``tie`` key: its distance from the least one.

    A text counts by the seven bytes after what all rows share.  The least and the greatest text of all
    rows are one scalar subquery; what they share, all share.
    """
    if isinstance(rows.schema[tie].dataType, NumericType):
        return cell_of(F.col(tie) - rows.agg(F.min(tie)).scalar(), digits)
    octets = 7

    def number(text: Column, shared: Column) -> Column:
        rest = F.substring(F.encode(F.substring(text, shared + 1, F.lit(octets)), "utf-8"), 1, octets)
        return F.conv(F.rpad(F.hex(rest), 2 * octets, "0"), 16, 10).cast("bigint")

    text = F.col(tie).cast("string")
    low, high = F.col("low"), F.col("high")
    alike = F.filter(F.sequence(F.lit(0), F.length(low)), lambda i: (i > 0) & (F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i)))
    ends = rows.agg(F.min(text).alias("low"), F.max(text).alias("high")).withColumn("shared", F.size(alike))
    start = ends.agg(F.any_value(F.struct("shared", number(low, F.col("shared")).alias("number")))).scalar()
    return cell_of(F.coalesce(number(text, start["shared"]) - start["number"], F.lit(-1)), digits)


def with_position(
    rows: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, size: str, digits: int = DIGITS,
) -> DataFrame:
    """Position 1..n by value descending, then ``tie`` ascending, and the group size.

    Positions come from two levels of counts: rows above the value, from cells of the value, and rows
    of the same value before the tie, from cells of the tie; a window sorts one cell of one value.  A
    group in which all values are equal is therefore spread like any other.  Missing values come last.
    """
    keys = list(keys)
    held = F.coalesce(F.col(value), F.lit(float("-inf"))).alias("_value")  # no number is below it
    valued = rows.select("*", held, tie_cell_of(rows, tie, digits).alias("_tie_cell"))
    levels = cumulative_counts(valued, keys, "_value", digits=digits)
    above = levels.select(*keys, "_value", (F.col("n") - F.col("below") - F.col("cnt")).alias("_above"), F.col("n").alias(size))
    before = Window.partitionBy(*keys, "_value").orderBy("_tie_cell").rowsBetween(Window.unboundedPreceding, -1)
    ties = valued.groupBy(*keys, "_value", "_tie_cell").agg(F.count(F.lit(1)).alias("_c"))
    ties = ties.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    offsets = ties.join(above, [*keys, "_value"]).select(*keys, "_value", "_tie_cell", (F.col("_above") + F.col("_before")).alias("_offset"), size)
    inside = Window.partitionBy(*keys, "_value", "_tie_cell").orderBy(tie)
    placed = valued.withColumn("_in", F.row_number().over(inside)).join(offsets, [*keys, "_value", "_tie_cell"])
    return placed.withColumn(out, F.col("_in") + F.col("_offset")).drop("_value", "_tie_cell", "_in", "_offset")
