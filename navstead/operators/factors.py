"""Weighted percentile composites and peer ranks."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import safe_divide
from ..functions.ranking import cumulative_counts, with_percentile_rank

LONG_FACTORS = tuple((c, m, w, d) for c, fs in K.FACTOR_MAP.items() for m, (w, d) in fs.items())


def unpivot_metrics(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    present = [n for n in names if n in metrics.columns]
    wide = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in present])
    return wide.unpivot(list(keys), present, "metric", "value")


def category_composite(
    metrics: DataFrame, factors: Sequence[tuple[str, str, float, int]] = LONG_FACTORS
) -> DataFrame:
    """Composite 1..100 and peer rank within each category.

    ``factors`` rows are (category, metric, weight, direction).  A metric that no peer of the
    category has is dropped and the weights are renormalised; a single missing value counts as
    the neutral 0.5.
    """
    spark = metrics.sparkSession
    weights = spark.createDataFrame(list(factors), "category string, metric string, weight double, direction int")
    names = sorted({m for _, m, _, _ in factors})
    long = unpivot_metrics(metrics, ["fund_id", "category"], names)
    used = long.join(weights, ["category", "metric"])
    live = used.groupBy("category", "metric", "weight").agg(F.count("value").alias("_have")).where(F.col("_have") > 0)
    total = live.groupBy("category").agg(*per_metric(names, "weight", "_w"), F.count(F.lit(1)).alias("n_factors"))
    scored = (
        used.join(live.select("category", "metric"), ["category", "metric"], "left_semi")
        .withColumn("_x", F.col("value") * F.col("direction"))
    )
    ranked = with_percentile_rank(scored, ["category", "metric"], "_x", "_pct", missing=0.5)
    raw = (
        ranked.groupBy("category", "fund_id").agg(*per_metric(names, "_pct", "_p"))
        .join(total, "category")
        .select("category", "fund_id", weighted_mean(names).alias("raw"), "n_factors")
    )
    return with_peer_rank(stretch(raw, ["category"]), ["category"])


def per_metric(names: Sequence[str], value: str, prefix: str) -> list[Column]:
    """One column per metric, for a group with at most one row of each."""
    return [F.max(F.when(F.col("metric") == m, F.col(value))).alias(f"{prefix}_{m}") for m in names]


def weighted_mean(names: Sequence[str]) -> Column:
    """Mean of ``_p_*`` under ``_w_*``, added in the order of names: the same in every run."""
    zero = F.lit(0.0)
    weight = [F.coalesce(f"_w_{m}", zero) for m in names]
    share = [w * F.coalesce(f"_p_{m}", zero) for m, w in zip(names, weight, strict=True)]
    return F.round(functools.reduce(operator.add, share) / functools.reduce(operator.add, weight), 12)


def stretch(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Min-max within the group onto 1..100, one decimal; a flat group sits in the middle.

    Rounding in two steps keeps a half from falling either way with the last bit.
    """
    edges = raw.groupBy(*keys).agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    spread = safe_divide(F.col("raw") - F.col("_lo"), F.col("_hi") - F.col("_lo"), 0.5)
    return raw.join(edges, list(keys)).withColumn(
        "composite_score", F.round(F.round(F.lit(1.0) + F.lit(99.0) * spread, 9), 1)).drop("_lo", "_hi")


def with_peer_rank(scored: DataFrame, keys: Sequence[str], value: str = "composite_score") -> DataFrame:
    """Rank by score descending; equal scores share the smaller rank."""
    table = cumulative_counts(scored, keys, value)
    ranks = table.select(*keys, value, (F.col("n") - F.col("below") - F.col("cnt") + 1).cast("int").alias("peer_rank"))
    return scored.join(ranks, [*keys, value], "left")


def coverage_by_category(
    metrics: DataFrame, factors: Sequence[tuple[str, str, float, int]] = LONG_FACTORS
) -> DataFrame:
    """Per category: usable factors, all factors, usable weight, and whether it reaches half."""
    spark = metrics.sparkSession
    weights = spark.createDataFrame(list(factors), "category string, metric string, weight double, direction int")
    names = sorted({m for _, m, _, _ in factors})
    have = unpivot_metrics(metrics, ["fund_id", "category"], names).groupBy("category", "metric").agg(
        F.count("value").alias("have"))
    usable = F.coalesce(F.col("have") > 0, F.lit(False))
    present = metrics.select("category").distinct()
    return weights.join(present, "category", "left_semi").join(have, ["category", "metric"], "left").groupBy("category").agg(
        F.count_if(usable).alias("n_usable"), F.count(F.lit(1)).alias("n_factors"),
        F.sum(F.when(usable, F.col("weight")).otherwise(0.0)).alias("weight_sum"),
    ).withColumn("passed", F.col("weight_sum") >= 0.5)


def cohort_composite(panel: DataFrame, weights: dict[str, float], out: str = "factor_score") -> DataFrame:
    """Fixed factor weights on panel features within (anchor, cohort_key)."""
    live = {m: w for m, w in weights.items() if m in K.FACTOR_TO_FEATURE and w > 0}
    if not live:
        raise ValueError("no factor with a positive weight has a feature")
    total = sum(live.values())
    directions = {m: d for m, (_, d) in K.FACTOR_MAP["Equity"].items()}
    spark = panel.sparkSession
    table = spark.createDataFrame(
        [(K.FACTOR_TO_FEATURE[m], w / total, directions[m]) for m, w in live.items()],
        "metric string, weight double, direction int")
    keys = ["fund_id", "anchor", "cohort_key"]
    long = unpivot_metrics(panel, keys, [K.FACTOR_TO_FEATURE[m] for m in live]).join(table, "metric")
    long = long.withColumn("_x", F.col("value") * F.col("direction"))
    ranked = with_percentile_rank(long, ["anchor", "cohort_key", "metric"], "_x", "_pct", missing=0.5)
    names = sorted(K.FACTOR_TO_FEATURE[m] for m in live)
    wide = ranked.groupBy(*keys).agg(*per_metric(names, "_pct", "_p"), *per_metric(names, "weight", "_w"))
    raw = wide.select(*keys, weighted_mean(names).alias("raw"))
    return stretch(raw, ["anchor", "cohort_key"]).withColumnRenamed("composite_score", out).drop("raw")
