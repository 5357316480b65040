"""Rank and calibration metrics of scored rows, for any number of folds in one pass.

Rows carry anchor, y (boolean), p and grouping keys.  All order statistics use value cells, so
a fold or an anchor that holds most rows is not gathered into one task, not even if all its
scores are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import safe_divide
from ..functions.ranking import auc, with_position


def pooled_auc(rows: DataFrame, keys: Sequence[str], score: str = "p", label: str = "y") -> DataFrame:
    return auc(rows, keys, score, label, "pooled_auc")


def anchor_rank_auc(rows: DataFrame, keys: Sequence[str], score: str = "p", label: str = "y") -> DataFrame:
    """Mean of the AUCs inside each anchor that has both classes, with their number."""
    each = auc(rows, [*keys, "anchor"], score, label, "_auc")
    return each.groupBy(*keys).agg(F.avg("_auc").alias("rank_auc"), F.count("_auc").alias("rank_auc_cohorts"))


def decile_members(rows: DataFrame, keys: Sequence[str], score: str = "p", tie: str = "fund_id") -> DataFrame:
    """Rows in the top or bottom tenth of their anchor: the two ends of one order."""
    placed = with_position(rows, [*keys, "anchor"], score, tie, "_pos", "_size")
    k = F.greatest(F.lit(1), F.floor(F.col("_size") * K.DECILE_SHARE))
    return placed.withColumn("is_top", F.col("_pos") <= k).withColumn("is_bottom", F.col("_pos") > F.col("_size") - k).drop("_pos", "_size")


def decile_stats(rows: DataFrame, keys: Sequence[str], score: str = "p", label: str = "y") -> DataFrame:
    """Top-decile precision and the share of all negatives that the bottom decile holds."""
    d = decile_members(rows, keys, score)
    pos, neg = F.col(label), ~F.col(label)
    return d.groupBy(*keys).agg(
        safe_divide(F.count_if(F.col("is_top") & pos).cast("double"), F.count_if("is_top")).alias("top_decile_precision"),
        safe_divide(F.count_if(F.col("is_bottom") & neg).cast("double"), F.count_if(neg)).alias("bottom_decile_neg_capture"),
        F.count_if("is_top").alias("n_top"), F.count_if("is_bottom").alias("n_bottom"), F.count_if(neg).alias("total_negatives"))


def reliability_table(rows: DataFrame, keys: Sequence[str], score: str = "p", label: str = "y", bins: int = 10) -> DataFrame:
    slot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("frac_pos"))


def block_metrics(rows: DataFrame, keys: Sequence[str], raw: str = "p", calibrated: str | None = "p_cal", label: str = "y") -> DataFrame:
    """All fold metrics, one row per group of ``keys``; calibration terms only with ``calibrated``."""
    y = F.col(label).cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / K.EFFECTIVE_N_DIVISOR).cast("bigint").alias("effective_n"),
        F.avg(y).alias("base_rate"), F.count_if(~F.col(label)).alias("negatives"),
    ]
    if calibrated:
        p = F.col(calibrated)
        aggs += [F.avg(F.when(F.col(label), (p >= 0.5).cast("double"))).alias("recall_at_05"), F.avg((p - y) * (p - y)).alias("brier")]
    base = rows.groupBy(*keys).agg(*aggs)
    k = list(keys)
    out = (
        base.join(pooled_auc(rows, k, raw, label), k, "left").join(anchor_rank_auc(rows, k, raw, label), k, "left")
        .join(decile_stats(rows, k, raw, label).drop("n_top", "n_bottom", "total_negatives"), k, "left")
    )
    return out.withColumn("lift_over_base", safe_divide("top_decile_precision", "base_rate"))


def mean_over_folds(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average of each headline metric over the folds that have it."""
    heads = ("pooled_auc", "rank_auc", "top_decile_precision", "lift_over_base", "bottom_decile_neg_capture")
    return metrics.groupBy(*keys).agg(*[F.avg(h).alias(f"mean_{h}") for h in heads])


def challenger_verdict(means: DataFrame, holdout: DataFrame, champion: str = "enet", challenger: str = "trees") -> DataFrame:
    """Adopt the challenger only for a mean AUC gain above the margin that the holdout does not deny."""

    def side(df: DataFrame, column: str, model: str):
        return F.max(F.when(F.col("model") == model, F.col(column)))

    cv = means.groupBy("target").agg(
        (side(means, "mean_pooled_auc", challenger) - side(means, "mean_pooled_auc", champion)).alias("cv_gain"))
    held = holdout.groupBy("target").agg(
        (side(holdout, "pooled_auc", challenger) - side(holdout, "pooled_auc", champion)).alias("holdout_gain"))
    adopt = (F.col("cv_gain") > K.CHALLENGER_MARGIN) & (F.col("holdout_gain") >= 0)
    return cv.join(held, "target", "left").withColumn("adopt", F.coalesce(adopt, F.lit(False)))


def leg_table(rows: DataFrame, legs: Sequence[str], score: str = "p") -> DataFrame:
    """Mean of each label leg in the top and bottom decile, averaged over anchors."""
    d = decile_members(rows, [], score)
    which = F.explode(F.array_compact(F.array(F.when(F.col("is_top"), F.lit("top")), F.when(F.col("is_bottom"), F.lit("bottom"))))).alias("which")
    each = d.select("anchor", which, *legs).groupBy("anchor", "which").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in legs])
    return each.groupBy("which").agg(*[F.avg(c).alias(c) for c in legs])
