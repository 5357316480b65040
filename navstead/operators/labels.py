"""Three-year-forward labels: absolute or excess hurdle, and rank within the cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ranking import group_quantiles
from ..session import cut_lineage
from . import peers


def anchor_grid(spark, first: str = K.ANCHOR_GRID[0], last: str = K.ANCHOR_GRID[1]) -> DataFrame:
    """Month-ends from ``first`` to ``last``."""
    months = F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month"),
                        F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("m")).select(F.last_day("m").alias("anchor"))


def build_labels(
    nav: DataFrame, manifest: DataFrame, pairs: DataFrame, bench: DataFrame, bench_meta: DataFrame,
    bench_names: DataFrame | None = None, months: int = 12 * K.FORWARD_YEARS, min_years: float = K.MIN_FORWARD_YEARS,
) -> DataFrame:
    """One row per fund and anchor with a forward return over ``months``, resolved benchmark and OR-label.

    Folds over these labels must purge by the same number of months.
    ``bench_names`` (fund_id, name) overrides the category and sector benchmark table.
    """
    keyed = peers.with_group_key(manifest)
    if bench_names is None:
        keyed = keyed.withColumn("bench_name", peers.benchmark_name("category", "sector"))
    else:
        keyed = keyed.join(bench_names.select("fund_id", F.col("name").alias("bench_name")), "fund_id", "left")
    fwd = cut_lineage(peers.forward_returns(nav, pairs, "fund_id", "nav", months, min_years).join(
        keyed.select("fund_id", "gkey", "group_kind", "bench_name", "scheme_name", "category", "sector"), "fund_id"))
    asked = fwd.select(F.col("bench_name").alias("name"), "anchor").where(F.col("name").isNotNull()).distinct()
    real = peers.real_index_forward(bench, bench_meta, asked, asked, months, min_years).withColumnRenamed("name", "bench_name")
    rows = peers.peer_median(fwd).join(real, ["bench_name", "anchor"], "left")
    has_real, has_peer = F.col("bench_fwd").isNotNull(), F.col("peer_fwd").isNotNull()
    peer_q = F.when(has_peer, peers.peer_quality("group_kind")).otherwise("no_benchmark")
    hybrid = F.coalesce("bench_fwd", "peer_fwd")

    def beats(c):
        return F.coalesce(F.col("r_fwd") - c >= K.EXCESS_HURDLE, F.lit(False))

    out = rows.select(
        "fund_id", "scheme_name", "category", "sector", "anchor", F.year("anchor").alias("anchor_year"), "gkey", "r_fwd",
        (F.col("r_fwd") >= K.ABSOLUTE_HURDLE).alias("cond_b"),
        hybrid.alias("benchmark_fwd"),
        F.when(has_real, F.col("bench_source")).when(has_peer, "peer_proxy").otherwise("none").alias("benchmark_source"),
        F.when(has_real & (F.col("bench_source") == "fund_nav"), "fund_nav")
        .when(has_real, "adj_pri_addback").otherwise(peer_q).alias("benchmark_quality"),
        beats(hybrid).alias("cond_a"),
        F.col("peer_fwd").alias("benchmark_fwd_peer"), peer_q.alias("benchmark_quality_peer"),
        beats(F.col("peer_fwd")).alias("cond_a_peer"),
    )
    return out.withColumn("y", F.col("cond_a") | F.col("cond_b")).withColumn("y_peer", F.col("cond_a_peer") | F.col("cond_b"))


def cohort_statistics(fwd: DataFrame) -> DataFrame:
    """Size, upper quartile and median of the forward return per (anchor, gkey)."""
    return group_quantiles(fwd, ["anchor", "gkey"], "r_fwd", {"q75": 0.75, "med": 0.5}).withColumnRenamed("n", "cohort_n")


def with_cohort_targets(labels: DataFrame, min_size: int = K.COHORT_MIN_SIZE) -> DataFrame:
    """Top-quartile and top-half flags within the cohort; thin cohorts stay NULL."""
    stats = cohort_statistics(labels)
    enough = F.col("cohort_n") >= min_size
    return labels.join(stats, ["anchor", "gkey"]).select(
        *labels.columns, "cohort_n",
        F.when(enough, F.col("r_fwd") >= F.col("q75")).alias("y_cohort_q1"),
        F.when(enough, F.col("r_fwd") > F.col("med")).alias("y_cohort_top_half"),
    )


def rate_table(labels: DataFrame) -> DataFrame:
    """Label rates per anchor year and, as year NULL, overall."""

    def rate(c: str):
        return F.avg(F.col(c).cast("double"))

    return labels.rollup("anchor_year").agg(
        F.count(F.lit(1)).alias("n"), rate("y").alias("y_hybrid"), rate("y_peer").alias("y_peer"),
        rate("cond_a").alias("cond_a_hybrid"), rate("cond_a_peer").alias("cond_a_peer"), rate("cond_b").alias("cond_b"),
        F.count_if(~F.col("y")).alias("negatives_hybrid"), F.count_if(~F.col("y_peer")).alias("negatives_peer"),
    ).withColumn("anchor_year", F.coalesce(F.col("anchor_year").cast("string"), F.lit("OVERALL")))


def source_coverage(labels: DataFrame) -> DataFrame:
    """Count and share of each benchmark source, with absent sources at zero."""
    counts = labels.groupBy("benchmark_source").agg(F.count(F.lit(1)).alias("c"))
    domain = labels.sparkSession.createDataFrame(
        [("fund_nav",), ("adj_pri",), ("peer_proxy",), ("none",)], "benchmark_source string")
    joined = domain.join(counts, "benchmark_source", "left").withColumn("n_samples", F.coalesce("c", F.lit(0)).cast("bigint"))
    total = counts.agg(F.sum("c")).scalar()
    return joined.select("benchmark_source", "n_samples", F.round(F.col("n_samples") / total * 100, 1).alias("pct"))


def target_rates(labels: DataFrame, targets: Sequence[str], holdout: tuple[str, str]) -> DataFrame:
    """Per target: rows, dropped, kept, base rate overall and in the holdout span, negatives."""
    inside = F.col("anchor").between(F.lit(holdout[0]).cast("date"), F.lit(holdout[1]).cast("date"))
    long = labels.select(inside.alias("held"), F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets])).alias("t")).select("held", "t.*")
    y = F.col("y").cast("double")
    return long.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("y").isNull()).alias("n_dropped"), F.count("y").alias("n_kept"),
        F.avg(y).alias("base_rate"), F.avg(F.when(F.col("held"), y)).alias("base_rate_holdout"),
        F.count_if(~F.col("y")).alias("negatives"))
