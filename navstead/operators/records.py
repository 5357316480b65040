"""Per-fund records and the batch artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import lookup, sorted_array
from ..sources.sinks import json_safe


def data_flags() -> Column:
    """Coverage flags of a record; every refusal status has its own.  Needs category,
    declared_sector, expense_ratio, eligibility, cohort_status."""
    status = F.col("cohort_status")
    return sorted_array(
        F.when(F.col("category").isin("Sectoral", "Thematic") & F.col("declared_sector").isNull(), F.lit("SECTOR_UNMAPPED")),
        F.when(F.col("expense_ratio").isNull(), F.lit("EXPENSE_UNAVAILABLE")),
        F.when(F.col("eligibility").isin("NEWBORN", "YOUNG"), F.lit("SHORT_HISTORY")),
        F.when(status.isNotNull() & (status != "OK"), F.coalesce(lookup(status, K.STATUS_FLAGS), F.lit(K.FLAG_OTHER))))


def fund_records(funds: DataFrame, signals: DataFrame, alerts: DataFrame) -> DataFrame:
    """Nested record per fund.

    ``funds``: identity, facts, verdict columns; ``signals``: live scores; ``alerts``: long rows.
    Imputation counts stay NULL unless the score measured them.
    """
    cohort = signals.select(
        "fund_id", F.col("status").alias("cohort_status"), "probability", "cohort_percentile", "cohort_n", "imputed_features", "n_features")
    listed = alerts.groupBy("fund_id").agg(
        F.array_sort(F.collect_list(F.struct("severity_rank", "code", "severity", "source", "basis"))).alias("alerts"))
    rows = funds.join(cohort, "fund_id", "left").join(listed, "fund_id", "left")
    measured = F.col("cohort_status").isin(*K.IMPUTATION_MEASURED)
    n_imputed = F.when(measured, F.size("imputed_features"))
    out = rows.select(
        "fund_id", "scheme_name", "category", F.col("declared_sector").alias("sector"), "eligibility",
        F.struct("cagr", F.col("vol_1y").alias("vol"), F.col("max_dd_3y").alias("max_dd"), "sortino", "benchmark",
                 F.col("expense_ratio").alias("expense")).alias("facts"),
        F.struct(
            F.struct(*K.BASE_UTILITY_WEIGHTS).alias("sub_scores"), "verdict", "verdict_color", "verdict_caveat",
            F.struct("if_score_red", "if_score_not_red").alias("verdict_branches"), F.lit(K.SCREEN_RED).alias("screen_score_red_below"),
            "utility_score", "cohort_status", F.col("probability").alias("cohort_q1_prob"), "cohort_percentile", "cohort_n",
            n_imputed.alias("n_imputed"), F.round(n_imputed / F.col("n_features"), 4).alias("imputed_fraction"),
            F.when(measured, F.col("imputed_features")).alias("imputed_features")).alias("signal_a"),
        F.coalesce("alerts", F.array().cast("array<struct<severity_rank:int,code:string,severity:string,source:string,basis:string>>")).alias("alerts_b"),
        "coverage_flags", data_flags().alias("data_flags"))
    return json_safe(out)


def batch_coverage(records: DataFrame, n_requested: int | Column) -> DataFrame:
    """Counters over the records of one batch."""
    wanted = {
        "n_thin_cohort": "THIN_COHORT", "n_stale_nav": "STALE_NAV", "n_not_in_universe": "NOT_IN_UNIVERSE",
        "n_out_of_training_universe": "OUT_OF_TRAINING_UNIVERSE", "n_sector_unresolved": "SECTOR_UNRESOLVED",
        "n_insufficient_history": "INSUFFICIENT_HISTORY",
    }
    total = F.lit(n_requested) if isinstance(n_requested, int) else n_requested
    got = records.agg(
        F.count(F.lit(1)).alias("n_ok"), F.count_if(F.col("eligibility") == "EVALUABLE").alias("n_evaluable"),
        *[F.count_if(F.array_contains("data_flags", flag)).alias(name) for name, flag in wanted.items()],
        F.count("facts.expense").alias("n_expense_available"))
    return got.select(total.cast("bigint").alias("n_total"), "n_ok", (total - F.col("n_ok")).cast("bigint").alias("n_errors"),
                      *[c for c in got.columns if c != "n_ok"])
