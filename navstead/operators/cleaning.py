"""Price cleaning and validation: bad prints, payouts, integrity, audits, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import finite, safe_divide
from ..functions.text import sorted_array
from .series import by_date, with_returns


def flag_spikes(nav: DataFrame) -> DataFrame:
    """``is_spike``: a jump of at least 10 % of which the next row gives back at least half.

    Judged on the series as delivered, once; series below five rows are left alone.
    """
    w = by_date()
    here = with_returns(nav)
    after = F.lead("r").over(w)
    size = F.count(F.lit(1)).over(Window.partitionBy("fund_id"))
    spike = (
        (size >= K.MIN_SERIES_OBS)
        & (F.abs("r") >= K.SPIKE_RETURN)
        & (F.col("r") * after < 0)
        & (F.abs(after) >= K.SPIKE_REVERSION * F.abs("r"))
    )
    return here.withColumn("is_spike", F.coalesce(spike, F.lit(False))).withColumn("_size", size).drop("r")


def remove_spikes(nav: DataFrame) -> DataFrame:
    """The surviving rows, with the delivered length of each series as ``n_delivered``."""
    return flag_spikes(nav).where(~F.col("is_spike")).drop("is_spike").withColumnRenamed("_size", "n_delivered")


def reconstruct_payouts(nav: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Total-return levels for payout plans.

    ``nav`` has ``is_payout_plan``; ``bench`` is (fund_id, dt, bench) already aligned to the
    fund's dates (a stale benchmark value is allowed, as after a forward fill).  A drop of 3 %
    or more is a payout unless the benchmark fell by more than 1.5 % too; every later level is
    divided by the drop.  Adds ``payout`` and ``market_move`` flags.
    """
    rows = with_returns(nav)
    if bench is not None:
        rows = rows.join(bench, ["fund_id", "dt"], "left")
        prior = F.last("bench", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, -1))
        level = F.last("bench", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("bench_r", safe_divide(level, prior) - 1).drop("bench")
    else:
        rows = rows.withColumn("bench_r", F.lit(None).cast("double"))
    if "n_delivered" not in rows.columns:
        rows = rows.withColumn("n_delivered", F.count(F.lit(1)).over(Window.partitionBy("fund_id")))
    drop = F.col("is_payout_plan") & (F.col("r") <= -K.PAYOUT_DROP) & (F.col("n_delivered") >= K.MIN_SERIES_OBS)
    fell = F.coalesce(F.col("bench_r") < -K.BENCH_CALM, F.lit(False))
    rows = (
        rows.withColumn("payout", F.coalesce(drop & ~fell, F.lit(False)))
        .withColumn("market_move", F.coalesce(drop & fell, F.lit(False)))
    )
    step = F.when(F.col("payout"), F.lit(1.0) / (F.lit(1.0) + F.col("r"))).otherwise(1.0)
    factor = F.product(step).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("nav", F.col("nav") * factor).drop("r", "bench_r", "n_delivered")


def clean(nav: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Spikes out, then payouts put back; ``nav`` is (fund_id, dt, nav, is_payout_plan)."""
    usual = nav.where(finite("nav").isNotNull() & (F.col("nav") > 0))
    return reconstruct_payouts(remove_spikes(usual), bench)


def cleaning_report(nav: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Per fund: rows in and out, spikes, payouts with dates, and drops left as market moves."""
    usual = nav.where(finite("nav").isNotNull() & (F.col("nav") > 0))
    before = flag_spikes(usual).groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if("is_spike").alias("spikes_removed"))
    after = clean(nav, bench).groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.count_if("payout").alias("payout_steps"),
        F.array_sort(F.collect_list(F.when(F.col("payout"), F.col("dt")))).alias("payout_dates"),
        F.count_if("market_move").alias("market_moves"),
    )
    return before.join(after, "fund_id", "left")


def integrity(nav: DataFrame) -> DataFrame:
    """Per fund: the observation count, the broken rules, and whether the series is sound."""
    steps = nav.withColumn("_prev", F.lag("nav").over(by_date())).withColumn("_prev_dt", F.lag("dt").over(by_date()))
    move = F.abs(safe_divide(F.col("nav") - F.col("_prev"), F.col("_prev")))
    per_fund = steps.groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if(finite("nav").isNull()).alias("_odd"),
        F.count_if(F.col("nav") <= 0).alias("_low"),
        F.count_if(F.col("_prev_dt") >= F.col("dt")).alias("_repeat"),
        F.count_if(move > 0.25).alias("_jump"),
    )
    errors = sorted_array(
        F.when(F.col("n_obs") < 30, F.lit("short_history")),
        F.when(F.col("_odd") > 0, F.lit("non_finite")),
        F.when(F.col("_low") > 0, F.lit("non_positive")),
        F.when(F.col("_repeat") > 0, F.lit("dates_not_increasing")),
        F.when(F.col("_jump") > 0, F.lit("step_over_25pct")),
    )
    return per_fund.select("fund_id", "n_obs", errors.alias("errors")).withColumn("ok", F.size("errors") == 0)


def metadata_errors(meta: DataFrame) -> DataFrame:
    """Master records with an ``errors`` array; an empty array is a valid record."""
    t = {c: F.trim(F.col(c)) for c in ("fund_id", "scheme_name", "amc", "sub_category", "benchmark")}
    bench = F.upper(t["benchmark"])

    def bad(rule: Column, code: str) -> Column:
        return F.when(F.coalesce(rule, F.lit(True)), F.lit(code))

    errors = sorted_array(
        bad(~t["fund_id"].rlike("^[0-9]{4,8}$"), "code_shape"),
        F.when(F.col("isin").isNotNull() & ~F.trim("isin").rlike("^INF[0-9A-Z]{9}$"), F.lit("isin_shape")),
        bad(F.length(t["scheme_name"]) < 3, "scheme_name"),
        bad(F.length(t["amc"]) < 2, "amc"),
        bad(~F.col("category").isin(*K.SEBI_BUCKETS), "category"),
        bad(F.length(t["sub_category"]) < 2, "sub_category"),
        bad(F.length(t["benchmark"]) < 3, "benchmark"),
        bad(~(F.col("aum_cr") > 0), "aum"),
        bad(~F.col("expense_ratio").between(0.0, K.MAX_EXPENSE_RATIO), "expense_ratio"),
        F.when(F.col("inception_date").isNull(), F.lit("inception_date")),
        F.when((F.col("category") == "Index/ETF") & ~bench.isin(*K.TRI_BENCHMARKS), F.lit("index_benchmark")),
        F.when((t["sub_category"] == "Arbitrage") & (bench != K.ARBITRAGE_BENCHMARK), F.lit("arbitrage_benchmark")),
    )
    return meta.withColumn("errors", errors)


def holding_errors(lines: DataFrame) -> DataFrame:
    """Portfolio lines with a lower-cased asset type and an ``errors`` array."""
    kind = F.lower(F.trim("asset_type"))
    rated = F.col("rating").isNull() | F.col("rating").isin(*K.CREDIT_SCORES)

    def outside(c: str, low: float, high: float) -> Column:
        return F.when(~F.col(c).between(low, high), F.lit(c))

    errors = sorted_array(
        F.when(F.coalesce(F.length(F.trim("instrument")) < 2, F.lit(True)), F.lit("instrument")),
        F.when(F.coalesce(~((F.col("weight") > 0) & (F.col("weight") <= 1)), F.lit(True)), F.lit("weight")),
        F.when(F.coalesce(~kind.isin(*K.ASSET_TYPES), F.lit(True)), F.lit("asset_type")),
        F.when(~rated, F.lit("rating")),
        F.when(~(F.col("market_cap_cr") > 0), F.lit("market_cap_cr")),
        F.when(~(F.col("adv_cr") > 0), F.lit("adv_cr")),
        outside("modified_duration", 0.0, 40.0),
        outside("macaulay_duration", 0.0, 40.0),
        outside("ytm", -0.02, 0.30),
    )
    return lines.withColumn("asset_type", kind).withColumn("errors", errors)


def split_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def weight_sums(lines: DataFrame) -> DataFrame:
    """Per disclosure: line count, weight total, and whether it lies in the accepted band."""
    low, high = K.WEIGHT_SUM_BAND
    return lines.groupBy("fund_id", "as_of").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("weight").alias("weight_sum")
    ).withColumn("ok", (F.col("n_lines") > 0) & F.col("weight_sum").between(low, high))


def flatten_disclosures(disclosures: DataFrame) -> DataFrame:
    """(fund_id, as_of, holdings array) to one row per line."""
    return disclosures.select("fund_id", "as_of", F.explode("holdings").alias("h")).select("fund_id", "as_of", "h.*")


# --- audits: rows of (stage, check, passed, detail) --------------------------------
def _check(df: DataFrame, stage: str, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("check"),
                 F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))
        for name, (passed, detail) in checks.items()
    ])
    return df.select(F.explode(entries).alias("c")).select("c.*")


def audit_nav(nav: DataFrame, stage: str = "nav_panel") -> DataFrame:
    steps = nav.withColumn("_back", F.lag("dt").over(by_date()) >= F.col("dt"))
    funds = steps.groupBy("fund_id").agg(
        F.count("nav").alias("present"), F.count_if("_back").alias("back"),
        F.count_if(F.abs("nav") == float("inf")).alias("inf"), F.count_if(F.col("nav") <= 0).alias("low"))
    total = funds.agg(F.sum("back").alias("back"), F.sum("inf").alias("inf"), F.sum("low").alias("low"),
                      F.count_if(F.col("present") == 0).alias("dead"))
    return _check(total, stage, {
        "dates_monotonic": (F.col("back") == 0, F.col("back")),
        "no_inf_values": (F.col("inf") == 0, F.col("inf")),
        "navs_strictly_positive": (F.col("low") == 0, F.col("low")),
        "no_all_null_funds": (F.col("dead") == 0, F.col("dead")),
    })


def audit_holdings(lines: DataFrame, stage: str = "holdings",
                   required: tuple[str, ...] = ("fund_id", "as_of", "instrument", "weight", "asset_type")) -> DataFrame:
    missing = [c for c in required if c not in lines.columns]
    low, high = K.WEIGHT_SUM_BAND
    total = lines.groupBy("fund_id").agg(F.sum("weight").alias("w")).agg(
        F.count_if(~F.col("w").between(low, high)).alias("outside"))
    return _check(total, stage, {
        "baseline_schema": (F.lit(not missing), F.lit(",".join(missing))),
        "weights_sum_band": (F.col("outside") == 0, F.col("outside")),
    })


def audit_bench_coverage(fund_returns: DataFrame, bench_returns: DataFrame, names: DataFrame) -> DataFrame:
    """Per fund: shared return days over own return days, passed from 90 % up."""
    own = fund_returns.join(names, "fund_id")
    hit = bench_returns.select("name", "dt", F.lit(1).alias("_hit"))
    return own.join(hit, ["name", "dt"], "left").groupBy("fund_id").agg(
        F.count("r").alias("own_days"), F.count("_hit").alias("shared_days")
    ).withColumn("coverage", safe_divide("shared_days", "own_days", 0.0)).withColumn("passed", F.col("coverage") >= 0.90)


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("stage", "check").agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"))


def row_continuity(before: DataFrame, after: DataFrame, stage: str) -> DataFrame:
    """One audit row: a transform must keep at least half of its rows."""
    sizes = before.agg(F.count(F.lit(1)).alias("n0")).withColumn("n1", after.agg(F.count(F.lit(1))).scalar())
    ratio = safe_divide("n1", F.greatest("n0", F.lit(1)), 0.0)
    return _check(sizes, stage, {"row_continuity>=50%": (ratio >= 0.5, F.format_string("%.4f", ratio))})


