"""Per-fund return and risk metrics: one grouped pass over long rows, no per-fund loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import annualise, daily_rate, growth_rate, safe_divide, years_between
from .series import by_date, daily_returns, with_returns


def cagr_of(levels: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Growth a year from the first to the last level; NULL below two rows."""
    first, last = F.min_by(value, "dt"), F.max_by(value, "dt")
    span = years_between(F.max("dt"), F.min("dt"))
    return levels.where(F.col(value).isNotNull()).groupBy(key).agg(
        growth_rate(safe_divide(last, first), span).alias(out))


def sharpe_of(r: Column, rate: float, days: int) -> Column:
    return safe_divide(F.avg(r) - F.lit(rate), F.stddev_samp(r)) * F.sqrt(F.lit(float(days)))


def sortino_of(r: Column, rate: float, days: int) -> Column:
    short = F.when(r.isNotNull(), F.least(r - F.lit(rate), F.lit(0.0)))
    downside = F.sqrt(F.avg(short * short))
    return safe_divide(F.avg(r) - F.lit(rate), downside) * F.sqrt(F.lit(float(days)))


def return_metrics(nav: DataFrame, days: int = K.TRADING_DAYS, rf: float = K.RISK_FREE_ANNUAL) -> DataFrame:
    """CAGR, annualised return and volatility, Sharpe, Sortino per fund."""
    rate, r = daily_rate(rf, days), F.col("r")
    first, last = F.min_by("nav", "dt"), F.max_by("nav", "dt")
    root = F.sqrt(F.lit(float(days)))
    return with_returns(nav).groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("n_obs"),
        growth_rate(safe_divide(last, first), years_between(F.max("dt"), F.min("dt"))).alias("cagr_full"),
        annualise(F.product(F.lit(1.0) + r), F.count(r), days).alias("ann_return"),
        F.when(F.count(r) > 2, F.stddev_samp(r) * root).alias("ann_vol"),
        sharpe_of(r, rate, days).alias("sharpe"),
        sortino_of(r, rate, days).alias("sortino"),
    )


def max_drawdown(levels: DataFrame, key: str = "fund_id", value: str = "nav", out: str = "max_drawdown") -> DataFrame:
    peak = F.max(value).over(by_date(key).rowsBetween(Window.unboundedPreceding, 0))
    falls = levels.withColumn("_fall", safe_divide(value, peak) - 1)
    return falls.groupBy(key).agg(F.min("_fall").alias(out))


def joint_returns(nav: DataFrame, bench: DataFrame, names: DataFrame) -> DataFrame:
    """Rows where fund and benchmark both have a return: (fund_id, dt, f, b).

    ``bench`` is (name, dt, level); ``names`` maps fund_id to name.
    """
    own = daily_returns(nav, out="f").join(names.select("fund_id", "name"), "fund_id")
    other = daily_returns(bench, "name", "level", "b")
    return own.join(other, ["name", "dt"]).select("fund_id", "dt", "f", "b")


def _side(mask: Column, days_needed: int = 10) -> Column:
    """Ratio of geometric mean returns of fund and benchmark over the masked rows."""
    n = F.count_if(mask)
    power = F.lit(1.0) / F.greatest(n, F.lit(1))

    def mean(c: str) -> Column:
        return F.pow(F.product(F.when(mask, F.lit(1.0) + F.col(c))), power) - 1

    return F.when(n > days_needed, safe_divide(mean("f"), mean("b")))


def relative_metrics(
    joint: DataFrame, days: int = K.TRADING_DAYS, rf: float = K.RISK_FREE_ANNUAL, min_obs: int = K.MIN_JOINT_OBS
) -> DataFrame:
    """Beta, alpha, tracking error, information ratio, capture ratios from (f, b) rows."""
    f, b, n = F.col("f"), F.col("b"), F.count(F.lit(1))
    enough = n >= min_obs
    root = F.sqrt(F.lit(float(days)))
    base = joint.groupBy("fund_id").agg(
        n.alias("joint_obs"),
        F.when(enough, safe_divide(F.covar_samp(f, b), F.var_samp(b))).alias("beta"),
        annualise(F.product(F.lit(1.0) + f), n, days).alias("ann_f"),
        annualise(F.product(F.lit(1.0) + b), n, days).alias("ann_b"),
        F.when(enough, F.stddev_samp(f - b) * root).alias("tracking_error"),
        _side(b > 0).alias("upside_capture"),
        _side(b < 0).alias("downside_capture"),
    )
    return base.select(
        "fund_id", "joint_obs", "beta",
        (F.col("ann_f") - (F.lit(rf) + F.col("beta") * (F.col("ann_b") - F.lit(rf)))).alias("alpha"),
        "tracking_error",
        safe_divide(F.col("ann_f") - F.col("ann_b"), F.col("tracking_error")).alias("info_ratio"),
        "upside_capture", "downside_capture",
    )


def treynor(returns: DataFrame, relative: DataFrame) -> DataFrame:
    """Excess of the return over all own rows, per unit of beta."""
    return returns.join(relative, "fund_id", "left").select(
        "fund_id", safe_divide(F.col("ann_return") - F.lit(K.RISK_FREE_ANNUAL), "beta").alias("treynor"))


def tracking_difference(nav: DataFrame, bench: DataFrame, names: DataFrame, min_obs: int = K.TRADING_DAYS) -> DataFrame:
    """CAGR difference over the shared dates, from ``min_obs`` shared dates up."""
    shared = nav.join(names.select("fund_id", "name"), "fund_id").join(bench, ["name", "dt"])
    span = years_between(F.max("dt"), F.min("dt"))

    def growth(c: str) -> Column:
        return growth_rate(safe_divide(F.max_by(c, "dt"), F.min_by(c, "dt")), span)

    return shared.groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("shared_obs"),
        F.when(F.count(F.lit(1)) >= min_obs, growth("nav") - growth("level")).alias("tracking_difference"))


def rolling_growth(nav: DataFrame, years: int, lag_rows: int, fridays_only: bool = False) -> DataFrame:
    """Annualised return over the previous ``lag_rows`` rows, at every row that has them."""
    ratio = safe_divide("nav", F.lag("nav", lag_rows).over(by_date()))
    out = nav.select("fund_id", "dt", (F.pow(ratio, F.lit(1.0 / years)) - 1).alias("rolling"))
    out = out.where(F.col("rolling").isNotNull())
    return out.where(F.weekday("dt") == 4) if fridays_only else out


def rolling_stats(nav: DataFrame, years: int, lag_rows: int, fridays_only: bool = False) -> DataFrame:
    """Mean, 25th percentile and negative share per fund; the sort is bounded by the calendar."""
    p = f"rr{years}y"
    return rolling_growth(nav, years, lag_rows, fridays_only).groupBy("fund_id").agg(
        F.avg("rolling").alias(f"{p}_mean"),
        F.percentile("rolling", 0.25).alias(f"{p}_p25"),
        F.avg((F.col("rolling") < 0).cast("double")).alias(f"{p}_negative_share"),
    )


def spread_velocity(joint: DataFrame, lookback: int = 63, days: int = K.TRADING_DAYS) -> DataFrame:
    """Last rolling mean of the active return, annualised, and its slope over ``lookback`` rows."""
    w = by_date()
    rolled = (
        joint.withColumn("_k", F.row_number().over(w))
        .withColumn("spread", F.avg(F.col("f") - F.col("b")).over(w.rowsBetween(1 - lookback, 0)) * days)
        .where(F.col("_k") >= lookback)
    )
    last = Window.partitionBy("fund_id").orderBy(F.col("_k").desc())
    recent = (
        rolled.withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= lookback)
        .groupBy("fund_id").agg(
            F.count(F.lit(1)).alias("_n"), F.max_by("spread", "_k").alias("arb_spread_ann"),
            (F.regr_slope("spread", F.col("_k").cast("double")) * days).alias("arb_spread_velocity"))
    )
    return recent.where(F.col("_n") >= lookback).drop("_n")


def fund_metrics(
    nav: DataFrame, bench: DataFrame, names: DataFrame, days: int = K.TRADING_DAYS,
    rolling_lags: dict[int, int] | None = None,
) -> DataFrame:
    """The full metric row of every fund that has prices; missing metrics stay NULL."""
    lags = rolling_lags or {3: 3 * days, 5: 5 * days}
    own = return_metrics(nav, days)
    relative = relative_metrics(joint_returns(nav, bench, names), days)
    out = (
        own.join(relative, "fund_id", "left")
        .withColumn("treynor", safe_divide(F.col("ann_return") - F.lit(K.RISK_FREE_ANNUAL), "beta"))
        .join(max_drawdown(nav), "fund_id", "left")
    )
    for years, lag_rows in lags.items():
        out = out.join(rolling_stats(nav, years, lag_rows), "fund_id", "left")
    return out


def alert_metrics(
    nav: DataFrame, bench: DataFrame, names: DataFrame, days: int = K.TRADING_DAYS,
    sortino_min: int = 126, drawdown_min: int = 60,
) -> DataFrame:
    """The metric row the alert rules read: benchmark terms use shared dates only."""
    rate = daily_rate(K.RISK_FREE_ANNUAL, days)
    r = F.col("r")
    first, last = F.min_by("nav", "dt"), F.max_by("nav", "dt")
    own = with_returns(nav).groupBy("fund_id").agg(
        growth_rate(safe_divide(last, first), years_between(F.max("dt"), F.min("dt"))).alias("cagr"),
        F.when(F.count(r) >= sortino_min, sortino_of(r, rate, days)).alias("sortino"),
    )
    recent = last_rows(nav, 3 * days)
    shared = nav.join(names.select("fund_id", "name"), "fund_id").join(bench, ["name", "dt"])
    joint = (
        shared.withColumn("f", safe_divide("nav", F.lag("nav").over(by_date())) - 1)
        .withColumn("b", safe_divide("level", F.lag("level").over(by_date())) - 1)
    )
    n_common = F.count(F.lit(1))
    span = years_between(F.max("dt"), F.min("dt"))

    def growth(c: str) -> Column:
        return growth_rate(safe_divide(F.max_by(c, "dt"), F.min_by(c, "dt")), span)

    common = shared.groupBy("fund_id").agg(
        n_common.alias("n_common"),
        F.when(n_common > days, growth("nav") - growth("level")).alias("excess_cagr_3y"),
        F.when(n_common >= days, growth("nav") - growth("level")).alias("tracking_difference_tri"),
    ).where(F.col("n_common") >= 60)
    relative = relative_metrics(joint.where(F.col("f").isNotNull() & F.col("b").isNotNull()), days).drop("alpha", "joint_obs")
    bench_recent = last_rows(shared, 3 * days)
    out = (
        own.join(_drawdown_from(recent, "nav", drawdown_min, "max_dd_3y"), "fund_id", "left")
        .join(rolling_stats(nav, 3, 3 * days).select(
            "fund_id", F.col("rr3y_negative_share")), "fund_id", "left")
    )
    block = common.join(relative, "fund_id", "left").join(
        _drawdown_from(bench_recent, "level", drawdown_min, "benchmark_max_dd_3y"), "fund_id", "left")
    return out.join(block, "fund_id", "left")


def last_rows(levels: DataFrame, n: int, key: str = "fund_id") -> DataFrame:
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col("dt").desc()))
    return levels.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def _drawdown_from(levels: DataFrame, value: str, min_obs: int, out: str) -> DataFrame:
    peak = F.max(value).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return levels.withColumn("_fall", safe_divide(value, peak) - 1).groupBy("fund_id").agg(
        F.when(F.count(F.lit(1)) >= min_obs, F.min("_fall")).alias(out))


def recent_facts(nav: DataFrame, days: int = K.TRADING_DAYS, min_returns: int = 30) -> DataFrame:
    """Volatility over the last year of rows and drawdown over the last three."""
    counted = with_returns(nav).withColumn(
        "_back", F.row_number().over(Window.partitionBy("fund_id").orderBy(F.col("dt").desc())))
    vol = counted.groupBy("fund_id").agg(
        F.when(F.count("r") >= min_returns,
               F.stddev_samp(F.when(F.col("_back") <= days, F.col("r"))) * F.sqrt(F.lit(float(days)))).alias("vol_1y"))
    return vol.join(_drawdown_from(last_rows(nav, 3 * days), "nav", 1, "max_dd_3y"), "fund_id")


def metric_matrix(metadata: DataFrame, metrics: DataFrame, risk: DataFrame, nav: DataFrame) -> DataFrame:
    """Metadata with metric and risk columns; a fund without prices is left out."""
    priced = metadata.join(nav.select("fund_id").distinct(), "fund_id", "left_semi")
    return priced.join(metrics, "fund_id", "left").join(risk, "fund_id", "left")
