"""Null-aware column arithmetic.  Missing stays NULL; NaN and infinities become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DAYS_PER_YEAR, RISK_FREE_ANNUAL, TRADING_DAYS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value when it is an ordinary number, else NULL."""
    x = col(c).cast("double")
    usual = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(usual, x)


def safe_divide(n: Column | str, d: Column | str, fill: float | None = None) -> Column:
    """n/d where |d| > 1e-12, else ``fill``."""
    num, den = col(n), col(d)
    return F.when(F.abs(den) > 1e-12, num / den).otherwise(F.lit(fill).cast("double"))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp; NULL stays NULL although ``least``/``greatest`` would skip it."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def mean_from(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n)


def stddev_from(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from a count, a sum and a sum of squares.

    Sums may be differences of running sums, so a residue below rounding noise is zero.
    """
    ss = squares - total * total / F.when(n > 0, n)
    clean = F.when(ss > F.lit(1e-12) * F.abs(squares), ss).otherwise(0.0)
    return F.when((n > 1) & ss.isNotNull(), F.sqrt(clean / F.when(n > 1, n - 1)))


def daily_rate(annual: float = RISK_FREE_ANNUAL, trading_days: int = TRADING_DAYS) -> float:
    return (1.0 + annual) ** (1.0 / trading_days) - 1.0


def years_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(col(later), col(earlier)) / F.lit(DAYS_PER_YEAR)


def growth_rate(ratio: Column, years: Column) -> Column:
    """ratio^(1/years) − 1 for a positive ratio over a positive span."""
    return F.when((ratio > 0) & (years > 0), F.pow(ratio, F.lit(1.0) / F.when(years > 0, years)) - 1.0)


def annualise(gross: Column, n: Column, trading_days: int = TRADING_DAYS) -> Column:
    """gross^(trading_days/n) − 1, NULL without rows or when the gross is not positive."""
    return F.when(
        (n > 0) & (gross > 0), F.pow(gross, F.lit(float(trading_days)) / F.when(n > 0, n)) - 1.0
    )


def logit(p: Column | str) -> Column:
    x = clip(p, 1e-6, 1 - 1e-6)
    return F.log(x / (F.lit(1.0) - x))


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(z, -700.0, 700.0)))


def pick(condition: Column, code: Column | str) -> Column:
    """A string when the condition holds, else NULL; the element for ``array_compact``."""
    return F.when(condition, F.lit(code) if isinstance(code, str) else code)
