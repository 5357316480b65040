"""Scoring with a stored linear model: pure column arithmetic, no row-wise Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, logit, sigmoid


def feature_map(features: Sequence[str]) -> Column:
    """Named features as one map; missing values are NULL entries."""
    entries: list[Column] = []
    for f in features:
        entries += [F.lit(f), finite(F.col(f))]
    return F.create_map(*entries)


def linear_score(features: Sequence[str], model: str = "m") -> Column:
    """Raw probability: impute the stored median, standardise, dot with the coefficients, squash."""
    z = F.col(f"{model}.intercept")
    for f in features:
        med, mean, sd, w = (F.col(f"{model}.{part}")[f] for part in ("imputation_medians", "standardize_mean", "standardize_std", "coefficients"))
        z = z + w * (F.coalesce(finite(F.col(f)), med) - mean) / sd
    return sigmoid(z)


def interpolate(p: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear map through the knots, flat beyond the ends."""
    n = F.size(xs)
    above = F.size(F.filter(xs, lambda x: x <= p))
    lo, hi = F.greatest(above, F.lit(1)), F.least(above + 1, n)
    x0, x1 = F.try_element_at(xs, lo), F.try_element_at(xs, hi)
    y0, y1 = F.try_element_at(ys, lo), F.try_element_at(ys, hi)
    inside = y0 + (y1 - y0) * (p - x0) / F.when(x1 > x0, x1 - x0)
    return F.when(above == 0, F.try_element_at(ys, F.lit(1))).when(above >= n, F.try_element_at(ys, F.lit(-1))).otherwise(inside)


def calibrate(p: Column, calibration: str = "m.calibration") -> Column:
    """Stored calibration: knots for an isotonic map, else the logistic on log-odds."""
    c = F.col(calibration)
    platt = sigmoid(c["coef"] * logit(p) + c["intercept"])
    return F.when(c["kind"] == "isotonic", interpolate(p, c["x"], c["y"])).otherwise(platt)


def score(rows: DataFrame, model: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every row under every target of the model (one model row per target).

    The model table holds one row per target and goes to every task.  A join by target would send all
    rows of a target to one task: Spark's size check does not know how small a table made by the driver is.
    """
    holder = model.where(F.col("target").isNotNull()).select("target", "model_id", F.struct(
        "coefficients", "imputation_medians", "standardize_mean", "standardize_std", "intercept", "calibration").alias("m"),
        F.col("signal_context"))
    scored = rows.drop("target").crossJoin(F.broadcast(holder)).withColumn("p_raw", linear_score(features))
    return scored.withColumn("probability", calibrate(F.col("p_raw"))).drop("m")


def imputed(features: Sequence[str]) -> Column:
    """Names of the features that have no value."""
    return F.array_compact(F.array(*[F.when(finite(F.col(f)).isNull(), F.lit(f)) for f in features]))
