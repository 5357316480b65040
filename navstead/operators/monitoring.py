"""Input drift, health grades and batch gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import finite
from ..functions.ranking import group_quantiles


def _long(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.select(*[finite(f).alias(f) for f in features]).unpivot([], list(features), "feature", "value")


def bin_edges(rows: DataFrame, features: Sequence[str] = K.DRIFT_FEATURES, bins: int = K.PSI_BINS) -> DataFrame:
    """(feature, edges): distinct deciles with infinite ends; features below 30 values drop."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    q = group_quantiles(_long(rows, features), ["feature"], "value", probs).where(F.col("n") >= K.PSI_MIN_FINITE)
    cuts = F.array_sort(F.array_distinct(F.array(*probs)))
    inner = F.slice(cuts, F.lit(2), F.size(cuts) - 2)
    inf = float("inf")
    edges = F.concat(F.array(F.lit(-inf)), inner, F.array(F.lit(inf)))
    return q.where(F.size(cuts) >= 2).select("feature", edges.alias("edges"))


def inner_sum(edges: Column | str) -> Column:
    """Sum of the finite edges; NULL where the infinite ends are all there is."""
    inner = F.filter(edges, lambda e: F.abs(e) < float("inf"))
    return F.when(F.size(inner) > 0, F.aggregate(inner, F.lit(0.0), lambda a, x: a + x))


def bin_counts(rows: DataFrame, edges: DataFrame, features: Sequence[str] = K.DRIFT_FEATURES) -> DataFrame:
    """(feature, bin, n): right-open bins counted after a join on the feature name alone."""
    values = _long(rows, features).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    slot = F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1
    low_high = F.greatest(F.lit(0), F.least(slot, F.size("edges") - 2))
    return values.join(edges, "feature").groupBy("feature", low_high.alias("bin")).agg(F.sum("c").alias("n"))


def psi_reference(rows: DataFrame, features: Sequence[str] = K.DRIFT_FEATURES) -> DataFrame:
    """(feature, edges, bin_props, missing_rate) of the training rows."""
    edges = bin_edges(rows, features)
    counts = bin_counts(rows, edges, features)
    total = counts.groupBy("feature").agg(F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    present = _long(rows, features).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("have"))
    props = F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("t"))
    return edges.join(total, "feature").join(present, "feature").select(
        "feature", "edges", props.alias("bin_props"), (F.lit(1.0) - F.col("have") / F.col("rows")).alias("missing_rate"))


def psi_by_feature(rows: DataFrame, reference: DataFrame, features: Sequence[str] = K.DRIFT_FEATURES) -> DataFrame:
    """(feature, n, psi) for features with at least 30 live values; a bin without rows counts zero."""
    counts = bin_counts(rows, reference.select("feature", "edges"), features).withColumnRenamed("n", "c")
    total = counts.groupBy("feature").agg(F.sum("c").alias("n")).where(F.col("n") >= K.PSI_MIN_FINITE)
    slots = reference.select("feature", F.posexplode("bin_props").alias("bin", "ref")).join(total, "feature")
    joined = slots.join(counts, ["feature", "bin"], "left")
    cur = F.greatest(F.coalesce("c", F.lit(0)) / F.col("n"), F.lit(K.PSI_FLOOR))
    ref = F.greatest("ref", F.lit(K.PSI_FLOOR))
    return joined.groupBy("feature").agg(F.max("n").alias("n"), F.sum((cur - ref) * F.log(cur / ref)).alias("psi"))


def psi_summary(per_feature: DataFrame) -> DataFrame:
    """One row: status, largest and mean value, the three worst features."""
    worst = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("psi", "feature")))), 1, 3)
    one = per_feature.agg(F.count(F.lit(1)).alias("n_features"), F.max("psi").alias("_max"), F.avg("psi").alias("_mean"), worst.alias("_worst"))
    status = (
        F.when(F.col("n_features") == 0, "INSUFFICIENT_DATA").when(F.col("_max") > K.PSI_SIGNIFICANT, "SIGNIFICANT_SHIFT")
        .when(F.col("_max") > K.PSI_MODERATE, "MODERATE_SHIFT").otherwise("OK")
    )
    return one.select(status.alias("status"), F.round("_max", 4).alias("psi_max"), F.round("_mean", 4).alias("psi_mean"),
                      F.transform("_worst", lambda w: w.feature).alias("worst"), "n_features")


def psi_live(panel: DataFrame, reference: DataFrame, reference_model: str | None, model_id: str | None,
             features: Sequence[str] = K.DRIFT_FEATURES) -> DataFrame:
    """Drift of one live panel, or the reason it cannot be measured."""
    spark = panel.sparkSession

    def refusal(status: str) -> DataFrame:
        return spark.createDataFrame([(status, None, None, [], 0)],
                                     "status string, psi_max double, psi_mean double, worst array<string>, n_features bigint")

    if reference_model is None:
        return refusal("REFERENCE_MISSING")
    if model_id is not None and model_id != reference_model:
        return refusal("REFERENCE_STALE")
    enough = panel.agg(F.count(F.lit(1)) >= K.PSI_MIN_UNIVERSE).scalar()
    return psi_summary(psi_by_feature(panel.where(enough), reference, features))


# --- health grades ---------------------------------------------------------------------
def grade_drift(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "OK", "GREEN").when(s.isin("MODERATE_SHIFT", "SIGNIFICANT_SHIFT"), "AMBER").otherwise("UNAVAILABLE")


def grade_stability(status: Column | str, rho: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    r = F.col(rho) if isinstance(rho, str) else rho
    graded = F.when(r >= K.STABILITY_GREEN, "GREEN").when(r < K.STABILITY_RED, "RED").otherwise("AMBER")
    return F.when((s == "OK") & r.isNotNull(), graded).otherwise("PENDING")


def grade_errors(n_total: Column | str, n_errors: Column | str) -> Column:
    t = F.coalesce(F.col(n_total) if isinstance(n_total, str) else n_total, F.lit(0))
    e = F.coalesce(F.col(n_errors) if isinstance(n_errors, str) else n_errors, F.lit(0))
    rate = e / F.when(t > 0, t)
    return F.when(t == 0, "UNAVAILABLE").when(rate < K.ERROR_GREEN, "GREEN").when(rate >= K.ERROR_RED, "RED").otherwise("AMBER")


def grade_outcome(status: Column | str, lift: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    x = F.col(lift) if isinstance(lift, str) else lift
    graded = F.when(x >= K.LIFT_GREEN, "GREEN").when(x < K.LIFT_RED, "RED").otherwise("AMBER")
    return F.when(s.isin("PENDING_MATURITY", "INSUFFICIENT_MATURED"), "PENDING").when((s == "OK") & x.isNotNull(), graded).otherwise("UNAVAILABLE")


def worst_grade(*grades: Column) -> Column:
    """The worst actionable grade; pending and unavailable never worsen it."""
    ranks = F.array_max(F.array(*[F.when(g == "GREEN", 0).when(g == "AMBER", 1).when(g == "RED", 2) for g in grades]))
    return F.when(ranks == 2, "RED").when(ranks == 1, "AMBER").when(ranks == 0, "GREEN").otherwise("PENDING")


def health_report(inputs: DataFrame) -> DataFrame:
    """Grades and headline per run; needs psi_status, rank_status, spearman, n_total, n_errors, outcome_status, lift."""
    graded = inputs.select(
        "*", grade_drift("psi_status").alias("input_drift"), grade_stability("rank_status", "spearman").alias("prediction_stability"),
        grade_errors("n_total", "n_errors").alias("pipeline_coverage"), grade_outcome("outcome_status", "lift").alias("outcome_skill"))
    names = ("input_drift", "prediction_stability", "pipeline_coverage", "outcome_skill")
    overall = worst_grade(*[F.col(n) for n in names])

    def which(grade: str) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(F.col(n) == grade, F.lit(n)) for n in names])), ", ")

    headline = (
        F.when(overall == "RED", F.concat(F.lit("ACTION NEEDED: "), which("RED"))).when(overall == "AMBER", F.concat(F.lit("WATCH: "), which("AMBER")))
        .when(overall == "GREEN", "HEALTHY").otherwise("MONITORING ONLY")
    )
    return graded.withColumn("status", overall).withColumn("headline", headline)


# --- batch gates -----------------------------------------------------------------------
def batch_gates(batches: DataFrame, max_error_rate: float, max_anchor_age: int, today: Column) -> DataFrame:
    """Rows (…, gate, passed, detail); needs n_total, n_errors, last_anchor.  A failed gate fails the job."""
    rate = F.col("n_errors") / F.when(F.col("n_total") > 0, F.col("n_total"))
    age = F.datediff(today, F.col("last_anchor").cast("date"))
    gates = F.explode(F.array(
        F.struct(F.lit("not_empty").alias("gate"), (F.col("n_total") > 0).alias("passed"), F.col("n_total").cast("string").alias("detail")),
        F.struct(F.lit("error_rate").alias("gate"), F.coalesce(rate <= max_error_rate, F.lit(False)).alias("passed"), F.format_string("%.4f", rate).alias("detail")),
        F.struct(F.lit("ledger_moving").alias("gate"), F.coalesce(age <= max_anchor_age, F.lit(True)).alias("passed"), age.cast("string").alias("detail")),
    )).alias("g")
    return batches.select("*", gates).select(*batches.columns, "g.*")


def monitoring_block(ledger: DataFrame, realized: DataFrame, psi: DataFrame, stability: DataFrame) -> DataFrame:
    """One row with the four one-row monitoring results as structs."""

    def packed(df: DataFrame, name: str) -> Column:
        return df.agg(F.any_value(F.struct(*df.columns))).scalar().alias(name)

    return ledger.select(F.struct(*ledger.columns).alias("ledger")).select(
        "ledger", packed(realized, "realized_ic"), packed(psi, "psi"), packed(stability, "rank_stability"))
