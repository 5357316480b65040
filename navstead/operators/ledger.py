"""Append-only predictions: idempotent append, read-side dedupe, grading of matured rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ranking import group_quantile_with_one_more, one_more, spearman
from . import cohorts
from .peers import forward_returns

KEY = list(K.LEDGER_KEY)


def prediction_rows(scored: DataFrame, run_id: str, pipeline_sha: str, logged_at: Column | None = None) -> DataFrame:
    """Ledger rows of OK scores only, with a hash over the fields that make the prediction; the cohort by its id."""
    ok = scored.where(F.col("status") == "OK")
    sorted_features = F.map_from_entries(F.array_sort(F.map_entries("features")))
    body = F.struct(
        F.col("anchor").cast("string").alias("anchor"), sorted_features.alias("features"), "fund_id", "model_id", "probability", "target")
    stamp = logged_at if logged_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return ok.select(
        F.lit(1).alias("schema_version"), F.lit(run_id).alias("run_id"), stamp.alias("logged_at"), F.lit(pipeline_sha).alias("pipeline_sha"),
        "model_id", "target", "fund_id", F.col("anchor").cast("string").alias("anchor"), "probability", "cohort_percentile", "cohort_key",
        "cohort_n", "universe_n", "cohort_id", "cohort_added", "signal_context", "imputed_features", "features",
        F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256).alias("row_hash"))


def _complete(keys: Sequence[str] = KEY) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _first_copies(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """The first row of every key.  An aggregate, so a key with very many copies shrinks in each task."""
    whole = F.struct(*rows.columns)
    # a batch is stamped with one second: what the row holds decides among equal stamps
    ties = [c for c in ("run_id", "row_hash", "probability") if c in rows.columns and c not in order]
    first = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min_by(whole, F.struct(*order, *ties)).alias("_r"))
    return first.select("_r.*")


def new_predictions(batch: DataFrame, existing: DataFrame, order: Sequence[str] = ("logged_at",), keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of the batch that the ledger does not hold yet; a row without a full key is always new."""
    keyed = _first_copies(batch.where(_complete(keys)), order, keys)
    fresh = keyed.join(existing.select(*keys), list(keys), "left_anti")
    return fresh.select(*batch.columns).unionByName(batch.where(~_complete(keys)))


def dedupe(rows: DataFrame, order: Sequence[str] = ("logged_at",), keys: Sequence[str] = KEY) -> DataFrame:
    """One row per key, the first logged; rows without a full key all stay."""
    kept = _first_copies(rows.where(_complete(keys)), order, keys)
    return kept.select(*rows.columns).unionByName(rows.where(~_complete(keys)))


def append(batch: DataFrame, path: str, schema: str | None = None, order: Sequence[str] = ("logged_at",)) -> None:
    """Append only what is new to the store at ``path``; also the body of a streaming ``foreachBatch``."""
    from .store import STORED, LedgerStore

    LedgerStore(batch.sparkSession, path, schema or STORED).append(batch, order=order)


def stats(rows: DataFrame) -> DataFrame:
    return dedupe(rows).agg(
        F.count(F.lit(1)).alias("rows_total"), F.min("anchor").alias("first_anchor"), F.max("anchor").alias("last_anchor"),
        F.countDistinct("run_id").alias("n_runs"))


def pending(predictions: DataFrame, realizations: DataFrame, superseded: DataFrame) -> DataFrame:
    """Predictions still to be graded: not retired, and not realised under the four- or three-part key."""
    live = dedupe(predictions).join(superseded.select("model_id"), "model_id", "left_anti")
    done = realizations.where(F.col("model_id").isNotNull()).select(*KEY)
    legacy = realizations.where(F.col("model_id").isNull()).select(*KEY[:3])
    return live.join(done, KEY, "left_anti").join(legacy, KEY[:3], "left_anti").select(*predictions.columns)


def matured(rows: DataFrame, today: Column, months: int = 12 * K.FORWARD_YEARS) -> DataFrame:
    return rows.withColumn("is_matured", F.add_months(F.col("anchor").cast("date"), months) <= today)


def realize(due: DataFrame, nav: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Grade matured predictions against the cohort frozen with each of them.

    Rows carry ``cohort_codes``, or ``cohort_id`` with ``members`` (cohort_id, fund_id) beside them and
    perhaps ``cohort_added``, a scored fund that joins the members for its own row.  Members of one cohort
    froze the same list, so each distinct (anchor, cohort) is graded once, not once per member, and an
    added fund needs four order statistics of it.
    """
    rows = due.withColumn("_a", F.col("anchor").cast("date"))
    if members is None:
        rows = rows.withColumn("cohort_id", cohorts.id_of_codes("cohort_codes"))
        lists = rows.groupBy("_a", "cohort_id").agg(F.any_value("cohort_codes").alias("codes"))
        known = lists.select("_a", "cohort_id", F.explode("codes").alias("fund_id"))
    else:
        known = rows.select("_a", "cohort_id").distinct().join(members.select("cohort_id", "fund_id").distinct(), "cohort_id").select("_a", "cohort_id", "fund_id")
    added = F.col("cohort_added").isNotNull() if "cohort_added" in due.columns else F.lit(False)
    asked = known.select("fund_id", F.col("_a").alias("anchor")).unionByName(rows.select("fund_id", F.col("_a").alias("anchor"))).distinct()
    fwd = forward_returns(nav, asked, "fund_id", "nav").select("fund_id", F.col("anchor").alias("_a"), "r_fwd")
    peer = group_quantile_with_one_more(known.join(fwd, ["fund_id", "_a"]), ["_a", "cohort_id"], "r_fwd", 0.75, "q75")
    graded = rows.join(fwd, ["fund_id", "_a"], "left").join(peer, ["_a", "cohort_id"], "left")
    joins = added & F.col("r_fwd").isNotNull()
    n = F.coalesce("n", F.lit(0)) + joins.cast("int")
    bar = F.when(joins, F.coalesce(one_more(F.col("q75_more"), F.col("r_fwd")), F.col("r_fwd"))).otherwise(F.col("q75"))
    status = F.when(F.col("r_fwd").isNull(), "DEAD_OR_GAP").when(n < K.COHORT_MIN_SIZE, "THIN_AT_REALIZATION").otherwise("REALIZED")
    return graded.select(
        "fund_id", "target", "anchor", "model_id", status.alias("status"), F.when(status == "REALIZED", F.col("r_fwd") >= bar).alias("y_realized"),
        F.col("r_fwd").alias("own_r_fwd"), n.cast("int").alias("n_peer_r_fwd"), "probability", "cohort_percentile")


def realize_matured(predictions: DataFrame, realizations: DataFrame, superseded: DataFrame, nav: DataFrame, today: Column,
                    members: DataFrame | None = None) -> DataFrame:
    open_rows = matured(pending(predictions, realizations, superseded), today)
    return realize(open_rows.where("is_matured").drop("is_matured"), nav, members)


def current_model(predictions: DataFrame, superseded: DataFrame) -> DataFrame:
    """One row: the model of the newest run that is not retired."""
    live = predictions.join(superseded.select("model_id"), "model_id", "left_anti")
    return live.agg(F.max_by("model_id", F.struct(F.coalesce("run_id", F.lit("")), "model_id")).alias("model_id"))


def realized_summary(realizations: DataFrame, predictions: DataFrame, superseded: DataFrame) -> DataFrame:
    """Counts per status, rank correlation and maturity of the current model, as one row."""
    model = current_model(predictions, superseded)
    rows = realizations.join(model, "model_id", "left_semi")
    done = rows.where("status = 'REALIZED'").select("probability", F.col("y_realized").cast("double").alias("y"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_matured"), F.count_if(F.col("status") == "REALIZED").alias("n_realized"),
        F.count_if(F.col("status") == "DEAD_OR_GAP").alias("n_dead_or_gap"), F.count_if(F.col("status") == "THIN_AT_REALIZATION").alias("n_thin"))
    ic = spearman(done, "probability", "y", "ic").select("ic")
    first = predictions.join(model, "model_id", "left_semi").agg(F.add_months(F.min(F.col("anchor").cast("date")), 36).alias("earliest_maturity"))
    joined = counts.withColumn("_ic", ic.scalar()).withColumn("earliest_maturity", first.scalar()).withColumn("model_id", model.scalar())
    status = F.when(F.col("n_matured") == 0, "PENDING_MATURITY").when(F.col("n_realized") < K.MIN_MATURED_FOR_IC, "INSUFFICIENT_MATURED").otherwise("OK")
    return joined.select(
        status.alias("status"), F.when(status == "OK", F.round("_ic", 4)).alias("value"), "n_matured", "n_realized", "n_dead_or_gap", "n_thin",
        F.round(F.col("n_realized") / K.EFFECTIVE_N_DIVISOR).cast("bigint").alias("effective_n"), "earliest_maturity", "model_id")


def outcome_metrics(realizations: DataFrame, summary: DataFrame) -> DataFrame:
    """Base rate, top-tier precision, lift and calibration gap, only when the summary is OK."""
    done = realizations.join(summary.where("status = 'OK'").select("model_id"), "model_id", "left_semi").where("status = 'REALIZED'")
    y = F.col("y_realized").cast("double")
    got = done.agg(F.avg(y).alias("b"), F.avg(F.when(F.col("cohort_percentile") >= K.TOP_TIER_PERCENTILE, y)).alias("p"), F.avg("probability").alias("m"))
    one = got.agg(F.any_value(F.struct("b", "p", "m"))).scalar()
    out = summary.withColumn("_o", one)
    b, p, m = (F.col(f"_o.{c}") for c in ("b", "p", "m"))
    return out.select(
        *summary.columns, F.round(b, 4).alias("base_rate"), F.round(p, 4).alias("precision_top"),
        F.round(F.when((p > 0) & (b > 0), p / F.when(b > 0, b)), 3).alias("lift"), F.round(F.abs(m - b), 4).alias("calibration_gap"))


def previous_run(rows: DataFrame, run_id: str, model_id: Column | str | None = None) -> DataFrame:
    """Rows of the newest other run of the same model."""
    same = rows if model_id is None else rows.where(F.col("model_id") == model_id)
    others = same.where(F.col("run_id") != run_id)
    return others.join(others.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi").select(*rows.columns)


def rank_stability(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Spearman of the probabilities two runs share, as one row with a status."""
    keys = ["fund_id", "target", "_m"]
    now = current.select("fund_id", "target", F.coalesce("model_id", F.lit("")).alias("_m"), F.col("probability").alias("p1"))
    then = previous.select("fund_id", "target", F.coalesce("model_id", F.lit("")).alias("_m"), F.col("probability").alias("p0"), *[F.col(c) for c in ("logged_at", "row_hash") if c in previous.columns])
    last = F.struct(*[c for c in ("logged_at", "row_hash") if c in then.columns], "p0")
    then = then.groupBy(*keys).agg(F.max_by("p0", last).alias("p0"))  # one score per key, the last logged
    got = spearman(now.join(then, keys), "p1", "p0", "_s")
    seen = previous.agg(F.count(F.lit(1)).alias("_prev"), F.max("run_id").alias("prev_run_id"))
    both = got.withColumn("_p", seen.agg(F.any_value(F.struct("_prev", "prev_run_id"))).scalar())
    status = F.when(F.col("_p._prev") == 0, "FIRST_RUN").when(F.col("n") < K.MIN_COMMON_FOR_STABILITY, "INSUFFICIENT_OVERLAP").otherwise("OK")
    return both.select(status.alias("status"), F.when(status == "OK", F.round("_s", 4)).alias("spearman"), F.col("n").alias("n_common"),
                       F.col("_p.prev_run_id").alias("prev_run_id"))
