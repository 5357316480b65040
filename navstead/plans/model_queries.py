"""Folds, evaluation metrics, preprocessing, fitting, inference, factor backtest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ranking import auc
from ..operators import batchfit, cv, evaluation, factors, inference, isotonic, model
from ..session import shared_folder, stored
from ..sources import scans
from . import fixtures as X
from . import panel_queries as P
from .oracle import define, r6, sql
from .registry import query, rounded

BLOCKS, START, HORIZON = X.DERIVED_BLOCKS, "1996-01-31", P.SHORT_MONTHS  # as far as the labels look
TRAIN_END, TEST = "1997-06-30", ("1998-03-31", "1998-10-31")
USED = tuple(K.FEATURES)


@stored
def training(spark, sf):
    """Labels with cohort targets beside the feature panel."""
    return scans.join_training(P.panel(spark, sf), P.short_cohort_rows(spark, sf), START)


_feats = ", ".join(f"p.{c}" for c in K.FEATURES)
define("train", f"SELECT l.*, {_feats} FROM short_labc l JOIN panel p USING (fund_id, anchor)", "short_labc", "panel")
_num = ", ".join(f"{r6(c)} {c}" for c in ("r_fwd", "cagr_1y", "vol_1y", "rank_3y", "z_cagr_1y"))


@query("feature_label_join", sql(f"SELECT fund_id, anchor, gkey, y, y_cohort_q1, y_cohort_top_half, {_num} FROM train WHERE y_cohort_q1 IS NOT NULL", "train"))
def _(spark, sf):
    out = scans.join_training(P.panel(spark, sf), P.short_cohort_rows(spark, sf), START, cohort_only=True)
    return rounded(out.select("fund_id", "anchor", "gkey", "y", "y_cohort_q1", "y_cohort_top_half", "r_fwd", "cagr_1y", "vol_1y", "rank_3y", "z_cagr_1y"))


# --- folds -------------------------------------------------------------------------------
_vals = ", ".join(f"('{b}', DATE '{s}', DATE '{e}')" for b, s, e in BLOCKS)
_purged = "(CAST(anchor + INTERVAL {h} MONTH AS DATE) < {s} OR anchor > CAST(CAST({e} + INTERVAL {h} MONTH AS DATE) + INTERVAL 1 MONTH AS DATE))"


def purge(s: str, e: str, h: int = HORIZON) -> str:
    return _purged.format(h=h, s=s, e=e)


define("folds", f"""
  SELECT l.fund_id, l.anchor, b.block, CASE WHEN anchor BETWEEN s AND e THEN 'test' ELSE 'train' END role
  FROM short_lab l, (VALUES {_vals}) b(block, s, e) WHERE anchor BETWEEN s AND e OR {purge('s', 'e')}""", "short_lab")


def keys(spark, sf):
    return P.short_label_rows(spark, sf).select("fund_id", "anchor")


@query("purged_fold_roles", sql("SELECT * FROM folds", "folds"))
def _(spark, sf):
    return cv.fold_roles(keys(spark, sf), BLOCKS, START, HORIZON)


@query("fold_block_tags", sql(f"""
  SELECT fund_id, anchor, (SELECT block FROM (VALUES {_vals}) b(block, s, e) WHERE anchor BETWEEN s AND e) block FROM pairs""", "pairs"))
def _(spark, sf):
    return X.fund_anchors(spark, sf).withColumn("block", cv.block_of(F.col("anchor"), BLOCKS))


@query("purge_survivors", sql(f"""
  SELECT fund_id, anchor, {purge("DATE '1997-07-31'", "DATE '1998-02-28'", 6)} survives FROM pairs""", "pairs"))
def _(spark, sf):
    _, start, end = BLOCKS[3]
    return X.fund_anchors(spark, sf).withColumn("survives", cv.survives(F.col("anchor"), start, end, 6))


@query("causal_holdout_roles", sql(f"""
  SELECT fund_id, anchor, CASE WHEN anchor BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}' THEN 'test' ELSE 'train' END role FROM short_lab
  WHERE anchor BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}' OR (anchor <= DATE '{TRAIN_END}' AND {purge(f"DATE '{TEST[0]}'", f"DATE '{TEST[1]}'")})""", "short_lab"))
def _(spark, sf):
    return cv.holdout_roles(keys(spark, sf), TRAIN_END, TEST, START, HORIZON)


@query("purged_validation_roles", sql(f"""
  SELECT fund_id, anchor, 'train' role, block, CASE WHEN anchor BETWEEN DATE '1996-07-31' AND DATE '1996-12-31' THEN 'val' ELSE 'train' END val_role FROM folds
  WHERE role = 'train' AND (anchor BETWEEN DATE '1996-07-31' AND DATE '1996-12-31' OR {purge("DATE '1996-07-31'", "DATE '1996-12-31'")})""", "folds"))
def _(spark, sf):
    train = cv.fold_roles(keys(spark, sf), BLOCKS, START, HORIZON).where("role = 'train'")
    return cv.validation_roles(train, BLOCKS[1], HORIZON)


@query("calibration_split", sql("""
  WITH m AS (SELECT block, LIST(DISTINCT anchor ORDER BY anchor) a FROM folds WHERE role = 'train' GROUP BY 1),
  c AS (SELECT block, CASE WHEN len(a) > 4 THEN a[CAST(ceil(len(a)*0.75) AS INTEGER) + 1] ELSE a[-1] END cut FROM m)
  SELECT fund_id, anchor, block, role, CASE WHEN anchor >= cut THEN 'calib' ELSE 'fit' END fit_role FROM folds JOIN c USING (block) WHERE role = 'train'""", "folds"))
def _(spark, sf):
    train = cv.fold_roles(keys(spark, sf), BLOCKS, START, HORIZON).where("role = 'train'")
    return cv.calibration_roles(train, ["block"])


# --- evaluation --------------------------------------------------------------------------
define("scored", f"""
  SELECT fund_id, anchor, gkey, y_cohort_q1 y, cond_a, cond_b, y yy, p, round(0.1 + 0.8*p, 6) p_cal, (SELECT block FROM (VALUES {_vals}) b(block, s, e) WHERE anchor BETWEEN s AND e) block
  FROM (SELECT *, round(1/(1 + exp(-(2*COALESCE(rank_3y, 0.5) - 1 + 5*COALESCE(round(excess_1y, 9), 0)))), 6) p FROM train WHERE y_cohort_q1 IS NOT NULL)""", "train")


@stored
def scored(spark, sf):
    """A fixed score of two features on every labelled row."""
    z = 2 * F.coalesce("rank_3y", F.lit(0.5)) - 1 + 5 * F.coalesce(F.round("excess_1y", 9), F.lit(0.0))
    p = F.round(F.lit(1.0) / (1 + F.exp(-z)), 6)
    rows = training(spark, sf).where(F.col("y_cohort_q1").isNotNull())
    return rows.select("fund_id", "anchor", "gkey", F.col("y_cohort_q1").alias("y"), "cond_a", "cond_b", F.col("y").alias("yy"), p.alias("p"),
                       F.round(0.1 + 0.8 * p, 6).alias("p_cal"), cv.block_of(F.col("anchor"), BLOCKS).alias("block"))


def auc_sql(src: str, keys: str, score: str = "p", label: str = "y") -> str:
    part = f"PARTITION BY {keys}"
    return f"""
  SELECT {keys}, CASE WHEN MAX(np)*MAX(nn) > 0 THEN (SUM(rk) FILTER (lab) - MAX(np)*(MAX(np) + 1)/2.0::DOUBLE)/(MAX(np)*MAX(nn)) END a FROM (
    SELECT {keys}, {label} lab, RANK() OVER ({part} ORDER BY {score}) + (COUNT(*) OVER ({part}, {score}) - 1)/2.0::DOUBLE rk,
      COUNT(*) FILTER ({label}) OVER ({part}) np, COUNT(*) FILTER (NOT {label}) OVER ({part}) nn FROM {src}) GROUP BY {keys}"""


define("auc_block", auc_sql("scored", "block"), "scored")
define("auc_anchor", auc_sql("scored", "block, anchor"), "scored")
define("dec", """
  SELECT *, pos <= k is_top, pos > n - k is_bottom FROM (SELECT *, GREATEST(1, CAST(floor(n*0.1::DOUBLE) AS BIGINT)) k FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY block, anchor ORDER BY p DESC, fund_id) pos, COUNT(*) OVER (PARTITION BY block, anchor) n FROM scored))""", "scored")
define("dec_stats", """
  SELECT block, COUNT(*) FILTER (is_top AND y)/CAST(COUNT(*) FILTER (is_top) AS DOUBLE) tdp, COUNT(*) FILTER (is_bottom AND NOT y)/CAST(COUNT(*) FILTER (NOT y) AS DOUBLE) bnc,
    COUNT(*) FILTER (is_top) n_top, COUNT(*) FILTER (is_bottom) n_bottom, COUNT(*) FILTER (NOT y) total_negatives FROM dec GROUP BY 1""", "dec")


@query("pooled_auc", sql(f"SELECT block, {r6('a')} pooled_auc FROM auc_block", "auc_block"))
def _(spark, sf):
    return rounded(evaluation.pooled_auc(scored(spark, sf), ["block"]))


@query("price_auc_by_status", sql(f"SELECT l_linestatus, {r6('a')} auc FROM ({auc_sql('src', 'l_linestatus', 'l_extendedprice', 'r')})".replace(
    "FROM src", "FROM (SELECT l_linestatus, l_extendedprice, l_returnflag = 'R' r FROM lineitem)")))
def _(spark, sf):
    rows = X.table(spark, sf, "lineitem").select("l_linestatus", "l_extendedprice", (F.col("l_returnflag") == "R").alias("r"))
    return rounded(auc(rows, ["l_linestatus"], "l_extendedprice", "r"))


@query("anchor_rank_auc", sql(f"SELECT block, {r6('AVG(a)')} rank_auc, COUNT(a) rank_auc_cohorts FROM auc_anchor GROUP BY 1", "auc_anchor"))
def _(spark, sf):
    return rounded(evaluation.anchor_rank_auc(scored(spark, sf), ["block"]))


@query("decile_stats", sql(
    f"SELECT block, {r6('tdp')} top_decile_precision, {r6('bnc')} bottom_decile_neg_capture, n_top, n_bottom, total_negatives FROM dec_stats", "dec_stats"))
def _(spark, sf):
    return rounded(evaluation.decile_stats(scored(spark, sf), ["block"]))


@query("decile_members", sql("SELECT fund_id, anchor, block, is_top, is_bottom FROM dec", "dec"))
def _(spark, sf):
    return evaluation.decile_members(scored(spark, sf), ["block"]).select("fund_id", "anchor", "block", "is_top", "is_bottom")


@query("reliability_table", sql(f"""
  SELECT block, CAST(LEAST(floor(p_cal*10), 9) AS INTEGER) bin, COUNT(*) n, {r6('AVG(p_cal)')} mean_p, {r6('AVG(CAST(y AS INTEGER))')} frac_pos FROM scored GROUP BY 1, 2""", "scored"))
def _(spark, sf):
    return rounded(evaluation.reliability_table(scored(spark, sf), ["block"], "p_cal"))


define("bmet", """
  SELECT b.*, a.a pooled_auc, r.rank_auc, r.rank_auc_cohorts, d.tdp top_decile_precision, d.bnc bottom_decile_neg_capture, d.tdp/b.base_rate lift_over_base
  FROM (SELECT block, COUNT(*) n, CAST(round(COUNT(*)/30.0::DOUBLE) AS BIGINT) effective_n, AVG(CAST(y AS INTEGER)) base_rate, COUNT(*) FILTER (NOT y) negatives,
          AVG(CASE WHEN p_cal >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (y) recall_at_05, AVG(POWER(p_cal - CAST(y AS INTEGER), 2)) brier FROM scored GROUP BY 1) b
  LEFT JOIN auc_block a USING (block) LEFT JOIN (SELECT block, AVG(a) rank_auc, COUNT(a) rank_auc_cohorts FROM auc_anchor GROUP BY 1) r USING (block)
  LEFT JOIN dec_stats d USING (block)""", "scored", "auc_block", "auc_anchor", "dec_stats")
MET = ("base_rate", "recall_at_05", "brier", "pooled_auc", "rank_auc", "top_decile_precision", "bottom_decile_neg_capture", "lift_over_base")
_met = ", ".join(f"{r6(c)} {c}" for c in MET)


@query("block_metrics", sql(f"SELECT block, n, effective_n, negatives, rank_auc_cohorts, {_met} FROM bmet", "bmet"))
def _(spark, sf):
    return rounded(evaluation.block_metrics(scored(spark, sf), ["block"]))


HEADS = ("pooled_auc", "rank_auc", "top_decile_precision", "lift_over_base", "bottom_decile_neg_capture")


@query("holdout_evaluated_once", sql(f"SELECT block, n, {r6('pooled_auc')} pooled_auc, 1 n_stamps, 1 n_computed FROM bmet WHERE block = 'B5'", "bmet"))
def _(spark, sf):
    """Three drivers ask for the verdict on the last block; one computes it, the others read it."""
    path, computed = f"{shared_folder(spark)}/holdout-{uuid.uuid4().hex}", []

    def compute():
        computed.append(1)
        return evaluation.block_metrics(scored(spark, sf).where(F.col("block") == "B5"), ["block"]).select("block", "n", "pooled_auc")

    seen = [model.evaluate_once(spark, path, compute) for _ in range(3)]
    every = seen[0].union(seen[1]).union(seen[2])
    return rounded(every.groupBy("block", "n", "pooled_auc").agg(F.countDistinct("stamp_owner").cast("int").alias("n_stamps")).withColumn("n_computed", F.lit(len(computed))))


@query("mean_over_folds", sql("SELECT 'fixed' model, " + ", ".join(f"{r6(f'AVG({c})')} mean_{c}" for c in HEADS) + " FROM bmet", "bmet"))
def _(spark, sf):
    met = evaluation.block_metrics(scored(spark, sf), ["block"]).withColumn("model", F.lit("fixed"))
    return rounded(evaluation.mean_over_folds(met, ["model"]))


@query("label_leg_deciles", sql("""
  WITH d AS (SELECT anchor, cond_a, cond_b, yy, UNNEST(list_filter([CASE WHEN is_top THEN 'top' END, CASE WHEN is_bottom THEN 'bottom' END], lambda x: x IS NOT NULL)) which FROM dec),
  a AS (SELECT anchor, which, AVG(CAST(cond_a AS INTEGER)) a, AVG(CAST(cond_b AS INTEGER)) b, AVG(CAST(yy AS INTEGER)) c FROM d GROUP BY 1, 2)
  SELECT which, """ + f"{r6('AVG(a)')} cond_a, {r6('AVG(b)')} cond_b, {r6('AVG(c)')} yy FROM a GROUP BY 1", "dec"))
def _(spark, sf):
    return rounded(evaluation.leg_table(scored(spark, sf), ["cond_a", "cond_b", "yy"]))


@query("challenger_verdict", sql(f"""
  WITH c AS (SELECT AVG(pooled_auc) m FROM bmet), u AS (SELECT CAST(fund_id AS BIGINT) % 7 c, y, block FROM scored),
  t AS (SELECT AVG(a) m FROM ({auc_sql('v', 'block', 'c', 'y')})), v AS (SELECT c, y, block FROM u)
  SELECT 'q1' target, {r6('t.m - c.m')} cv_gain, {r6('t.m - c.m')} holdout_gain, t.m - c.m > 0.03 adopt FROM c, t""".replace(
      "t AS (SELECT AVG(a)", "v AS (SELECT c, y, block FROM u), t AS (SELECT AVG(a)").replace(", v AS (SELECT c, y, block FROM u)\n", "\n"), "bmet", "scored"))
def _(spark, sf):
    rows = scored(spark, sf)
    rival = rows.withColumn("p", (F.col("fund_id").cast("bigint") % 7).cast("double"))
    both = rows.withColumn("model", F.lit("enet")).unionByName(rival.withColumn("model", F.lit("trees")))
    aucs = evaluation.pooled_auc(both, ["model", "block"]).withColumn("target", F.lit("q1"))
    means = aucs.groupBy("target", "model").agg(F.avg("pooled_auc").alias("mean_pooled_auc"))
    return rounded(evaluation.challenger_verdict(means, means.withColumnRenamed("mean_pooled_auc", "pooled_auc")))


# --- preprocessing, inference, fitting ---------------------------------------------------
_long = " UNION ALL ".join(f"SELECT '{f}' feature, {f} v FROM train" for f in USED)
define("prep", f"""
  WITH l AS ({_long}), m AS (SELECT feature, COALESCE(MEDIAN(v), 0) median FROM l GROUP BY 1), i AS (SELECT feature, COALESCE(v, median) v FROM l JOIN m USING (feature))
  SELECT feature, median, mean, CASE WHEN sd > 1e-9 THEN sd ELSE 1.0::DOUBLE END std FROM m JOIN (SELECT feature, AVG(v) mean, STDDEV_SAMP(v) sd FROM i GROUP BY 1) USING (feature)""", "train")


@query("preprocessor_stats", sql(f"SELECT feature, {r6('median')} median, {r6('mean')} mean, {r6('std')} std FROM prep", "prep"))
def _(spark, sf):
    return rounded(model.feature_stats(training(spark, sf), USED).drop("n_distinct"))


# A small stored model for scoring checks.
COEF = {"cagr_1y": 0.4, "vol_1y": -0.3, "mom_6m": 0.2, "excess_1y": 0.5, "is_thematic": -0.1}
MED = {"cagr_1y": 0.08, "vol_1y": 0.08, "mom_6m": 0.04, "excess_1y": 0.0, "is_thematic": 0.0}
MEAN = {"cagr_1y": 0.07, "vol_1y": 0.09, "mom_6m": 0.03, "excess_1y": 0.01, "is_thematic": 0.4}
SD = {"cagr_1y": 0.05, "vol_1y": 0.01, "mom_6m": 0.04, "excess_1y": 0.06, "is_thematic": 0.5}
KNOTS = ([0.2, 0.4, 0.6, 0.8], [0.1, 0.25, 0.3, 0.7])


def small_model(spark):
    numbers = "map<string,double>"
    shape = (
        f"model_id string, target string, signal_context struct<holdout_auc:double,base_rate:double>, imputation_medians {numbers}, standardize_mean {numbers}, "
        f"standardize_std {numbers}, coefficients {numbers}, intercept double, calibration struct<kind:string,x:array<double>,y:array<double>,coef:double,intercept:double>")
    return spark.createDataFrame([
        ("m1", "cohort_q1", (0.54, 0.28), MED, MEAN, SD, COEF, -0.2, ("isotonic", KNOTS[0], KNOTS[1], None, None)),
        ("m1", "cohort_top_half", (0.51, 0.48), MED, MEAN, SD, COEF, 0.1, ("platt", None, None, 0.9, -0.05))], shape)


_dot = " + ".join(f"{COEF[f]}::DOUBLE*(COALESCE({f}, {MED[f]}::DOUBLE) - {MEAN[f]}::DOUBLE)/{SD[f]}::DOUBLE" for f in COEF)
define("infer", f"""
  WITH z AS (SELECT fund_id, anchor, gkey, {_dot} d FROM panel),
  q AS (SELECT fund_id, anchor, gkey, 'cohort_q1' target, 1/(1 + exp(-(d - 0.2::DOUBLE))) p FROM z UNION ALL SELECT fund_id, anchor, gkey, 'cohort_top_half', 1/(1 + exp(-(d + 0.1::DOUBLE))) FROM z)
  SELECT *, CASE WHEN target = 'cohort_top_half' THEN 1/(1 + exp(-(0.9::DOUBLE*ln(p/(1 - p)) - 0.05::DOUBLE)))
    WHEN p < 0.2 THEN 0.1::DOUBLE WHEN p < 0.4 THEN 0.1::DOUBLE + 0.15::DOUBLE*(p - 0.2::DOUBLE)/0.2::DOUBLE WHEN p < 0.6 THEN 0.25::DOUBLE + 0.05::DOUBLE*(p - 0.4::DOUBLE)/0.2::DOUBLE
    WHEN p < 0.8 THEN 0.3::DOUBLE + 0.4::DOUBLE*(p - 0.6::DOUBLE)/0.2::DOUBLE ELSE 0.7::DOUBLE END probability FROM q""", "panel")


@query("batch_inference", sql(f"SELECT fund_id, anchor, target, {r6('p')} p_raw, {r6('probability')} probability FROM infer", "infer"))
def _(spark, sf):
    out = inference.score(P.panel(spark, sf), small_model(spark), list(COEF))
    return rounded(out.select("fund_id", "anchor", "target", "p_raw", "probability"))


@query("imputed_feature_counts", sql("""
  SELECT fund_id, anchor, """ + " + ".join(f"CAST({f} IS NULL AS INTEGER)" for f in K.FEATURES) + " n_imputed FROM panel", "panel"))
def _(spark, sf):
    return P.panel(spark, sf).select("fund_id", "anchor", F.size(inference.imputed(K.FEATURES)).alias("n_imputed"))


@query("logistic_transforms", sql(f"""
  SELECT l_orderkey, l_linenumber, {r6('ln(d/(1 - d))')} lo, {r6('1/(1 + exp(-ln(d/(1 - d))))')} back FROM (SELECT l_orderkey, l_linenumber, LEAST(GREATEST(l_discount*8, 1e-6), 1 - 1e-6) d FROM lineitem)"""))
def _(spark, sf):
    from ..functions.numeric import logit, sigmoid
    lo = logit(F.col("l_discount") * 8)
    return rounded(X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", lo.alias("lo"), sigmoid(lo).alias("back")))


FITTED = tuple(K.FEATURES)


@query("elastic_net_folds")
def _(spark, sf):
    runs = [("cohort_q1", "y_cohort_q1", "enet", K.ELASTIC_NET)]
    preds = model.run_folds(training(spark, sf), FITTED, runs, BLOCKS, START, HORIZON)
    return rounded(evaluation.block_metrics(preds, ["target", "model", "block"]))


TARGETS = {"or_label": "y", "cond_a": "cond_a", "cond_b": "cond_b", "cohort_q1": "y_cohort_q1", "cohort_top_half": "y_cohort_top_half"}
_each = " UNION ALL ".join(f"SELECT '{name}' target, block, COUNT({c}) n, COUNT(*) FILTER ({c}) positives FROM u GROUP BY block" for name, c in TARGETS.items())


# A fit has no value in SQL, but its optimum has a condition: zero lies in the subgradient of the penalised loss.
@query("fold_fit_optimality", sql(f"""
  WITH m AS (SELECT block, LIST(DISTINCT anchor ORDER BY anchor) a FROM folds WHERE role = 'train' GROUP BY 1),
  c AS (SELECT block, CASE WHEN len(a) > 4 THEN a[CAST(ceil(len(a)*0.75) AS INTEGER) + 1] ELSE a[-1] END cut FROM m),
  u AS (SELECT f.block, t.* FROM folds f JOIN c USING (block) JOIN train t USING (fund_id, anchor) WHERE f.role = 'train' AND f.anchor < c.cut)
  SELECT target, block, n, positives, positives BETWEEN 1 AND n - 1 optimal FROM ({_each})""", "folds", "train"))
def _(spark, sf):
    """All five targets on all folds, fitted together."""
    rows = training(spark, sf)
    fits, _ = model.fold_fits(rows, TARGETS, [K.ELASTIC_NET], BLOCKS, START, HORIZON)
    got = [(*f.fit.name.split("|")[::2], int(f.n), int(f.positives), f.violation <= batchfit.TOLERANCE) for f in batchfit.fit_all(rows, FITTED, fits)]
    return spark.createDataFrame(got, "target string, block string, n bigint, positives bigint, optimal boolean")


@query("fold_grid_auc")
def _(spark, sf):
    """Mean fold AUC of every target under every setting of the grid: reported, never selected from."""
    preds = model.shared_folds(training(spark, sf), FITTED, TARGETS, [K.ELASTIC_NET, *K.ELASTIC_NET_GRID], BLOCKS, START, HORIZON)
    aucs = evaluation.pooled_auc(preds, ["target", "setting", "block"])
    return rounded(aucs.groupBy("target", "setting").agg(F.avg("pooled_auc").alias("mean_pooled_auc"), F.count("pooled_auc").alias("n_folds")), 4)


HALVES = [y * 10 + h for y in (1996, 1997, 1998) for h in (0, 1)]  # of the derived anchors
_drawn = ", ".join(f"('r{i}', {h}, {k})" for i, d in enumerate(model.bootstrap_draws(HALVES, K.BOOTSTRAP_REPLICATES)) for h, k in d.items())


@query("bootstrap_fit_optimality", sql(f"""
  SELECT r replicate, CAST(SUM(k) AS BIGINT) n, CAST(SUM(CASE WHEN y_cohort_q1 THEN k ELSE 0 END) AS BIGINT) positives, TRUE optimal
  FROM train JOIN (VALUES {_drawn}) d(r, h, k) ON h = year(anchor)*10 + CAST(month(anchor) > 6 AS INTEGER) WHERE y_cohort_q1 IS NOT NULL GROUP BY 1""", "train"))
def _(spark, sf):
    rows = training(spark, sf)
    fitted = batchfit.fit_all(rows, FITTED, model.bootstrap_fits(rows, "y_cohort_q1"))
    got = [(f.fit.name, int(f.n), int(f.positives), f.violation <= batchfit.TOLERANCE) for f in fitted]
    return spark.createDataFrame(got, "replicate string, n bigint, positives bigint, optimal boolean")


@query("coefficient_sign_stability")
def _(spark, sf):
    return rounded(model.bootstrap_signs(training(spark, sf), FITTED, "y_cohort_q1"), 4)


@query("boosted_tree_holdout")
def _(spark, sf):
    roles = cv.holdout_roles(training(spark, sf), TRAIN_END, TEST, START, HORIZON)
    fold = model.run_fold(roles.where("role = 'train'"), roles.where("role = 'test'"), FITTED, "y_cohort_q1", "trees", dict(K.BOOSTED_TREES),
                          {"target": "cohort_q1", "model": "trees", "block": "HOLDOUT"})
    return rounded(fold.metrics)


# The greatest convex minorant of the cumulative counts, point by point, then the thin blocks one by one.
KNOTS_SQL = f"""
  WITH RECURSIVE c AS (
    SELECT ROW_NUMBER() OVER (ORDER BY p) i, p, SUM(n) OVER (ORDER BY p) n, SUM(y) OVER (ORDER BY p) y FROM (SELECT p, COUNT(*) n, COUNT(*) FILTER (y) y FROM scored GROUP BY p)),
  g AS (
    SELECT CAST(0 AS BIGINT) i, CAST(0 AS HUGEINT) n, CAST(0 AS HUGEINT) y
    UNION ALL SELECT i, n, y FROM (
      SELECT c.i, c.n, c.y, ROW_NUMBER() OVER (ORDER BY CAST(c.y - g.y AS DOUBLE)/CAST(c.n - g.n AS DOUBLE), c.i DESC) o FROM g JOIN c ON c.i > g.i) WHERE o = 1),
  k AS (SELECT p u, CAST(g.n - LAG(g.n) OVER (ORDER BY g.i) AS BIGINT) n, CAST(g.y - LAG(g.y) OVER (ORDER BY g.i) AS BIGINT) y, g.i FROM g LEFT JOIN c ON c.i = g.i),
  t AS (
    SELECT list({{'u': u, 'n': n, 'y': y}} ORDER BY i) b FROM k WHERE i > 0
    UNION ALL SELECT list_concat(list_concat(list_slice(b, 1, lo - 1), [{{'u': b[lo + 1].u, 'n': b[lo].n + b[lo + 1].n, 'y': b[lo].y + b[lo + 1].y}}]), list_slice(b, lo + 2, len(b))) FROM (
      SELECT b, CASE WHEN i = 1 THEN 1 WHEN i = len(b) OR b[i - 1].n <= b[i + 1].n THEN i - 1 ELSE i END lo FROM (
        SELECT b, list_position(ns, list_min(ns)) i FROM (SELECT b, list_transform(b, lambda z: z.n) ns FROM t) WHERE len(b) > 1 AND list_min(ns) < {K.CALIBRATION_MIN_BLOCK}))),
  f AS (SELECT arg_min(b, len(b)) b FROM t),
  r AS (SELECT i, b[i].u u, b[i].n n, b[i].y y, len(b) k, b[i].y/CAST(b[i].n AS DOUBLE) rate FROM (SELECT b, UNNEST(range(1, len(b) + 1)) i FROM f)),
  low AS (SELECT *, CASE WHEN i = 1 AND k > 1 AND y = 0 THEN LEAST(0.5::DOUBLE, 3.0::DOUBLE/n, CASE WHEN LEAD(rate) OVER (ORDER BY i) > 0 THEN LEAD(rate) OVER (ORDER BY i)/2 ELSE 1 END) ELSE rate END a FROM r),
  both_ends AS (SELECT *, CASE WHEN i = k AND k > 1 AND y = n THEN 1 - LEAST(0.5::DOUBLE, 3.0::DOUBLE/n, CASE WHEN LAG(a) OVER (ORDER BY i) < 1 THEN (1 - LAG(a) OVER (ORDER BY i))/2 ELSE 1 END) ELSE a END e FROM low)
  SELECT 'isotonic' kind, {r6('u')} x, {r6('e')} y, n support FROM both_ends"""


@query("calibration_knots", sql(KNOTS_SQL, "scored"))
def _(spark, sf):
    got = model.fit_calibration(scored(spark, sf).select("p", "y"), "p", "y")
    rows = list(zip(got.x, got.y, got.support)) or [(got.coef, got.intercept, 0)]
    return rounded(spark.createDataFrame([(got.kind, float(a), float(b), int(n)) for a, b, n in rows], "kind string, x double, y double, support bigint"))


# Fitted value of a score: the largest over starts of the smallest over ends of the mean outcome between them.
@query("isotonic_blocks_by_discount", sql("""
  WITH c AS (SELECT l_discount p, COUNT(*) n, COUNT(*) FILTER (l_returnflag = 'R') y FROM lineitem GROUP BY 1),
  m AS (SELECT x.p v, a.p, b.p q, SUM(z.y)/CAST(SUM(z.n) AS DOUBLE) r FROM c x JOIN c a ON a.p <= x.p JOIN c b ON b.p >= x.p JOIN c z ON z.p BETWEEN a.p AND b.p GROUP BY 1, 2, 3),
  f AS (SELECT v, MAX(lowest) fit FROM (SELECT v, p, MIN(r) lowest FROM m GROUP BY 1, 2) GROUP BY 1)
  SELECT """ + f"{r6('MIN(v)')} lower, {r6('MAX(v)')} upper, CAST(SUM(n) AS BIGINT) n, CAST(SUM(y) AS BIGINT) positives FROM f JOIN c ON c.p = f.v GROUP BY fit"))
def _(spark, sf):
    rows = X.table(spark, sf, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").alias("y"))
    return rounded(isotonic.isotonic_blocks(rows, "l_discount", "y"))


@query("coefficient_ranking")
def _(spark, sf):
    return rounded(model.top_coefficients(model.coefficients(training(spark, sf), FITTED, "y_cohort_q1")))


@query("stored_model_artifact")
def _(spark, sf):
    out = model.model_artifact(training(spark, sf), FITTED, {"cohort_q1": "y_cohort_q1"}, "derived_v1")
    return out.select("model_id", "target", F.size("features").alias("n_features"), F.size("coefficients").alias("n_coefficients"), "calibration.kind")


# --- factor backtest ---------------------------------------------------------------------
DEFAULT_WEIGHTS = {m: w for m, (w, _) in K.FACTOR_MAP["Equity"].items()}
_live = {m: w for m, w in DEFAULT_WEIGHTS.items() if m in K.FACTOR_TO_FEATURE}
_total = sum(_live.values())
_dirs = {m: d for m, (_, d) in K.FACTOR_MAP["Equity"].items()}
_pct = " + ".join(
    f"{w / _total!r}::DOUBLE*COALESCE(CASE WHEN x_{m} IS NOT NULL THEN (RANK() OVER (PARTITION BY anchor, gkey ORDER BY x_{m} NULLS LAST) + (COUNT(*) OVER (PARTITION BY anchor, gkey, x_{m}) - 1)/2.0::DOUBLE)"
    f"/COUNT(x_{m}) OVER (PARTITION BY anchor, gkey) END, 0.5::DOUBLE)" for m, w in _live.items())
define("fscore", f"""
  WITH t AS (SELECT fund_id, anchor, gkey, y_cohort_q1, {', '.join(f'{_dirs[m]}*round({K.FACTOR_TO_FEATURE[m]}, 9) x_{m}' for m in _live)} FROM train WHERE y_cohort_q1 IS NOT NULL),
  r AS (SELECT fund_id, anchor, gkey, y_cohort_q1, round({_pct}, 12) raw FROM t),
  b AS (SELECT *, MIN(raw) OVER (PARTITION BY anchor, gkey) lo, MAX(raw) OVER (PARTITION BY anchor, gkey) hi FROM r)
  SELECT fund_id, anchor, gkey, y_cohort_q1 y, round(round(1 + 99*CASE WHEN hi - lo > 1e-12 THEN (raw - lo)/(hi - lo) ELSE 0.5::DOUBLE END, 9), 1) p,
    (SELECT block FROM (VALUES {_vals}) b(block, s, e) WHERE anchor BETWEEN s AND e) block FROM b""", "train")


@stored
def factor_scores(spark, sf):
    rows = training(spark, sf).where(F.col("y_cohort_q1").isNotNull())
    used = rows.select("fund_id", "anchor", F.col("gkey").alias("cohort_key"), "y_cohort_q1",
                       *[F.round(c, 9).alias(c) for c in K.FACTOR_TO_FEATURE.values()])
    scores = factors.cohort_composite(used, DEFAULT_WEIGHTS)
    return scores.join(used.select("fund_id", "anchor", F.col("y_cohort_q1").alias("y")), ["fund_id", "anchor"])


@query("factor_composite", sql("SELECT fund_id, anchor, gkey cohort_key, y, p factor_score FROM fscore", "fscore"))
def _(spark, sf):
    return factor_scores(spark, sf)


define("fauc", auc_sql("fscore", "block"), "fscore")


@query("factor_backtest", sql(f"""
  WITH d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY block, anchor ORDER BY p DESC, fund_id) pos, COUNT(*) OVER (PARTITION BY block, anchor) n FROM fscore),
  k AS (SELECT *, GREATEST(1, CAST(floor(n*0.1::DOUBLE) AS BIGINT)) k FROM d)
  SELECT k.block, COUNT(*) n, {r6('AVG(CAST(y AS INTEGER))')} base_rate, COUNT(*) FILTER (NOT y) negatives, {r6('MAX(fauc.a)')} pooled_auc,
    {r6('COUNT(*) FILTER (pos <= k AND y)/CAST(COUNT(*) FILTER (pos <= k) AS DOUBLE)')} top_decile_precision FROM k JOIN fauc USING (block) GROUP BY 1""", "fscore", "fauc"))
def _(spark, sf):
    rows = factor_scores(spark, sf).withColumn("p", F.col("factor_score")).withColumn("block", cv.block_of(F.col("anchor"), BLOCKS))
    met = evaluation.block_metrics(rows, ["block"], "p", None)
    return rounded(met.select("block", "n", "base_rate", "negatives", "pooled_auc", "top_decile_precision"))
