"""Ledger, grading, monitoring, live scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import cohorts, inference, ledger, live, monitoring
from ..session import cut_lineage, stored
from . import fixtures as X
from . import model_queries as M
from . import panel_queries as P
from .oracle import define, r6, sql
from .registry import query, rounded

TODAY = "2001-06-30"
define("preds", """
  WITH b AS (
    SELECT fund_id, 'cohort_q1' target, CAST(anchor AS VARCHAR) anchor, CASE WHEN anchor < DATE '1997-01-01' THEN 'm1' WHEN CAST(fund_id AS BIGINT) % 11 = 0 THEN NULL ELSE 'm2' END model_id,
      'r' || strftime(anchor, '%Y%m') run_id, round(probability, 9) probability, gkey FROM infer WHERE target = 'cohort_q1'),
  c AS (SELECT gkey, LIST(fund_id ORDER BY fund_id) cohort_codes FROM gkeys GROUP BY 1)
  SELECT b.*, cohort_codes, anchor || 'T00:00:00' logged_at FROM b JOIN c USING (gkey)
  UNION ALL SELECT b.*, cohort_codes, anchor || 'T12:00:00' FROM b JOIN c USING (gkey) WHERE CAST(fund_id AS BIGINT) % 5 = 0""", "infer", "gkeys")


@stored
def predictions(spark, sf):
    """A fixed score of every fund at every anchor, its cohort by id; every fifth fund is logged twice."""
    scored = inference.score(P.panel(spark, sf), M.small_model(spark).where("target = 'cohort_q1'"), list(M.COEF))
    named = cohorts.cohort_ids(P.peers.with_group_key(X.manifest(spark, sf)), ["gkey"])
    key = F.col("fund_id").cast("bigint")
    model_id = F.when(F.col("anchor") < "1997-01-01", "m1").when(key % 11 != 0, "m2")
    base = scored.join(named, "gkey").select(
        "fund_id", F.col("target"), F.col("anchor").cast("string").alias("anchor"), model_id.alias("model_id"),
        F.concat(F.lit("r"), F.date_format("anchor", "yyyyMM")).alias("run_id"), F.round("probability", 9).alias("probability"), "gkey", "cohort_id",
        F.lit(None).cast("string").alias("cohort_added"))
    first = base.withColumn("logged_at", F.concat("anchor", F.lit("T00:00:00")))
    again = base.where(key % 5 == 0).withColumn("logged_at", F.concat("anchor", F.lit("T12:00:00")))
    return first.unionByName(again)


@stored
def cohort_members(spark, sf):
    """(cohort_id, fund_id), each member once: a list in every prediction would grow with the square of the funds."""
    funds = P.peers.with_group_key(X.manifest(spark, sf)).select("gkey", "fund_id")
    return funds.join(cohorts.cohort_ids(funds, ["gkey"]), "gkey").select("cohort_id", "fund_id")


SHOWN = ("fund_id", "target", "anchor", "model_id", "run_id", "logged_at")
define("dedup", """
  SELECT * FROM preds WHERE model_id IS NULL
  UNION ALL SELECT * FROM (SELECT * FROM preds WHERE model_id IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY fund_id, target, anchor, model_id ORDER BY logged_at) = 1)""", "preds")


@query("ledger_dedupe", sql(f"SELECT {', '.join(SHOWN)}, {r6('probability')} probability FROM dedup", "dedup"))
def _(spark, sf):
    return rounded(ledger.dedupe(predictions(spark, sf)).select(*SHOWN, "probability"))


@query("ledger_append_new", sql("""
  SELECT fund_id, target, anchor, model_id, logged_at FROM dedup WHERE anchor > '1998-03-31'
  UNION ALL SELECT fund_id, target, anchor, model_id, logged_at FROM dedup WHERE anchor BETWEEN '1998-01-31' AND '1998-03-31' AND model_id IS NULL""", "dedup"))
def _(spark, sf):
    rows = predictions(spark, sf)
    fresh = ledger.new_predictions(rows.where(F.col("anchor") >= "1998-01-31"), rows.where(F.col("anchor") <= "1998-03-31"))
    return fresh.select("fund_id", "target", "anchor", "model_id", "logged_at")


@query("ledger_stats", sql("""
  SELECT COUNT(*) rows_total, MIN(anchor) first_anchor, MAX(anchor) last_anchor, COUNT(DISTINCT run_id) n_runs FROM dedup""", "dedup"))
def _(spark, sf):
    return ledger.stats(predictions(spark, sf))


define("reals", """
  SELECT fund_id, 'cohort_q1' target, anchor, CASE WHEN CAST(fund_id AS BIGINT) % 4 = 0 THEN model_id END model_id FROM dedup
  WHERE CAST(fund_id AS BIGINT) % 4 < 2 AND anchor < '1997-09-01'""", "dedup")


def realized_before(spark, sf):
    key = F.col("fund_id").cast("bigint")
    rows = ledger.dedupe(predictions(spark, sf)).where((key % 4 < 2) & (F.col("anchor") < "1997-09-01"))
    return rows.select("fund_id", "target", "anchor", F.when(key % 4 == 0, F.col("model_id")).alias("model_id"))


def retired(spark, sf, model: str = "m1"):
    """Retired models: those whose last run is older than the newest year of runs."""
    return predictions(spark, sf).where(F.col("model_id") == model).select("model_id").distinct()


define("open_rows", f"""
  SELECT d.*, CAST(CAST(anchor AS DATE) + INTERVAL 36 MONTH AS DATE) <= DATE '{TODAY}' is_matured FROM dedup d WHERE COALESCE(model_id, '') <> 'm1'
    AND NOT EXISTS (SELECT 1 FROM reals r WHERE r.model_id IS NOT NULL AND r.fund_id = d.fund_id AND r.anchor = d.anchor AND r.model_id = d.model_id)
    AND NOT EXISTS (SELECT 1 FROM reals r WHERE r.model_id IS NULL AND r.fund_id = d.fund_id AND r.anchor = d.anchor)""", "dedup", "reals")


@query("ledger_pending_and_matured", sql("SELECT fund_id, target, anchor, model_id, is_matured FROM open_rows", "open_rows"))
def _(spark, sf):
    rows = ledger.pending(predictions(spark, sf), realized_before(spark, sf), retired(spark, sf))
    return ledger.matured(rows, F.lit(TODAY).cast("date")).select("fund_id", "target", "anchor", "model_id", "is_matured")


define("graded", """
  WITH q AS (SELECT anchor a, gkey, QUANTILE_CONT(r_fwd, 0.75) q75, COUNT(r_fwd) n FROM fwd JOIN gkeys USING (fund_id) GROUP BY 1, 2)
  SELECT o.fund_id, o.target, o.anchor, o.model_id, CASE WHEN f.r_fwd IS NULL THEN 'DEAD_OR_GAP' WHEN COALESCE(q.n, 0) < 4 THEN 'THIN_AT_REALIZATION' ELSE 'REALIZED' END status,
    CASE WHEN f.r_fwd IS NOT NULL AND q.n >= 4 THEN f.r_fwd >= q.q75 END y_realized, f.r_fwd own_r_fwd, CAST(COALESCE(q.n, 0) AS INTEGER) n_peer_r_fwd, o.probability,
    (hash(o.fund_id) % 1) + CAST(o.fund_id AS BIGINT) % 100/100.0::DOUBLE cohort_percentile
  FROM open_rows o LEFT JOIN fwd f ON f.fund_id = o.fund_id AND CAST(f.anchor AS VARCHAR) = o.anchor LEFT JOIN q ON q.gkey = o.gkey AND CAST(q.a AS VARCHAR) = o.anchor
  WHERE o.is_matured""".replace("(hash(o.fund_id) % 1) + ", ""), "open_rows", "fwd", "gkeys")


@stored
def realizations(spark, sf):
    rows = predictions(spark, sf).withColumn("cohort_percentile", F.col("fund_id").cast("bigint") % 100 / 100.0)
    return ledger.realize_matured(rows, realized_before(spark, sf), retired(spark, sf), X.nav(spark, sf), F.lit(TODAY).cast("date"), cohort_members(spark, sf))


@query("realized_predictions", sql(f"""
  SELECT fund_id, target, anchor, model_id, status, y_realized, {r6('own_r_fwd')} own_r_fwd, n_peer_r_fwd, {r6('probability')} probability FROM graded""", "graded"))
def _(spark, sf):
    return rounded(realizations(spark, sf).drop("cohort_percentile"))


define("summ", """
  WITH m AS (SELECT * FROM graded WHERE model_id = 'm2'), d AS (SELECT * FROM m WHERE status = 'REALIZED'),
  r AS (SELECT RANK() OVER (ORDER BY probability) + (COUNT(*) OVER (PARTITION BY probability) - 1)/2.0::DOUBLE rp,
          RANK() OVER (ORDER BY y_realized) + (COUNT(*) OVER (PARTITION BY y_realized) - 1)/2.0::DOUBLE ry FROM d)
  SELECT CASE WHEN COUNT(*) = 0 THEN 'PENDING_MATURITY' WHEN COUNT(*) FILTER (status = 'REALIZED') < 50 THEN 'INSUFFICIENT_MATURED' ELSE 'OK' END status,
    CASE WHEN COUNT(*) FILTER (status = 'REALIZED') >= 50 THEN round((SELECT corr(rp, ry) FROM r), 4) END AS value, COUNT(*) n_matured,
    COUNT(*) FILTER (status = 'REALIZED') n_realized, COUNT(*) FILTER (status = 'DEAD_OR_GAP') n_dead_or_gap, COUNT(*) FILTER (status = 'THIN_AT_REALIZATION') n_thin,
    CAST(round(COUNT(*) FILTER (status = 'REALIZED')/30.0::DOUBLE) AS BIGINT) effective_n,
    (SELECT CAST(CAST(MIN(anchor) AS DATE) + INTERVAL 36 MONTH AS DATE) FROM preds WHERE model_id = 'm2') earliest_maturity, 'm2' model_id FROM m""", "graded", "preds")


def summary(spark, sf):
    return ledger.realized_summary(realizations(spark, sf), predictions(spark, sf), retired(spark, sf))


@query("realized_summary", sql("SELECT * FROM summ", "summ"))
def _(spark, sf):
    return summary(spark, sf)


@query("outcome_metrics", sql("""
  WITH d AS (SELECT CAST(y_realized AS INTEGER) y, probability p, cohort_percentile c FROM graded WHERE model_id = 'm2' AND status = 'REALIZED' AND (SELECT status FROM summ) = 'OK'),
  o AS (SELECT AVG(y) b, AVG(y) FILTER (c >= 0.75) t, AVG(p) m FROM d)
  SELECT s.*, round(b, 4) base_rate, round(t, 4) precision_top, round(CASE WHEN t > 0 AND b > 0 THEN t/b END, 3) lift, round(abs(m - b), 4) calibration_gap FROM summ s, o""", "graded", "summ"))
def _(spark, sf):
    return ledger.outcome_metrics(realizations(spark, sf), summary(spark, sf))


@query("run_to_run_stability", sql("""
  WITH c AS (SELECT fund_id, COALESCE(model_id, '') m, probability p1 FROM dedup WHERE run_id = 'r199810' AND logged_at LIKE '%T00%'),
  p AS (SELECT fund_id, COALESCE(model_id, '') m, probability p0 FROM dedup WHERE run_id = 'r199809' AND model_id = 'm2'),
  j AS (SELECT p1, p0 FROM c JOIN p USING (fund_id, m)),
  r AS (SELECT RANK() OVER (ORDER BY p1) + (COUNT(*) OVER (PARTITION BY p1) - 1)/2.0::DOUBLE a, RANK() OVER (ORDER BY p0) + (COUNT(*) OVER (PARTITION BY p0) - 1)/2.0::DOUBLE b FROM j)
  SELECT CASE WHEN COUNT(*) < 20 THEN 'INSUFFICIENT_OVERLAP' ELSE 'OK' END status, CASE WHEN COUNT(*) >= 20 THEN round(corr(a, b), 4) END spearman, COUNT(*) n_common, 'r199809' prev_run_id FROM r""", "dedup"))
def _(spark, sf):
    rows = ledger.dedupe(predictions(spark, sf))
    current = rows.where((F.col("run_id") == "r199810") & F.col("logged_at").contains("T00"))
    return ledger.rank_stability(current, ledger.previous_run(rows, "r199810", "m2"))


# --- drift -------------------------------------------------------------------------------
DRIFT = tuple(K.DRIFT_FEATURES)
_long = lambda src: " UNION ALL ".join(f"SELECT '{f}' feature, round({f}, 9) v FROM {src}" for f in DRIFT)
define("dlong", f"SELECT * FROM ({_long('panel')})", "panel")
define("edges", """
  SELECT feature, list_concat(list_concat(['-inf'::DOUBLE], q[2:len(q) - 1]), ['inf'::DOUBLE]) edges FROM (
    SELECT feature, list_sort(list_distinct(QUANTILE_CONT(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) q FROM dlong WHERE v IS NOT NULL GROUP BY 1 HAVING COUNT(v) >= 30)""", "dlong")
define("ref_bins", """
  SELECT feature, bin, COUNT(*) n FROM (SELECT d.feature, LEAST(GREATEST(len(list_filter(edges, lambda e: e <= v)) - 1, 0), len(edges) - 2) bin FROM dlong d JOIN edges USING (feature) WHERE v IS NOT NULL) GROUP BY 1, 2""", "dlong", "edges")


@stored
def drift_rows(spark, sf):
    return P.panel(spark, sf).select("fund_id", "anchor", *[F.round(f, 9).alias(f) for f in DRIFT])


@stored
def reference(spark, sf):
    return monitoring.psi_reference(drift_rows(spark, sf), DRIFT)


@query("drift_bin_edges", sql(f"SELECT feature, len(edges) n_edges, {r6('list_sum(edges[2:len(edges) - 1])')} inner_sum FROM edges", "edges"))
def _(spark, sf):
    e = monitoring.bin_edges(drift_rows(spark, sf), DRIFT)
    return rounded(e.select("feature", F.size("edges").cast("bigint").alias("n_edges"), monitoring.inner_sum("edges").alias("inner_sum")))


@query("drift_reference_bins", sql(f"""
  SELECT feature, CAST(bin AS INTEGER) bin, {r6('n/CAST(SUM(n) OVER (PARTITION BY feature) AS DOUBLE)')} share FROM ref_bins""", "ref_bins"))
def _(spark, sf):
    out = reference(spark, sf).select("feature", F.posexplode("bin_props").alias("bin", "share"))
    return rounded(out.where(F.col("share") > 0))


define("psi", f"""
  WITH l AS ({_long("(SELECT * FROM panel WHERE anchor >= DATE '1998-06-30')")}),
  c AS (SELECT feature, bin, COUNT(*) n FROM (SELECT l.feature, LEAST(GREATEST(len(list_filter(edges, lambda e: e <= v)) - 1, 0), len(edges) - 2) bin FROM l JOIN edges USING (feature) WHERE v IS NOT NULL) GROUP BY 1, 2),
  t AS (SELECT feature, SUM(n) n FROM c GROUP BY 1 HAVING SUM(n) >= 30), s AS (SELECT feature, UNNEST(range(len(edges) - 1)) bin FROM edges),
  r AS (SELECT feature, bin, n/CAST(SUM(n) OVER (PARTITION BY feature) AS DOUBLE) p FROM ref_bins),
  j AS (SELECT s.feature, CAST(t.n AS BIGINT) n, GREATEST(COALESCE(c.n, 0)/CAST(t.n AS DOUBLE), 1e-4) cur, GREATEST(COALESCE(r.p, 0), 1e-4) ref
        FROM s JOIN t USING (feature) LEFT JOIN c USING (feature, bin) LEFT JOIN r USING (feature, bin))
  SELECT feature, MAX(n) n, SUM((cur - ref)*ln(cur/ref)) psi FROM j GROUP BY 1""", "panel", "edges", "ref_bins")


def drift_now(spark, sf):
    return drift_rows(spark, sf).where(F.col("anchor") >= "1998-06-30")


@query("drift_by_feature", sql(f"SELECT feature, n, {r6('psi')} psi FROM psi", "psi"))
def _(spark, sf):
    return rounded(monitoring.psi_by_feature(drift_now(spark, sf), reference(spark, sf), DRIFT))


@query("drift_summary", sql("""
  SELECT CASE WHEN MAX(psi) > 0.25 THEN 'SIGNIFICANT_SHIFT' WHEN MAX(psi) > 0.10 THEN 'MODERATE_SHIFT' ELSE 'OK' END status, round(MAX(psi), 4) psi_max, round(AVG(psi), 4) psi_mean,
    (LIST(feature ORDER BY psi DESC, feature DESC))[1:3] worst, COUNT(*) n_features FROM psi""", "psi"), lists=('worst',))
def _(spark, sf):
    return monitoring.psi_live(drift_now(spark, sf), reference(spark, sf), "m2", "m2", DRIFT)


# --- health and gates: a house is a monitored batch ---------------------------------------
define("hin", """
  SELECT s_nationkey batch, COUNT(*) n_total, COUNT(*) FILTER (s_acctbal < 0) n_errors, ['OK','MODERATE_SHIFT','SIGNIFICANT_SHIFT','REFERENCE_STALE'][s_nationkey % 4 + 1] psi_status,
    ['OK','FIRST_RUN','OK'][s_nationkey % 3 + 1] rank_status, round((AVG(s_acctbal) + 1000)/11000, 4) spearman, ['OK','PENDING_MATURITY','OTHER'][s_nationkey // 2 % 3 + 1] outcome_status,
    round(AVG(s_acctbal)/4000, 3) lift, CAST(DATE '2001-05-01' + CAST(s_nationkey * 3 AS INTEGER) AS VARCHAR) last_anchor FROM supplier GROUP BY s_nationkey""")


def health_inputs(spark, sf):
    k = F.col("s_nationkey")
    pick = lambda items, i: F.array(*[F.lit(x) for x in items])[i.cast("int")]
    return X.table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("s_acctbal") < 0).alias("n_errors"), F.avg("s_acctbal").alias("_a")).select(
        k.alias("batch"), "n_total", "n_errors", pick(("OK", "MODERATE_SHIFT", "SIGNIFICANT_SHIFT", "REFERENCE_STALE"), k % 4).alias("psi_status"),
        pick(("OK", "FIRST_RUN", "OK"), k % 3).alias("rank_status"), F.round((F.col("_a") + 1000) / 11000, 4).alias("spearman"),
        pick(("OK", "PENDING_MATURITY", "OTHER"), F.floor(k / 2) % 3).alias("outcome_status"), F.round(F.col("_a") / 4000, 3).alias("lift"),
        F.date_add(F.lit("2001-05-01").cast("date"), (k * 3).cast("int")).cast("string").alias("last_anchor"))


define("hg", """
  SELECT *, CASE WHEN psi_status = 'OK' THEN 'GREEN' WHEN psi_status LIKE '%SHIFT' THEN 'AMBER' ELSE 'UNAVAILABLE' END input_drift,
    CASE WHEN rank_status <> 'OK' THEN 'PENDING' WHEN spearman >= 0.90 THEN 'GREEN' WHEN spearman < 0.70 THEN 'RED' ELSE 'AMBER' END prediction_stability,
    CASE WHEN n_errors/CAST(n_total AS DOUBLE) < 0.05 THEN 'GREEN' WHEN n_errors/CAST(n_total AS DOUBLE) >= 0.20 THEN 'RED' ELSE 'AMBER' END pipeline_coverage,
    CASE WHEN outcome_status = 'PENDING_MATURITY' THEN 'PENDING' WHEN outcome_status <> 'OK' THEN 'UNAVAILABLE' WHEN lift >= 1.2 THEN 'GREEN' WHEN lift < 1.0 THEN 'RED' ELSE 'AMBER' END outcome_skill FROM hin""", "hin")


@query("model_health_report", sql("""
  SELECT batch, input_drift, prediction_stability, pipeline_coverage, outcome_skill,
    CASE WHEN list_contains(l, 'RED') THEN 'RED' WHEN list_contains(l, 'AMBER') THEN 'AMBER' WHEN list_contains(l, 'GREEN') THEN 'GREEN' ELSE 'PENDING' END status
  FROM (SELECT *, [input_drift, prediction_stability, pipeline_coverage, outcome_skill] l FROM hg)""", "hg"))
def _(spark, sf):
    return monitoring.health_report(health_inputs(spark, sf)).select(
        "batch", "input_drift", "prediction_stability", "pipeline_coverage", "outcome_skill", "status")


@query("batch_gates", sql("""
  SELECT batch, g gate, CASE g WHEN 'not_empty' THEN n_total > 0 WHEN 'error_rate' THEN n_errors/CAST(n_total AS DOUBLE) <= 0.1 ELSE date_diff('day', CAST(last_anchor AS DATE), DATE '2001-06-30') <= 30 END passed
  FROM hin, (SELECT UNNEST(['not_empty','error_rate','ledger_moving']) g)""", "hin"))
def _(spark, sf):
    return monitoring.batch_gates(health_inputs(spark, sf), 0.1, 30, F.lit(TODAY).cast("date")).select("batch", "gate", "passed")


# --- live scoring ------------------------------------------------------------------------
LABELS = {"AMERICA": "Large Cap", "ASIA": "Mid Cap", "MIDDLE EAST": "Small Cap"}
RAW = {"AMERICA": "Large Cap Fund", "ASIA": "Mid Cap Fund", "MIDDLE EAST": "Small Cap Fund"}
LIVE_TODAY = X.TODAY


def _mapped(table: dict, otherwise):
    out = otherwise
    for k, v in table.items():
        out = F.when(F.col("region") == k, v).otherwise(out)
    return out


def live_inputs(spark, sf):
    """Six sevenths of the funds are trained; the rest are candidates; customers have no prices."""
    funds = X.manifest(spark, sf)
    key = F.col("fund_id").cast("bigint")
    trained = funds.where(key % 7 != 3).select("fund_id", "scheme_name", "amc", _mapped(LABELS, F.lit("Sectoral/Thematic")).alias("category"), "sector")
    label = F.concat(F.lit("Open Ended Schemes(Equity Scheme - "), _mapped(RAW, F.lit("Sectoral/ Thematic")), F.lit(")"))
    known = funds.select("fund_id", F.when(key % 5 == 2, "Open Ended Schemes(Debt Scheme - Liquid Fund)").otherwise(label).alias("category_raw"))
    customers = X.table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("fund_id"),
                                                      F.when(F.col("c_custkey") % 2 == 0, "Open Ended Schemes(Equity Scheme - Mid Cap Fund)").alias("category_raw"))
    master = known.unionByName(customers)
    curated = funds.where(F.col("sector").isNotNull() & (key % 2 == 1)).select(F.col("fund_id").alias("amfi_code"), "sector")
    return trained, master, curated, master.select("fund_id")


define("live_state", """
  WITH f AS (SELECT m.fund_id, CAST(m.fund_id AS BIGINT) k, sector, region FROM manifest m), n AS (SELECT fund_id, MAX(dt) d FROM nav GROUP BY 1)
  SELECT f.fund_id, k % 7 <> 3 is_ref, LEAST(n.d, DATE '2001-11-15') anchor, date_diff('day', LEAST(n.d, DATE '2001-11-15'), DATE '2001-11-15') staleness_days,
    CASE WHEN k % 7 = 3 AND k % 5 = 2 THEN 'OUT_OF_TRAINING_UNIVERSE' WHEN k % 7 = 3 AND sector IS NOT NULL AND k % 2 = 0 THEN 'SECTOR_UNRESOLVED'
      WHEN date_diff('day', LEAST(n.d, DATE '2001-11-15'), DATE '2001-11-15') > 30 THEN 'STALE_NAV' END early_status FROM f JOIN n USING (fund_id)
  UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), FALSE, NULL, NULL, 'NOT_IN_UNIVERSE' FROM customer""", "manifest", "nav")


@query("live_gate_state", sql("SELECT * FROM live_state", "live_state"))
def _(spark, sf):
    trained, master, curated, asked = live_inputs(spark, sf)
    out = live.requests_state(asked, trained, X.nav(spark, sf), master, curated, F.lit(LIVE_TODAY))
    return out.select("fund_id", "is_ref", "anchor", "staleness_days", "early_status")


@query("live_anchors", sql("""
  SELECT fund_id, LEAST(MAX(dt), DATE '2001-11-15') anchor, date_diff('day', LEAST(MAX(dt), DATE '2001-11-15'), DATE '2001-11-15') staleness_days FROM nav GROUP BY 1""", "nav"))
def _(spark, sf):
    return live.live_anchors(X.nav(spark, sf), F.lit(LIVE_TODAY))


_LIVE: dict[tuple[str, str], live.LiveScores] = {}


def live_result(spark, sf):
    """Scores and cohort members of one run, each written once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LIVE:
        trained, master, curated, asked = live_inputs(spark, sf)
        got = live.score_live(asked, trained, X.nav(spark, sf), master, curated, M.small_model(spark), list(M.COEF), F.lit(LIVE_TODAY), X.OBS_PER_YEAR)
        _LIVE[key] = live.LiveScores(cut_lineage(got.rows), cut_lineage(got.members))
    return _LIVE[key]


def live_scores(spark, sf):
    return live_result(spark, sf).rows


@query("live_scores")
def _(spark, sf):
    return rounded(live_scores(spark, sf).select("fund_id", "status", "anchor", "cohort_key", "cohort_n", "universe_n", "probability", "cohort_percentile"))


@query("ledger_rows_from_scores")
def _(spark, sf):
    rows = ledger.prediction_rows(live_scores(spark, sf), "run-1", "0000000", F.lit("2001-11-15T00:00:00"))
    return rounded(rows.select("fund_id", "target", "anchor", "model_id", "probability", "row_hash"))
