"""Return, risk, relative and rolling metrics; the ranked universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors, metrics, series
from ..session import cut_lineage
from . import fixtures as X
from .oracle import define, r6, sql
from .registry import query, rounded

D = X.OBS_PER_YEAR
RFD = f"(POWER(1.0675::DOUBLE, 1.0::DOUBLE/{D}) - 1)"
ROOT = f"SQRT({D}.0::DOUBLE)"

define("own_metrics", f"""
  WITH s AS (SELECT fund_id, dt, nav, nav/LAG(nav) OVER (PARTITION BY fund_id ORDER BY dt) - 1 r FROM nav)
  SELECT fund_id, COUNT(*) n_obs,
    POWER(ARG_MAX(nav, dt)/ARG_MIN(nav, dt), 365.25::DOUBLE/date_diff('day', MIN(dt), MAX(dt))) - 1 cagr_full,
    POWER(EXP(SUM(LN(1+r))), {D}.0::DOUBLE/COUNT(r)) - 1 ann_return,
    CASE WHEN COUNT(r) > 2 THEN STDDEV_SAMP(r)*{ROOT} END ann_vol,
    (AVG(r) - {RFD})/STDDEV_SAMP(r)*{ROOT} sharpe,
    (AVG(r) - {RFD})/SQRT(AVG(CASE WHEN r < {RFD} THEN (r-{RFD})*(r-{RFD}) WHEN r IS NOT NULL THEN 0.0::DOUBLE END))*{ROOT} sortino
  FROM s GROUP BY fund_id""", "nav")
define("rel_metrics", f"""
  WITH g AS (
    SELECT fund_id, COUNT(*) n, COVAR_SAMP(f, b)/VAR_SAMP(b) beta,
      POWER(EXP(SUM(LN(1+f))), {D}.0::DOUBLE/COUNT(*)) - 1 ann_f, POWER(EXP(SUM(LN(1+b))), {D}.0::DOUBLE/COUNT(*)) - 1 ann_b,
      STDDEV_SAMP(f-b)*{ROOT} te,
      COUNT(*) FILTER (b > 0) up_n, SUM(LN(1+f)) FILTER (b > 0) up_f, SUM(LN(1+b)) FILTER (b > 0) up_b,
      COUNT(*) FILTER (b < 0) dn_n, SUM(LN(1+f)) FILTER (b < 0) dn_f, SUM(LN(1+b)) FILTER (b < 0) dn_b
    FROM joint GROUP BY fund_id)
  SELECT fund_id, n joint_obs, CASE WHEN n >= 60 THEN beta END beta,
    CASE WHEN n >= 60 THEN ann_f - (0.0675::DOUBLE + beta*(ann_b - 0.0675::DOUBLE)) END alpha,
    CASE WHEN n >= 60 THEN te END tracking_error,
    CASE WHEN n >= 60 THEN (ann_f - ann_b)/te END info_ratio,
    CASE WHEN up_n > 10 THEN (EXP(up_f/up_n) - 1)/(EXP(up_b/up_n) - 1) END upside_capture,
    CASE WHEN dn_n > 10 THEN (EXP(dn_f/dn_n) - 1)/(EXP(dn_b/dn_n) - 1) END downside_capture
  FROM g""", "joint")
define("drawdown", """
  SELECT fund_id, MIN(nav/peak - 1) max_drawdown
  FROM (SELECT fund_id, nav, MAX(nav) OVER (PARTITION BY fund_id ORDER BY dt) peak FROM nav) GROUP BY 1""", "nav")


def _rolling(years: int, extra: str = "") -> str:
    lag = years * D
    return f"""
  SELECT fund_id, AVG(q) rr{years}y_mean, QUANTILE_CONT(q, 0.25) rr{years}y_p25,
         AVG(CASE WHEN q < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) rr{years}y_negative_share
  FROM (SELECT fund_id, dt, POWER(nav/LAG(nav, {lag}) OVER (PARTITION BY fund_id ORDER BY dt), 1.0::DOUBLE/{years}) - 1 q FROM nav)
  WHERE q IS NOT NULL {extra} GROUP BY 1"""


define("rr3", _rolling(3), "nav")
define("rr5", _rolling(5), "nav")
define("rr3_friday", _rolling(3, "AND isodow(dt) = 5"), "nav")

OWN = ("cagr_full", "ann_return", "ann_vol", "sharpe", "sortino")
REL = ("beta", "alpha", "tracking_error", "info_ratio", "upside_capture", "downside_capture")


def shown(cols, alias: str = "") -> str:
    return ", ".join(f"{r6(alias + c)} {c}" for c in cols)


@query("daily_returns", sql(f"SELECT fund_id, dt, {r6('r', 9)} r FROM ret", "ret"))
def _(spark, sf):
    return rounded(series.daily_returns(X.nav(spark, sf)), 9)


@query("fund_return_metrics", sql(f"SELECT fund_id, n_obs, {shown(OWN)} FROM own_metrics", "own_metrics"))
def _(spark, sf):
    return rounded(metrics.return_metrics(X.nav(spark, sf), D))


@query("max_drawdown", sql(f"SELECT fund_id, {r6('max_drawdown')} max_drawdown FROM drawdown", "drawdown"))
def _(spark, sf):
    return rounded(metrics.max_drawdown(X.nav(spark, sf)))


@query("benchmark_joint_returns", sql(f"SELECT fund_id, dt, {r6('f', 9)} f, {r6('b', 9)} b FROM joint", "joint"))
def _(spark, sf):
    return rounded(metrics.joint_returns(X.nav(spark, sf), X.bench(spark, sf), X.fund_bench(spark, sf)), 9)


@query("benchmark_relative_metrics", sql(f"SELECT fund_id, joint_obs, {shown(REL)} FROM rel_metrics", "rel_metrics"))
def _(spark, sf):
    joint = metrics.joint_returns(X.nav(spark, sf), X.bench(spark, sf), X.fund_bench(spark, sf))
    return rounded(metrics.relative_metrics(joint, D))


@query("treynor_ratio", sql(
    f"SELECT o.fund_id, {r6('CASE WHEN abs(beta) > 1e-12 THEN (ann_return - 0.0675::DOUBLE)/beta END')} treynor "
    "FROM own_metrics o LEFT JOIN rel_metrics USING (fund_id)", "own_metrics", "rel_metrics"))
def _(spark, sf):
    nav = X.nav(spark, sf)
    joint = metrics.joint_returns(nav, X.bench(spark, sf), X.fund_bench(spark, sf))
    return rounded(metrics.treynor(metrics.return_metrics(nav, D), metrics.relative_metrics(joint, D)))


define("shared_levels", """
  SELECT n.fund_id, n.dt, n.nav, x.level FROM nav n JOIN manifest m USING (fund_id)
  JOIN bench x ON x.name = m.region AND x.dt = n.dt""", "nav", "manifest", "bench")
define("shared_growth", """
  SELECT fund_id, COUNT(*) n_common,
    POWER(ARG_MAX(nav, dt)/ARG_MIN(nav, dt), 365.25::DOUBLE/date_diff('day', MIN(dt), MAX(dt)))
    - POWER(ARG_MAX(level, dt)/ARG_MIN(level, dt), 365.25::DOUBLE/date_diff('day', MIN(dt), MAX(dt))) diff
  FROM shared_levels GROUP BY 1""", "shared_levels")


@query("tracking_difference", sql(
    f"SELECT fund_id, n_common shared_obs, {r6('CASE WHEN n_common >= 252 THEN diff END')} tracking_difference FROM shared_growth",
    "shared_growth"))
def _(spark, sf):
    return rounded(metrics.tracking_difference(X.nav(spark, sf), X.bench(spark, sf), X.fund_bench(spark, sf)))


def rr_cols(years: int):
    return (f"rr{years}y_mean", f"rr{years}y_p25", f"rr{years}y_negative_share")


@query("rolling_return_stats", sql(
    f"SELECT a.fund_id, {shown(rr_cols(3))}, {shown(rr_cols(5))} FROM rr3 a LEFT JOIN rr5 USING (fund_id)", "rr3", "rr5"))
def _(spark, sf):
    nav = X.nav(spark, sf)
    return rounded(metrics.rolling_stats(nav, 3, 3 * D).join(metrics.rolling_stats(nav, 5, 5 * D), "fund_id", "left"))


@query("rolling_return_stats_fridays", sql(f"SELECT fund_id, {shown(rr_cols(3))} FROM rr3_friday", "rr3_friday"))
def _(spark, sf):
    return rounded(metrics.rolling_stats(X.nav(spark, sf), 3, 3 * D, fridays_only=True))


@query("spread_velocity", sql(f"""
  SELECT fund_id, {r6('arg_max(spread, k)')} arb_spread_ann, {r6(f'regr_slope(spread, CAST(k AS DOUBLE))*{D}', 5)} arb_spread_velocity
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fund_id ORDER BY k DESC) back FROM (
    SELECT fund_id, ROW_NUMBER() OVER w k, AVG(f-b) OVER (PARTITION BY fund_id ORDER BY dt ROWS 62 PRECEDING)*{D} spread
    FROM joint WINDOW w AS (PARTITION BY fund_id ORDER BY dt)) WHERE k >= 63)
  WHERE back <= 63 GROUP BY fund_id HAVING COUNT(*) >= 63""", "joint"))
def _(spark, sf):
    joint = metrics.joint_returns(X.nav(spark, sf), X.bench(spark, sf), X.fund_bench(spark, sf))
    out = metrics.spread_velocity(joint, 63, D)
    return out.select("fund_id", (F.round("arb_spread_ann", 6) + F.lit(0.0)).alias("arb_spread_ann"),
                      (F.round("arb_spread_velocity", 5) + F.lit(0.0)).alias("arb_spread_velocity"))


define("alert_metrics", f"""
  WITH tail AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fund_id ORDER BY dt DESC) back FROM nav),
  t AS (SELECT fund_id, nav, MAX(nav) OVER (PARTITION BY fund_id ORDER BY dt) peak FROM tail WHERE back <= {3 * D}),
  dd AS (SELECT fund_id, CASE WHEN COUNT(*) >= 60 THEN MIN(nav/peak - 1) END max_dd_3y FROM t GROUP BY 1),
  sh AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fund_id ORDER BY dt DESC) back,
           nav/LAG(nav) OVER (PARTITION BY fund_id ORDER BY dt) - 1 f, level/LAG(level) OVER (PARTITION BY fund_id ORDER BY dt) - 1 b
         FROM shared_levels),
  bt AS (SELECT fund_id, level, MAX(level) OVER (PARTITION BY fund_id ORDER BY dt) peak FROM sh WHERE back <= {3 * D}),
  bdd AS (SELECT fund_id, CASE WHEN COUNT(*) >= 60 THEN MIN(level/peak - 1) END benchmark_max_dd_3y FROM bt GROUP BY 1),
  g AS (SELECT fund_id, COUNT(*) n, COVAR_SAMP(f, b)/VAR_SAMP(b) beta,
      POWER(EXP(SUM(LN(1+f))), {D}.0::DOUBLE/COUNT(*)) - 1 ann_f, POWER(EXP(SUM(LN(1+b))), {D}.0::DOUBLE/COUNT(*)) - 1 ann_b,
      STDDEV_SAMP(f-b)*{ROOT} te,
      COUNT(*) FILTER (b > 0) up_n, SUM(LN(1+f)) FILTER (b > 0) up_f, SUM(LN(1+b)) FILTER (b > 0) up_b,
      COUNT(*) FILTER (b < 0) dn_n, SUM(LN(1+f)) FILTER (b < 0) dn_f, SUM(LN(1+b)) FILTER (b < 0) dn_b
    FROM sh WHERE f IS NOT NULL GROUP BY fund_id)
  SELECT o.fund_id, o.cagr_full cagr, CASE WHEN o.n_obs - 1 >= 126 THEN o.sortino END sortino, dd.max_dd_3y, rr3.rr3y_negative_share,
    s.n_common, CASE WHEN s.n_common > {D} THEN s.diff END excess_cagr_3y, CASE WHEN s.n_common >= {D} THEN s.diff END tracking_difference_tri,
    CASE WHEN s.n_common >= 60 AND g.n >= 60 THEN g.beta END beta,
    CASE WHEN s.n_common >= 60 AND g.n >= 60 THEN g.te END tracking_error,
    CASE WHEN s.n_common >= 60 AND g.n >= 60 THEN (g.ann_f - g.ann_b)/g.te END info_ratio,
    CASE WHEN s.n_common >= 60 AND up_n > 10 THEN (EXP(up_f/up_n) - 1)/(EXP(up_b/up_n) - 1) END upside_capture,
    CASE WHEN s.n_common >= 60 AND dn_n > 10 THEN (EXP(dn_f/dn_n) - 1)/(EXP(dn_b/dn_n) - 1) END downside_capture,
    CASE WHEN s.n_common >= 60 THEN bdd.benchmark_max_dd_3y END benchmark_max_dd_3y
  FROM own_metrics o LEFT JOIN dd USING (fund_id) LEFT JOIN rr3 USING (fund_id)
  LEFT JOIN shared_growth s ON s.fund_id = o.fund_id AND s.n_common >= 60
  LEFT JOIN g ON g.fund_id = o.fund_id LEFT JOIN bdd ON bdd.fund_id = o.fund_id""",
       "nav", "own_metrics", "rr3", "shared_levels", "shared_growth")
ALERT = ("cagr", "sortino", "max_dd_3y", "rr3y_negative_share", "excess_cagr_3y", "tracking_difference_tri", "beta",
         "tracking_error", "info_ratio", "upside_capture", "downside_capture", "benchmark_max_dd_3y")


@query("alert_metric_row", sql(f"SELECT fund_id, n_common, {shown(ALERT)} FROM alert_metrics", "alert_metrics"))
def _(spark, sf):
    return rounded(metrics.alert_metrics(X.nav(spark, sf), X.bench(spark, sf), X.fund_bench(spark, sf), D))


@query("recent_risk_facts", sql(f"""
  WITH s AS (SELECT fund_id, dt, nav, nav/LAG(nav) OVER (PARTITION BY fund_id ORDER BY dt) - 1 r,
               ROW_NUMBER() OVER (PARTITION BY fund_id ORDER BY dt DESC) back FROM nav),
  v AS (SELECT fund_id, CASE WHEN COUNT(r) >= 30 THEN STDDEV_SAMP(r) FILTER (back <= {D})*{ROOT} END vol_1y FROM s GROUP BY 1),
  t AS (SELECT fund_id, nav/MAX(nav) OVER (PARTITION BY fund_id ORDER BY dt) - 1 dd FROM s WHERE back <= {3 * D})
  SELECT v.fund_id, {r6('vol_1y')} vol_1y, {r6('MIN(dd)')} max_dd_3y FROM v JOIN t USING (fund_id) GROUP BY v.fund_id, vol_1y""", "nav"))
def _(spark, sf):
    return rounded(metrics.recent_facts(X.nav(spark, sf), D))


def metric_rows(spark, sf):
    nav = X.nav(spark, sf)
    full = metrics.fund_metrics(nav, X.bench(spark, sf), X.fund_bench(spark, sf), D)
    meta = X.manifest(spark, sf).select("fund_id", F.lit("Equity").alias("category"), "amc")
    empty_risk = nav.select("fund_id").distinct()
    return metrics.metric_matrix(meta, full, empty_risk, nav)


MATRIX = OWN + REL + ("treynor", "max_drawdown") + rr_cols(3) + rr_cols(5)
define("matrix", f"""
  SELECT fund_id, 'Equity' category, amc, n_obs, joint_obs, {', '.join(OWN + REL)},
         CASE WHEN abs(beta) > 1e-12 THEN (ann_return - 0.0675::DOUBLE)/beta END treynor, max_drawdown,
         {', '.join(rr_cols(3) + rr_cols(5))}
  FROM manifest JOIN own_metrics USING (fund_id) LEFT JOIN rel_metrics USING (fund_id) LEFT JOIN drawdown USING (fund_id)
  LEFT JOIN rr3 USING (fund_id) LEFT JOIN rr5 USING (fund_id)""", "manifest", "own_metrics", "rel_metrics", "drawdown", "rr3", "rr5")


@query("metric_matrix", sql(f"SELECT fund_id, category, amc, n_obs, joint_obs, {shown(MATRIX)} FROM matrix", "matrix"))
def _(spark, sf):
    return rounded(metric_rows(spark, sf))


FACTORS = tuple(f for f in factors.LONG_FACTORS if f[0] == "Equity")
_x = " UNION ALL ".join(
    f"SELECT fund_id, amc, '{m}' metric, {w}::DOUBLE w, {d}*round({m}, 9) x FROM matrix" for _, m, w, d in FACTORS if m != "expense_ratio")
define("composite", f"""
  WITH u AS ({_x}),
  live AS (SELECT amc, metric, MAX(w) w FROM u WHERE x IS NOT NULL GROUP BY 1, 2),
  tot AS (SELECT amc, SUM(w) tw, COUNT(*) n_factors FROM live GROUP BY 1),
  pct AS (SELECT u.fund_id, u.amc, u.metric, u.w,
            COALESCE(CASE WHEN x IS NOT NULL THEN (RANK() OVER (PARTITION BY u.amc, u.metric ORDER BY x NULLS LAST)
              + (COUNT(*) OVER (PARTITION BY u.amc, u.metric, x) - 1)/2.0::DOUBLE)
              / COUNT(x) OVER (PARTITION BY u.amc, u.metric) END, 0.5::DOUBLE) p
          FROM u SEMI JOIN live ON live.amc = u.amc AND live.metric = u.metric),
  raw AS (SELECT fund_id, amc, round(SUM(w*p)/MAX(tw), 12) raw, MAX(n_factors) n_factors FROM pct JOIN tot USING (amc) GROUP BY 1, 2),
  b AS (SELECT *, MIN(raw) OVER (PARTITION BY amc) lo, MAX(raw) OVER (PARTITION BY amc) hi FROM raw),
  s AS (SELECT fund_id, amc, raw, n_factors,
          round(round(1 + 99*CASE WHEN hi - lo > 1e-12 THEN (raw - lo)/(hi - lo) ELSE 0.5::DOUBLE END, 9), 1) composite_score FROM b)
  SELECT fund_id, amc category, raw, n_factors, composite_score,
         CAST(RANK() OVER (PARTITION BY amc ORDER BY composite_score DESC) AS INTEGER) peer_rank FROM s""", "matrix")


def ranked(spark, sf):
    names = [m for _, m, _, _ in FACTORS if m != "expense_ratio"]
    base = cut_lineage(metric_rows(spark, sf))
    peers = base.select("fund_id", F.col("amc").alias("category"), *[F.round(n, 9).alias(n) for n in names])
    houses = [(r, m, w, d) for r in _houses(spark, sf) for _, m, w, d in FACTORS]
    return factors.category_composite(peers, houses)


def _houses(spark, sf):
    return [r[0] for r in X.table(spark, sf, "nation").select("n_name").collect()]


@query("ranked_universe", sql(
    f"SELECT fund_id, category, {r6('raw')} raw, n_factors, composite_score, peer_rank FROM composite", "composite"))
def _(spark, sf):
    return rounded(ranked(spark, sf))


@query("factor_coverage", sql(f"""
  WITH u AS ({_x}), h AS (SELECT amc, metric, MAX(w) w, COUNT(x) n FROM u GROUP BY 1, 2)
  SELECT amc category, COUNT(*) FILTER (n > 0) n_usable, COUNT(*) + 1 n_factors, {r6('SUM(CASE WHEN n > 0 THEN w ELSE 0.0::DOUBLE END)')} weight_sum,
         SUM(CASE WHEN n > 0 THEN w ELSE 0.0::DOUBLE END) >= 0.5 passed FROM h GROUP BY 1""", "matrix"))
def _(spark, sf):
    base = metric_rows(spark, sf).withColumn("category", F.col("amc"))
    houses = [(r, m, w, d) for r in _houses(spark, sf) for _, m, w, d in FACTORS]
    return rounded(factors.coverage_by_category(base, houses))
