"""Spikes, payouts, integrity, calendars and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, series
from . import fixtures as X
from .oracle import define, r6, sql
from .registry import query, rounded

define("spiky", """
  SELECT *, COALESCE(n >= 5 AND abs(r) >= 0.10 AND r*r2 < 0 AND abs(r2) >= 0.5*abs(r), FALSE) is_spike
  FROM (SELECT *, LEAD(r) OVER (PARTITION BY fund_id ORDER BY dt) r2 FROM (
    SELECT *, nav/LAG(nav) OVER (PARTITION BY fund_id ORDER BY dt) - 1 r, COUNT(*) OVER (PARTITION BY fund_id) n FROM dirty))""", "dirty")
define("unspiked", "SELECT fund_id, dt, nav, is_payout_plan, n FROM spiky WHERE NOT is_spike", "spiky")
define("paid", """
  WITH b AS (
    SELECT u.*, LAST_VALUE(x.level IGNORE NULLS) OVER (PARTITION BY u.fund_id ORDER BY u.dt ROWS UNBOUNDED PRECEDING) lvl
    FROM unspiked u JOIN manifest m USING (fund_id) LEFT JOIN bench x ON x.name = m.region AND x.dt = u.dt),
  s AS (SELECT *, nav/LAG(nav) OVER w - 1 r, lvl/LAG(lvl) OVER w - 1 br FROM b WINDOW w AS (PARTITION BY fund_id ORDER BY dt)),
  f AS (SELECT *, COALESCE(is_payout_plan AND r <= -0.03 AND n >= 5, FALSE) dropped, COALESCE(br < -0.015, FALSE) fell FROM s)
  SELECT fund_id, dt, is_payout_plan, dropped AND NOT fell payout, dropped AND fell market_move,
    nav * EXP(SUM(CASE WHEN dropped AND NOT fell THEN -LN(1+r) ELSE 0.0::DOUBLE END) OVER (PARTITION BY fund_id ORDER BY dt)) nav
  FROM f""", "unspiked", "manifest", "bench")


def fund_levels(spark, sf):
    names = X.fund_bench(spark, sf)
    return X.bench(spark, sf).join(names, "name").select("fund_id", "dt", F.col("level").alias("bench"))


@query("spike_removal", sql(f"SELECT fund_id, dt, {r6('nav')} nav FROM unspiked", "unspiked"))
def _(spark, sf):
    return rounded(cleaning.remove_spikes(X.dirty_nav(spark, sf)).select("fund_id", "dt", "nav"))


@query("payout_reconstruction", sql(
    f"SELECT fund_id, dt, is_payout_plan, payout, market_move, {r6('nav')} nav FROM paid", "paid"))
def _(spark, sf):
    return rounded(cleaning.clean(X.dirty_nav(spark, sf), fund_levels(spark, sf)))


@query("cleaning_report", sql("""
  SELECT fund_id, rows_in, spikes_removed, rows_out, payout_steps, payout_dates, market_moves FROM
    (SELECT fund_id, COUNT(*) rows_in, COUNT(*) FILTER (is_spike) spikes_removed FROM spiky GROUP BY 1) LEFT JOIN
    (SELECT fund_id, COUNT(*) rows_out, COUNT(*) FILTER (payout) payout_steps,
       COALESCE(LIST(CAST(dt AS VARCHAR) ORDER BY dt) FILTER (payout), []) payout_dates,
       COUNT(*) FILTER (market_move) market_moves FROM paid GROUP BY 1) USING (fund_id)""", "spiky", "paid"), lists=('payout_dates',))
def _(spark, sf):
    out = cleaning.cleaning_report(X.dirty_nav(spark, sf), fund_levels(spark, sf))
    return out.withColumn("payout_dates", F.col("payout_dates").cast("array<string>"))


@query("series_integrity", sql("""
  WITH s AS (SELECT fund_id, nav, abs(nav/LAG(nav) OVER (PARTITION BY fund_id ORDER BY dt) - 1) j FROM dirty),
  g AS (SELECT fund_id, COUNT(*) n_obs, COUNT(*) FILTER (j > 0.25) jumps FROM s GROUP BY 1)
  SELECT fund_id, n_obs, list_filter([CASE WHEN n_obs < 30 THEN 'short_history' END, CASE WHEN jumps > 0 THEN 'step_over_25pct' END],
         lambda x: x IS NOT NULL) errors, n_obs >= 30 AND jumps = 0 ok FROM g""", "dirty"), lists=('errors',))
def _(spark, sf):
    return cleaning.integrity(X.dirty_nav(spark, sf))


@query("business_day_panel", sql(f"""
  WITH cal AS (SELECT CAST(d AS DATE) dt FROM generate_series((SELECT MIN(dt)::TIMESTAMP FROM nav), (SELECT MAX(dt)::TIMESTAMP FROM nav), INTERVAL 1 DAY) g(d)
               WHERE isodow(d) <= 5)
  SELECT f.fund_id, cal.dt, {r6('LAST_VALUE(n.nav IGNORE NULLS) OVER (PARTITION BY f.fund_id ORDER BY cal.dt ROWS 5 PRECEDING)')} nav
  FROM (SELECT DISTINCT fund_id FROM nav) f CROSS JOIN cal LEFT JOIN nav n ON n.fund_id = f.fund_id AND n.dt = cal.dt""", "nav"))
def _(spark, sf):
    return rounded(series.business_calendar(X.nav(spark, sf)))


@query("usable_panel", sql(f"""
  SELECT fund_id, dt, {r6('nav')} nav FROM nav SEMI JOIN manifest USING (fund_id)
  QUALIFY COUNT(*) OVER (PARTITION BY fund_id) >= 5""", "nav", "manifest"))
def _(spark, sf):
    return rounded(series.usable_panel(X.nav(spark, sf), X.manifest(spark, sf)))


@query("nav_panel_audit", sql("""
  SELECT 'nav_panel' stage, UNNEST(['dates_monotonic','no_inf_values','navs_strictly_positive','no_all_null_funds']) "check",
         TRUE passed, '0' detail FROM (SELECT COUNT(*) c FROM dirty) WHERE c > 0""", "dirty"))
def _(spark, sf):
    return cleaning.audit_nav(X.dirty_nav(spark, sf))


@query("holdings_audit", sql("""
  WITH w AS (SELECT fund_id, SUM(weight) w FROM holdings GROUP BY 1)
  SELECT 'holdings' stage, 'baseline_schema' "check", TRUE passed, '' detail
  UNION ALL SELECT 'holdings', 'weights_sum_band', COUNT(*) FILTER (w NOT BETWEEN 0.95 AND 1.05) = 0,
    CAST(COUNT(*) FILTER (w NOT BETWEEN 0.95 AND 1.05) AS VARCHAR) FROM w""", "holdings"))
def _(spark, sf):
    return cleaning.audit_holdings(X.holdings(spark, sf))


@query("benchmark_coverage_audit", sql(f"""
  SELECT m.region name, r.fund_id, COUNT(*) own_days, COUNT(x.b) shared_days, {r6('COUNT(x.b)/CAST(COUNT(*) AS DOUBLE)')} coverage,
         COUNT(x.b)/CAST(COUNT(*) AS DOUBLE) >= 0.90 passed
  FROM ret r JOIN manifest m USING (fund_id) LEFT JOIN bench_ret x ON x.name = m.region AND x.dt = r.dt GROUP BY ALL""",
  "ret", "manifest", "bench_ret").replace("SELECT m.region name, r.fund_id", "SELECT r.fund_id"))
def _(spark, sf):
    own = series.daily_returns(X.nav(spark, sf))
    other = series.daily_returns(X.bench(spark, sf), "name", "level", "b")
    return rounded(cleaning.audit_bench_coverage(own, other, X.fund_bench(spark, sf)))


@query("audit_summary", sql("""
  WITH a AS (SELECT fund_id, SUM(weight) w, as_of FROM holdings GROUP BY fund_id, as_of),
  s AS (SELECT fund_id, COUNT(*) n_obs, COUNT(*) FILTER (j > 0.25) jumps FROM
        (SELECT fund_id, abs(nav/LAG(nav) OVER (PARTITION BY fund_id ORDER BY dt) - 1) j FROM dirty) GROUP BY 1)
  SELECT 'holdings' stage, 'weight_sum' "check", COUNT(*) n_checks, COUNT(*) FILTER (w BETWEEN 0.95 AND 1.05) n_passed FROM a
  UNION ALL SELECT 'nav', 'integrity', COUNT(*), COUNT(*) FILTER (n_obs >= 30 AND jumps = 0) FROM s""", "holdings", "dirty"))
def _(spark, sf):
    sums = cleaning.weight_sums(X.holdings(spark, sf)).select(
        F.lit("holdings").alias("stage"), F.lit("weight_sum").alias("check"), F.col("ok").alias("passed"))
    sound = cleaning.integrity(X.dirty_nav(spark, sf)).select(
        F.lit("nav").alias("stage"), F.lit("integrity").alias("check"), F.col("ok").alias("passed"))
    return cleaning.audit_summary(sums.unionByName(sound))


@query("row_continuity", sql("""
  SELECT 'spikes' stage, 'row_continuity>=50%' "check", r >= 0.5 passed, printf('%.4f', r) detail
  FROM (SELECT (SELECT COUNT(*) FROM unspiked)/CAST((SELECT COUNT(*) FROM dirty) AS DOUBLE) r)""", "unspiked", "dirty"))
def _(spark, sf):
    raw = X.dirty_nav(spark, sf)
    return cleaning.row_continuity(raw, cleaning.remove_spikes(raw), "spikes")
