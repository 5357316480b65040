"""Peers, labels and the point-in-time feature panel."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ranking import group_quantiles, loo_median, with_percentile_rank
from ..operators import features, labels, peers, series
from ..session import stored
from . import fixtures as X
from .oracle import CTES, define, r6, sql
from .registry import query, rounded

D = X.OBS_PER_YEAR
RFD = f"(POWER(1.0675::DOUBLE, 1.0::DOUBLE/{D}) - 1)"
ROOT = f"SQRT({D}.0::DOUBLE)"

define("gkeys", """
  SELECT m.*, CASE WHEN category <> 'Sectoral/Thematic' THEN 'category' WHEN s.c < 3 THEN 'pooled_thematic' ELSE 'sector' END group_kind,
    CASE WHEN category <> 'Sectoral/Thematic' THEN 'category|' || category WHEN s.c < 3 THEN 'pooled_thematic' ELSE 'sector|' || m.sector END gkey
  FROM manifest m LEFT JOIN (SELECT sector, COUNT(*) c FROM manifest WHERE sector IS NOT NULL GROUP BY 1) s ON s.sector = m.sector""", "manifest")
define("gtot", "SELECT gkey, dt, SUM(r) total, COUNT(*) n FROM ret JOIN gkeys USING (fund_id) GROUP BY 1, 2", "ret", "gkeys")
define("comp", """
  SELECT m.fund_id, g.dt, r.r f, (g.total - COALESCE(r.r, 0))/(g.n - CAST(r.r IS NOT NULL AS INTEGER)) c
  FROM gkeys m JOIN gtot g USING (gkey) LEFT JOIN ret r ON r.fund_id = m.fund_id AND r.dt = g.dt
  WHERE g.n - CAST(r.r IS NOT NULL AS INTEGER) >= 2""", "gkeys", "gtot", "ret")
define("comp_lv", "SELECT fund_id, dt, SUM(LN(1+c)) OVER (PARTITION BY fund_id ORDER BY dt) lv FROM comp", "comp")
define("sec_r", """
  SELECT m.series, r.dt, AVG(r.r) r FROM ret r
  JOIN (SELECT fund_id, sector series FROM manifest WHERE sector IS NOT NULL UNION ALL
        SELECT fund_id, '*' FROM manifest WHERE category = 'Sectoral/Thematic') m USING (fund_id) GROUP BY 1, 2""", "ret", "manifest")
define("sec_lv", "SELECT series, dt, r, SUM(LN(1+r)) OVER (PARTITION BY series ORDER BY dt) lv FROM sec_r", "sec_r")


def at(src: str, key: str, cols: str, base: str, date: str, tag: str) -> str:
    """Fresh as-of values of ``src`` at ``date`` for the rows of ``base``."""
    picked = ", ".join(f"CASE WHEN date_diff('day', s.dt, b._d) <= 10 THEN s.{c} END {c}_{tag}" for c in ["dt", *cols.split()])
    return f"(SELECT b.{key}, b.anchor, {picked} FROM (SELECT *, CAST({date} AS DATE) _d FROM {base}) b ASOF LEFT JOIN {src} s ON s.{key} = b.{key} AND s.dt <= b._d)"


define("fwd", f"""
  SELECT fund_id, anchor, POWER(nav_d1/nav_d0, 1/(date_diff('day', dt_d0, dt_d1)/365.25::DOUBLE)) - 1 r_fwd
  FROM {at('nav', 'fund_id', 'nav', 'pairs', 'anchor', 'd0')} a
  JOIN {at('nav', 'fund_id', 'nav', 'pairs', 'anchor + INTERVAL 36 MONTH', 'd1')} b USING (fund_id, anchor)
  WHERE date_diff('day', dt_d0, dt_d1)/365.25 >= 2.75""", "nav", "pairs")
define("bpairs", "SELECT name, anchor FROM bench_meta, months WHERE source <> 'NONE'", "bench_meta", "months")
define("bench_fwd", f"""
  SELECT name, anchor, POWER(level_d1/level_d0, 1/(date_diff('day', dt_d0, dt_d1)/365.25::DOUBLE)) - 1
           + CASE WHEN return_type = 'PRI' THEN 0.013::DOUBLE ELSE 0.0::DOUBLE END bench_fwd,
         CASE WHEN return_type = 'PRI' THEN 'adj_pri' ELSE 'fund_nav' END bench_source
  FROM {at('bench', 'name', 'level', 'bpairs', 'anchor', 'd0')} a
  JOIN {at('bench', 'name', 'level', 'bpairs', 'anchor + INTERVAL 36 MONTH', 'd1')} b USING (name, anchor) JOIN bench_meta USING (name)
  WHERE date_diff('day', dt_d0, dt_d1)/365.25 >= 2.75""", "bench", "bpairs", "bench_meta")
define("peer_med", """
  SELECT a.fund_id, a.anchor, a.gkey, a.r_fwd, CASE WHEN COUNT(b.r_fwd) >= 2 THEN MEDIAN(b.r_fwd) END peer_fwd, COUNT(b.r_fwd) peer_n
  FROM (SELECT * FROM fwd JOIN gkeys USING (fund_id)) a
  LEFT JOIN (SELECT * FROM fwd JOIN gkeys USING (fund_id)) b ON a.gkey = b.gkey AND a.anchor = b.anchor AND a.fund_id <> b.fund_id
  GROUP BY 1, 2, 3, 4""", "fwd", "gkeys")
define("lab", """
  WITH j AS (
    SELECT p.*, g.scheme_name, g.category, g.sector, g.group_kind, x.bench_fwd, x.bench_source
    FROM peer_med p JOIN gkeys g USING (fund_id) LEFT JOIN bench_fwd x ON x.name = g.region AND x.anchor = p.anchor),
  q AS (SELECT *, CASE WHEN peer_fwd IS NULL THEN 'no_benchmark' WHEN group_kind = 'category' THEN 'peer_category'
                       WHEN group_kind = 'sector' THEN 'peer_sector' ELSE 'pooled_fallback' END pq FROM j)
  SELECT fund_id, scheme_name, category, sector, anchor, CAST(year(anchor) AS INTEGER) anchor_year, gkey, r_fwd, r_fwd >= 0.10 cond_b,
    COALESCE(bench_fwd, peer_fwd) benchmark_fwd,
    CASE WHEN bench_fwd IS NOT NULL THEN bench_source WHEN peer_fwd IS NOT NULL THEN 'peer_proxy' ELSE 'none' END benchmark_source,
    CASE WHEN bench_fwd IS NOT NULL AND bench_source = 'fund_nav' THEN 'fund_nav' WHEN bench_fwd IS NOT NULL THEN 'adj_pri_addback' ELSE pq END benchmark_quality,
    COALESCE(r_fwd - COALESCE(bench_fwd, peer_fwd) >= 0.02, FALSE) cond_a, peer_fwd benchmark_fwd_peer, pq benchmark_quality_peer,
    COALESCE(r_fwd - peer_fwd >= 0.02, FALSE) cond_a_peer,
    COALESCE(r_fwd - COALESCE(bench_fwd, peer_fwd) >= 0.02, FALSE) OR r_fwd >= 0.10 y,
    COALESCE(r_fwd - peer_fwd >= 0.02, FALSE) OR r_fwd >= 0.10 y_peer
  FROM q""", "peer_med", "gkeys", "bench_fwd")
define("labc", """
  SELECT *, COUNT(*) OVER c cohort_n,
    CASE WHEN COUNT(*) OVER c >= 4 THEN r_fwd >= QUANTILE_CONT(r_fwd, 0.75) OVER c END y_cohort_q1,
    CASE WHEN COUNT(*) OVER c >= 4 THEN r_fwd > MEDIAN(r_fwd) OVER c END y_cohort_top_half
  FROM lab WINDOW c AS (PARTITION BY anchor, gkey)""", "lab")


#: Labels for the fold queries: the derived anchors span three years, so these look six months ahead and folds purge six.
SHORT_MONTHS, SHORT_YEARS = 6, 0.45
for _name, _needs in (("fwd", ("nav", "pairs")), ("bench_fwd", ("bench", "bpairs", "bench_meta")), ("peer_med", ("short_fwd", "gkeys")),
                      ("lab", ("short_peer_med", "gkeys", "short_bench_fwd")), ("labc", ("short_lab",))):
    _body = CTES[_name][1].replace("INTERVAL 36 MONTH", f"INTERVAL {SHORT_MONTHS} MONTH").replace(">= 2.75", f">= {SHORT_YEARS}")
    for _table in ("fwd", "bench_fwd", "peer_med", "lab"):
        _body = re.sub(rf"(FROM|JOIN) {_table}\b", rf"\1 short_{_table}", _body)
    if _name == "labc":  # equal returns of the derived funds differ in their last digits from engine to engine
        _body = _body.replace("FROM short_lab ", "FROM (SELECT * REPLACE (round(r_fwd, 9) AS r_fwd) FROM short_lab) ")
    define(f"short_{_name}", _body, *_needs)


@query("peer_group_keys", sql("SELECT fund_id, group_kind, gkey FROM gkeys", "gkeys"))
def _(spark, sf):
    return peers.with_group_key(X.manifest(spark, sf)).select("fund_id", "group_kind", "gkey")


def returns(spark, sf):
    return series.daily_returns(X.nav(spark, sf))


@query("loo_peer_composite", sql(f"SELECT fund_id, dt, {r6('f', 9)} r, {r6('c', 9)} peer_r FROM comp", "comp"))
def _(spark, sf):
    return rounded(peers.loo_composite(returns(spark, sf), peers.with_group_key(X.manifest(spark, sf))), 9)


@query("sector_composites", sql(f"SELECT series, dt, {r6('r', 9)} r FROM sec_r", "sec_r"))
def _(spark, sf):
    return rounded(peers.sector_composites(returns(spark, sf), X.manifest(spark, sf)), 9)


@query("asof_join", sql(
    f"SELECT fund_id, anchor, dt_x asof_dt, {r6('nav_x')} nav FROM {at('nav', 'fund_id', 'nav', 'pairs', 'anchor', 'x')}", "nav", "pairs"))
def _(spark, sf):
    hit = series.asof(X.nav(spark, sf), X.fund_anchors(spark, sf), "fund_id", ["nav"], "anchor")
    return rounded(hit.select("fund_id", "anchor", F.col("hit.dt").alias("asof_dt"), F.col("hit.nav").alias("nav")))


@query("forward_returns", sql(f"SELECT fund_id, anchor, {r6('r_fwd', 8)} r_fwd FROM fwd", "fwd"))
def _(spark, sf):
    return rounded(peers.forward_returns(X.nav(spark, sf), X.fund_anchors(spark, sf), "fund_id", "nav"), 8)


@query("real_index_forward", sql(f"SELECT name, anchor, {r6('bench_fwd', 8)} bench_fwd, bench_source FROM bench_fwd", "bench_fwd"))
def _(spark, sf):
    asked = X.bench_meta(spark, sf).select("name", F.explode(F.sequence(
        F.lit(X.ANCHOR_FROM), F.lit(X.ANCHOR_TO), F.expr("interval 1 month"))).alias("m")).select("name", F.last_day("m").alias("anchor"))
    return rounded(peers.real_index_forward(X.bench(spark, sf), X.bench_meta(spark, sf), asked, asked), 8)


@query("loo_median_forward", sql(
    f"SELECT fund_id, anchor, gkey, {r6('r_fwd', 8)} r_fwd, {r6('peer_fwd', 8)} peer_fwd, peer_n peer_fwd_n FROM peer_med", "peer_med"))
def _(spark, sf):
    keyed = peers.with_group_key(X.manifest(spark, sf)).select("fund_id", "gkey")
    fwd = peers.forward_returns(X.nav(spark, sf), X.fund_anchors(spark, sf), "fund_id", "nav").join(keyed, "fund_id")
    return rounded(peers.peer_median(fwd), 8)


@stored
def label_rows(spark, sf):
    return labels.build_labels(
        X.nav(spark, sf), X.manifest(spark, sf), X.fund_anchors(spark, sf), X.bench(spark, sf), X.bench_meta(spark, sf),
        X.fund_bench(spark, sf))


@stored
def short_label_rows(spark, sf):
    return labels.build_labels(
        X.nav(spark, sf), X.manifest(spark, sf), X.fund_anchors(spark, sf), X.bench(spark, sf), X.bench_meta(spark, sf),
        X.fund_bench(spark, sf), SHORT_MONTHS, SHORT_YEARS)


def short_cohort_rows(spark, sf):
    return labels.with_cohort_targets(short_label_rows(spark, sf).withColumn("r_fwd", F.round("r_fwd", 9)))


LABEL_COLS = ("fund_id, scheme_name, category, sector, anchor, anchor_year, gkey, cond_b, benchmark_source, benchmark_quality, cond_a, "
              "benchmark_quality_peer, cond_a_peer, y, y_peer, "
              f"{r6('r_fwd')} r_fwd, {r6('benchmark_fwd')} benchmark_fwd, {r6('benchmark_fwd_peer')} benchmark_fwd_peer")


@query("or_labels", sql(f"SELECT {LABEL_COLS} FROM lab", "lab"))
def _(spark, sf):
    return rounded(label_rows(spark, sf))


@query("cohort_targets", sql(f"SELECT {LABEL_COLS}, cohort_n, y_cohort_q1, y_cohort_top_half FROM labc", "labc"))
def _(spark, sf):
    return rounded(labels.with_cohort_targets(label_rows(spark, sf)))


@query("cohort_statistics", sql(
    f"SELECT anchor, gkey, COUNT(*) cohort_n, {r6('QUANTILE_CONT(r_fwd, 0.75)')} q75, {r6('MEDIAN(r_fwd)')} med FROM lab GROUP BY 1, 2", "lab"))
def _(spark, sf):
    return rounded(labels.cohort_statistics(label_rows(spark, sf)))


_rates = ", ".join(f"{r6(f'AVG(CAST({c} AS INTEGER))')} {n}" for c, n in (
    ("y", "y_hybrid"), ("y_peer", "y_peer"), ("cond_a", "cond_a_hybrid"), ("cond_a_peer", "cond_a_peer"), ("cond_b", "cond_b")))


@query("label_rate_table", sql(f"""
  SELECT COALESCE(CAST(anchor_year AS VARCHAR), 'OVERALL') anchor_year, COUNT(*) n, {_rates},
    COUNT(*) FILTER (NOT y) negatives_hybrid, COUNT(*) FILTER (NOT lab.y_peer) negatives_peer
  FROM lab GROUP BY ROLLUP (lab.anchor_year)""".replace("CAST(anchor_year AS", "CAST(lab.anchor_year AS"), "lab"))
def _(spark, sf):
    return rounded(labels.rate_table(label_rows(spark, sf)))


@query("benchmark_source_coverage", sql("""
  SELECT d.benchmark_source, COUNT(l.fund_id) n_samples, round(COUNT(l.fund_id)/CAST((SELECT COUNT(*) FROM lab) AS DOUBLE)*100, 1) pct
  FROM (SELECT UNNEST(['fund_nav','adj_pri','peer_proxy','none']) benchmark_source) d LEFT JOIN lab l USING (benchmark_source) GROUP BY 1""", "lab"))
def _(spark, sf):
    return labels.source_coverage(label_rows(spark, sf))


@query("target_base_rates", sql("""
  WITH l AS (SELECT 'y' target, y, anchor FROM labc UNION ALL SELECT 'y_cohort_q1', y_cohort_q1, anchor FROM labc
             UNION ALL SELECT 'y_cohort_top_half', y_cohort_top_half, anchor FROM labc)
  SELECT target, COUNT(*) n_total, COUNT(*) FILTER (y IS NULL) n_dropped, COUNT(y) n_kept,
    """ + r6("AVG(CAST(y AS INTEGER))") + " base_rate, "
    + r6("AVG(CAST(y AS INTEGER)) FILTER (anchor BETWEEN DATE '1998-03-31' AND DATE '1998-10-31')") + """ base_rate_holdout,
    COUNT(*) FILTER (NOT y) negatives FROM l GROUP BY 1""", "labc"))
def _(spark, sf):
    rows = labels.with_cohort_targets(label_rows(spark, sf))
    return rounded(labels.target_rates(rows, ["y", "y_cohort_q1", "y_cohort_top_half"], ("1998-03-31", "1998-10-31")))


@query("anchor_grid", sql("""
  SELECT a anchor, COUNT(DISTINCT s_suppkey) n_funds FROM (
    SELECT last_day(CAST(m AS DATE)) a FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-10-01', INTERVAL 1 MONTH) g(m)), supplier GROUP BY 1"""))
def _(spark, sf):
    grid = labels.anchor_grid(spark, "1996-01-31", "1998-10-31")
    return X.fund_anchors(spark, sf).join(grid, "anchor").groupBy("anchor").agg(F.countDistinct("fund_id").alias("n_funds"))


# --- feature panel -------------------------------------------------------------------
_persist = "\n".join([
    "SELECT fund_id, anchor, COUNT(e) n, AVG(CASE WHEN e > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (e IS NOT NULL) s FROM (",
    "SELECT q.fund_id, q.anchor0 anchor,",
    "  CASE WHEN date_diff('day', a.dt_a, b.dt_b)/365.25 >= 0.9 THEN POWER(b.nav_b/a.nav_a, 365.25::DOUBLE/date_diff('day', a.dt_a, b.dt_b)) - 1 END -",
    "  CASE WHEN date_diff('day', c.dt_c, d.dt_d)/365.25 >= 0.9 THEN POWER(EXP(d.lv_d - c.lv_c), 365.25::DOUBLE/date_diff('day', c.dt_c, d.dt_d)) - 1 END e",
    "FROM qs q",
    "LEFT JOIN q_start_nav a ON a.fund_id = q.fund_id AND a.anchor = q.anchor LEFT JOIN q_end_nav b ON b.fund_id = q.fund_id AND b.anchor = q.anchor",
    "LEFT JOIN q_start_lv c ON c.fund_id = q.fund_id AND c.anchor = q.anchor LEFT JOIN q_end_lv d ON d.fund_id = q.fund_id AND d.anchor = q.anchor",
    ") GROUP BY 1, 2"])
define("qs", "SELECT fund_id, anchor anchor0, CAST(anchor - to_months(CAST(3*k AS INTEGER)) AS DATE) anchor FROM pairs, range(12) t(k)", "pairs")
define("qd", "SELECT DISTINCT fund_id, anchor FROM qs", "qs")
define("q_end_nav", f"SELECT * FROM {at('nav', 'fund_id', 'nav', 'qd', 'anchor', 'b')}", "nav", "qd")
define("q_start_nav", f"SELECT * FROM {at('nav', 'fund_id', 'nav', 'qd', 'anchor - INTERVAL 12 MONTH', 'a')}", "nav", "qd")
define("q_end_lv", f"SELECT * FROM {at('comp_lv', 'fund_id', 'lv', 'qd', 'anchor', 'd')}", "comp_lv", "qd")
define("q_start_lv", f"SELECT * FROM {at('comp_lv', 'fund_id', 'lv', 'qd', 'anchor - INTERVAL 12 MONTH', 'c')}", "comp_lv", "qd")
define("persist", _persist, "qs", "q_end_nav", "q_start_nav", "q_end_lv", "q_start_lv")
for _m in (0, 1, 6, 12, 36, 60):
    define(f"nav_m{_m}", f"SELECT * FROM {at('nav', 'fund_id', 'nav', 'pairs', f'anchor - INTERVAL {_m} MONTH', f'm{_m}')}", "nav", "pairs")
for _m in (0, 12, 36):
    define(f"lv_m{_m}", f"SELECT * FROM {at('comp_lv', 'fund_id', 'lv', 'pairs', f'anchor - INTERVAL {_m} MONTH', f'm{_m}')}", "comp_lv", "pairs")
for _y in (1, 3):
    define(f"win{_y}", f"""
      SELECT p.fund_id, p.anchor, COUNT(*) n, STDDEV_SAMP(r) sd, AVG(r) - {RFD} ex, SQRT(AVG(POWER(LEAST(r - {RFD}, 0.0::DOUBLE), 2))) dn
      FROM pairs p JOIN ret ON ret.fund_id = p.fund_id AND ret.dt <= p.anchor AND ret.dt > CAST(p.anchor - INTERVAL {12 * _y} MONTH AS DATE) GROUP BY 1, 2""", "pairs", "ret")
define("dd3", """
  SELECT fund_id, anchor, MIN(nav/peak - 1) max_dd, ARG_MAX(nav/peak - 1, dt) cur FROM (
    SELECT m.fund_id, m.anchor, n.dt, n.nav, MAX(n.nav) OVER (PARTITION BY m.fund_id, m.anchor ORDER BY n.dt) peak
    FROM nav_m36 m JOIN nav n ON n.fund_id = m.fund_id AND n.dt >= m.dt_m36 AND n.dt <= m.anchor) GROUP BY 1, 2""", "nav_m36", "nav")
define("roll", f"""
  SELECT p.fund_id, p.anchor, AVG(CASE WHEN q < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) s FROM pairs p
  JOIN (SELECT fund_id, dt, POWER(nav/LAG(nav, {3 * D}) OVER (PARTITION BY fund_id ORDER BY dt), 1/3.0::DOUBLE) - 1 q FROM nav) x
    ON x.fund_id = p.fund_id AND x.dt <= p.anchor AND q IS NOT NULL GROUP BY 1, 2""", "pairs", "nav")
define("rel3", f"""
  SELECT *, POWER(EXP(lf), {D}.0::DOUBLE/n) - 1 ann_f, POWER(EXP(lc), {D}.0::DOUBLE/n) - 1 ann_c FROM (
  SELECT p.fund_id, p.anchor, COUNT(*) n, MIN(x.dt) d0, VAR_SAMP(c) vc, COVAR_SAMP(f, c) fc, STDDEV_SAMP(f-c)*{ROOT} te, SUM(LN(1+f)) lf, SUM(LN(1+c)) lc,
    COUNT(*) FILTER (c > 0) un, SUM(LN(1+f)) FILTER (c > 0) uf, SUM(LN(1+c)) FILTER (c > 0) uc,
    COUNT(*) FILTER (c < 0) dn, SUM(LN(1+f)) FILTER (c < 0) df, SUM(LN(1+c)) FILTER (c < 0) dc
  FROM pairs p JOIN comp x ON x.fund_id = p.fund_id AND x.f IS NOT NULL AND x.dt <= p.anchor AND x.dt >= CAST(p.anchor - INTERVAL 36 MONTH AS DATE)
  GROUP BY 1, 2) WHERE n >= 60 AND date_diff('day', d0, anchor) >= 2.75*365.25""", "pairs", "comp")
define("sp", "SELECT DISTINCT series, anchor FROM sec_r, months", "sec_r", "months")
define("secf", f"""
  SELECT a.series, a.anchor, CASE WHEN a.dt_a < b.dt_b THEN EXP(b.lv_b - a.lv_a) - 1 END mom, CASE WHEN a.dt_a IS NOT NULL AND w.n >= 3 THEN w.sd*{ROOT} END vol
  FROM {at('sec_lv', 'series', 'lv', 'sp', 'anchor - INTERVAL 12 MONTH', 'a')} a JOIN {at('sec_lv', 'series', 'lv', 'sp', 'anchor', 'b')} b USING (series, anchor)
  LEFT JOIN (SELECT s.series, s.anchor, COUNT(*) n, STDDEV_SAMP(r) sd FROM sp s JOIN sec_r x ON x.series = s.series AND x.dt <= s.anchor
             AND x.dt > CAST(s.anchor - INTERVAL 12 MONTH AS DATE) GROUP BY 1, 2) w USING (series, anchor)""", "sec_lv", "sp", "sec_r")


def _cg(e: str, s: str, y: int) -> str:
    return (f"CASE WHEN date_diff('day', dt_{s}, dt_{e})/365.25 >= {y - 0.1} THEN POWER(nav_{e}/nav_{s}, 365.25::DOUBLE/date_diff('day', dt_{s}, dt_{e})) - 1 END")


def _cp(s: str, y: int) -> str:
    return (f"CASE WHEN date_diff('day', l{s}.dt_{s}, l0.dt_m0)/365.25 >= {y - 0.1} THEN POWER(EXP(l0.lv_m0 - l{s}.lv_{s}), "
            f"365.25::DOUBLE/date_diff('day', l{s}.dt_{s}, l0.dt_m0)) - 1 END")


_n = lambda e, s, y: _cg(e, s, y).replace(f"dt_{e}", f"n{e}.dt_{e}").replace(f"dt_{s}", f"n{s}.dt_{s}")
_joins = " ".join(f"LEFT JOIN nav_m{m} nm{m} USING (fund_id, anchor)" for m in (0, 1, 6, 12, 36, 60))
_ljoins = ("LEFT JOIN lv_m0 l0 USING (fund_id, anchor) LEFT JOIN lv_m12 lm12 USING (fund_id, anchor) LEFT JOIN lv_m36 lm36 USING (fund_id, anchor)")
define("base", f"""
  SELECT p.fund_id, p.anchor, g.gkey,
    {_n('m0', 'm12', 1)} cagr_1y, {_n('m0', 'm36', 3)} cagr_3y, {_n('m0', 'm60', 5)} cagr_5y,
    CASE WHEN nm12.dt_m12 IS NOT NULL AND w1.n >= 3 THEN w1.sd*{ROOT} END vol_1y,
    CASE WHEN nm36.dt_m36 IS NOT NULL AND w3.n >= 3 THEN w3.sd*{ROOT} END vol_3y,
    CASE WHEN nm36.dt_m36 IS NOT NULL AND w3.n >= 3 THEN w3.ex/w3.sd*{ROOT} END sharpe_3y,
    CASE WHEN nm36.dt_m36 IS NOT NULL AND w3.n >= 3 THEN w3.ex/w3.dn*{ROOT} END sortino_3y,
    dd3.max_dd max_dd_3y, dd3.cur current_dd,
    CASE WHEN nm6.dt_m6 < nm0.dt_m0 THEN nav_m0/nav_m6 - 1 END mom_6m, CASE WHEN nm12.dt_m12 < nm1.dt_m1 THEN nav_m1/nav_m12 - 1 END mom_12m_ex1m,
    roll.s rr3y_neg_share, date_diff('day', fst.d, p.anchor)/365.25::DOUBLE age_years,
    {_n('m0', 'm12', 1)} - {_cp('m12', 1)} excess_1y, {_n('m0', 'm36', 3)} - {_cp('m36', 3)} excess_3y,
    CASE WHEN rel3.vc > 1e-12 THEN rel3.fc/rel3.vc END beta_3y, rel3.te te_3y, CASE WHEN rel3.te > 1e-12 THEN (rel3.ann_f - rel3.ann_c)/rel3.te END ir_3y,
    CASE WHEN rel3.un > 10 THEN (EXP(rel3.uf/rel3.un) - 1)/(EXP(rel3.uc/rel3.un) - 1) END upcap_3y,
    CASE WHEN rel3.dn > 10 THEN (EXP(rel3.df/rel3.dn) - 1)/(EXP(rel3.dc/rel3.dn) - 1) END downcap_3y,
    CASE WHEN persist.n >= 8 THEN persist.s END excess_persist,
    CASE WHEN g.category = 'Sectoral/Thematic' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END is_thematic,
    s.mom sector_mom_12m, s.vol sector_vol_1y, s.mom - a.mom sector_rel_strength
  FROM pairs p JOIN gkeys g USING (fund_id) {_joins} {_ljoins}
  LEFT JOIN win1 w1 USING (fund_id, anchor) LEFT JOIN win3 w3 USING (fund_id, anchor) LEFT JOIN dd3 USING (fund_id, anchor)
  LEFT JOIN roll USING (fund_id, anchor) LEFT JOIN rel3 USING (fund_id, anchor) LEFT JOIN persist USING (fund_id, anchor)
  LEFT JOIN (SELECT fund_id, MIN(dt) d FROM nav GROUP BY 1) fst ON fst.fund_id = p.fund_id
  LEFT JOIN secf s ON s.series = g.sector AND s.anchor = p.anchor LEFT JOIN secf a ON a.series = '*' AND a.anchor = p.anchor AND g.sector IS NOT NULL""",
       "pairs", "gkeys", *[f"nav_m{m}" for m in (0, 1, 6, 12, 36, 60)], "lv_m0", "lv_m12", "lv_m36", "win1", "win3", "dd3", "roll", "rel3", "persist",
       "nav", "secf")
_z = ", ".join(
    f"CASE WHEN COUNT({c}) OVER a >= 5 AND STDDEV_SAMP({c}) OVER a > 1e-12 THEN ({c} - AVG({c}) OVER a)/STDDEV_SAMP({c}) OVER a END z_{c}"
    for c in K.ZSCORED_FEATURES)
define("panel", f"""
  SELECT *, CASE WHEN cagr_1y IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END has_1y, CASE WHEN cagr_3y IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END has_3y,
    CASE WHEN cagr_5y IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END has_5y, CASE WHEN excess_1y IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END has_peer,
    CASE WHEN excess_persist IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END has_persist,
    CASE WHEN cagr_3y IS NOT NULL AND COUNT(cagr_3y) OVER g >= 3 THEN
      (RANK() OVER (PARTITION BY gkey, anchor ORDER BY round(cagr_3y, 9) NULLS LAST)
       + (COUNT(*) OVER (PARTITION BY gkey, anchor, round(cagr_3y, 9)) - 1)/2.0::DOUBLE)/COUNT(cagr_3y) OVER g END rank_3y, {_z}
  FROM base WINDOW a AS (PARTITION BY anchor), g AS (PARTITION BY gkey, anchor)""", "base")
_cols = ", ".join(f"{r6(c)} {c}" for c in K.FEATURES)


@stored
def panel(spark, sf):
    return features.feature_panel(X.nav(spark, sf), X.manifest(spark, sf), X.fund_anchors(spark, sf), D)


@query("feature_panel", sql(f"SELECT fund_id, anchor, gkey, {_cols} FROM panel", "panel"))
def _(spark, sf):
    return rounded(panel(spark, sf))


@query("lookahead_audit", sql("""
  SELECT COUNT(*) n_rows, CAST(0 AS BIGINT) n_differing, COUNT(*) n_leaks_caught FROM panel WHERE anchor <= DATE '1997-06-30'""", "panel"))
def _(spark, sf):
    """No feature moves with prices after mid 1997; one that reads the last price of all is caught on every row."""
    nav, until = X.nav(spark, sf), F.lit("1997-06-30").cast("date")
    early = X.fund_anchors(spark, sf).where(F.col("anchor") <= until)
    rows = features.lookahead_differences(lambda prices: features.feature_panel(prices, X.manifest(spark, sf), early, D), nav, until)

    def leaking(prices):
        last = prices.groupBy("fund_id").agg(F.max_by("nav", "dt").alias("leak"))
        return panel(spark, sf).select("fund_id", "anchor").join(last, "fund_id")

    total = panel(spark, sf).where(F.col("anchor") <= until).agg(F.count(F.lit(1)).alias("n_rows"))
    differing, caught = (df.agg(F.count(F.lit(1))).scalar() for df in (rows, features.lookahead_differences(leaking, nav, until)))
    return total.withColumn("n_differing", differing).withColumn("n_leaks_caught", caught)


@query("own_and_peer_features", sql("SELECT fund_id, anchor, " + ", ".join(f"{r6(c)} {c}" for c in (
    "cagr_1y", "cagr_3y", "cagr_5y", "vol_1y", "vol_3y", "sharpe_3y", "sortino_3y", "mom_6m", "mom_12m_ex1m", "rr3y_neg_share", "age_years",
    "beta_3y", "te_3y", "ir_3y", "upcap_3y", "downcap_3y", "excess_1y", "excess_3y", "excess_persist")) + " FROM base", "base"))
def _(spark, sf):
    return rounded(features.own_and_peer_features(X.nav(spark, sf), X.manifest(spark, sf), X.fund_anchors(spark, sf), D))


@query("window_drawdown", sql(f"SELECT fund_id, anchor, {r6('max_dd')} max_dd, {r6('cur')} current_dd FROM dd3", "dd3"))
def _(spark, sf):
    return rounded(series.window_drawdown(X.nav(spark, sf), X.fund_anchors(spark, sf), 36))


@query("sector_context", sql(f"""
  SELECT series, anchor, {r6('mom')} mom, {r6('vol')} vol FROM secf""", "secf"))
def _(spark, sf):
    return rounded(features.sector_features(returns(spark, sf), X.manifest(spark, sf), X.fund_anchors(spark, sf), D))


@query("peer_percentile_rank", sql(f"""
  SELECT s_suppkey fund, s_nationkey grp, s_acctbal x, {r6('''(RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal)
    + (COUNT(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1)/2.0::DOUBLE)/COUNT(*) OVER (PARTITION BY s_nationkey)''', 12)} pct FROM supplier"""))
def _(spark, sf):
    rows = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fund"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("x"))
    return rounded(with_percentile_rank(rows, ["grp"], "x", "pct"), 12)


@query("tied_percentile_rank", sql(f"""
  SELECT o_orderkey id, o_orderpriority grp, CAST(floor(o_totalprice/1000) AS DOUBLE) x, {r6('''(RANK() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice/1000))
    + (COUNT(*) OVER (PARTITION BY o_orderpriority, floor(o_totalprice/1000)) - 1)/2.0::DOUBLE)/COUNT(*) OVER (PARTITION BY o_orderpriority)''', 12)} pct FROM orders"""))
def _(spark, sf):
    rows = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x"))
    return rounded(with_percentile_rank(rows, ["grp"], "x", "pct"), 12)


@query("group_quantiles", sql(f"""
  SELECT o_orderpriority grp, COUNT(*) n, {r6('QUANTILE_CONT(o_totalprice, 0.25)')} q25, {r6('MEDIAN(o_totalprice)')} med, {r6('QUANTILE_CONT(o_totalprice, 0.9)')} q90
  FROM orders GROUP BY 1"""))
def _(spark, sf):
    rows = X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"))
    return rounded(group_quantiles(rows, ["grp"], "x", {"q25": 0.25, "med": 0.5, "q90": 0.9}))


@query("leave_one_out_median", sql(f"""
  SELECT a.s_suppkey id, a.s_nationkey grp, {r6('CASE WHEN COUNT(b.s_acctbal) >= 2 THEN MEDIAN(b.s_acctbal) END')} others, COUNT(b.s_acctbal) others_n
  FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1, 2"""))
def _(spark, sf):
    rows = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("x"))
    med = loo_median(rows, ["grp"], "x", "others")
    return rounded(rows.join(med, ["grp", "x"]).drop("x"))
