"""Mandate findings, alerts, eligibility, utility, verdict, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import alerts, compliance, curation, holdings, metrics, records, suitability
from ..session import stored
from . import fixtures as X
from . import holdings_queries as H
from . import ledger_queries as L
from . import text_queries as T
from .metrics_queries import ALERT
from .oracle import define, r6, sql
from .registry import query, rounded

D = X.OBS_PER_YEAR
CATS = ("Large Cap", "Mid Cap", "Flexi Cap", "Thematic", "Sectoral Debt", "Aggressive Hybrid", "Arbitrage", "Index Fund", "Retirement/Children (legacy)", "Odd")
BUCKETS = ("Equity", "Equity", "Equity", "Equity", "Debt", "Hybrid", "Hybrid", "Other (Index/ETF/FoF)", "Solution Oriented (DISCONTINUED)", "Equity")
PREFIX = ("Steady", "Assured", "Multibagger", "Double", "Plain")


def sql_pick(items, index: str) -> str:
    return f"{T.sql_list(items)}[CAST(({index}) AS BIGINT) % {len(items)} + 1]"


define("cfunds", f"""
  SELECT fund_id, {sql_pick(PREFIX, 'CAST(fund_id AS BIGINT)')} || ' ' || {sql_pick(CATS, 'CAST(fund_id AS BIGINT) + CAST(fund_id AS BIGINT) // 30')} || ' Fund' scheme_name,
    {sql_pick(CATS, 'CAST(fund_id AS BIGINT)')} category, {sql_pick(BUCKETS, 'CAST(fund_id AS BIGINT)')} bucket, amc,
    CASE WHEN CAST(fund_id AS BIGINT) % 20 = 3 THEN 'Brand#1' END declared_sector,
    CASE WHEN CAST(fund_id AS BIGINT) % 4 > 0 THEN CAST(CAST(fund_id AS BIGINT) % 25 AS DOUBLE)/1000 END expense_ratio FROM manifest""", "manifest")


@stored
def funds(spark, sf):
    k = F.col("fund_id").cast("bigint")
    name = F.concat(T.choose(PREFIX, k), F.lit(" "), T.choose(CATS, k + F.floor(k / 30)), F.lit(" Fund"))
    return X.manifest(spark, sf).select(
        "fund_id", name.alias("scheme_name"), T.choose(CATS, k).alias("category"), T.choose(BUCKETS, k).alias("bucket"), "amc",
        F.when(k % 20 == 3, "Brand#1").alias("declared_sector"), F.when(k % 4 > 0, (k % 25).cast("double") / 1000).alias("expense_ratio"))


define("cbook", """
  SELECT h.* FROM holdings h JOIN snaps s ON s.fund_id = h.fund_id AND s.as_of = h.as_of AND s.label = 'current' WHERE CAST(h.fund_id AS BIGINT) % 9 <> 5""", "holdings", "snaps")


@stored
def current_book(spark, sf):
    """The newest disclosure of every fund; every ninth house has published none."""
    return newest_book(spark, sf).where(F.col("fund_id").cast("bigint") % 9 != 5)


def newest_book(spark, sf):
    book = X.holdings(spark, sf)
    snaps = holdings.snapshots(book.select("fund_id", "as_of").distinct(), F.lit(X.TODAY)).where("label = 'current'")
    return book.join(snaps.select("fund_id", "as_of"), ["fund_id", "as_of"], "left_semi")


_rules = ", ".join("(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE") for v in r) + ")" for r in K.CATEGORY_RULES)
define("rules", f"SELECT * FROM (VALUES {_rules}) r(category, bucket, segment, segment_floor, equity_floor, overlap_cap, overlap_scope)")
define("ctot", """
  SELECT fund_id, COALESCE(SUM(weight) FILTER (asset_type = 'equity'), 0) eq, COALESCE(SUM(weight) FILTER (asset_type = 'equity' AND cap_band = 'large'), 0) lg,
    COALESCE(SUM(weight) FILTER (asset_type = 'equity' AND cap_band = 'mid'), 0) md, COALESCE(SUM(weight) FILTER (asset_type = 'equity' AND sector = 'Brand#1'), 0) wd,
    COUNT(*) FILTER (asset_type = 'equity') n_eq, COUNT(*) FILTER (asset_type = 'equity' AND weight > 0.10 + 1e-9) nb FROM cbook GROUP BY 1""", "cbook")
define("cdebt", "SELECT fund_id, MAX(w) ds FROM (SELECT fund_id, sector, SUM(weight) w FROM cbook WHERE asset_type = 'debt' GROUP BY 1, 2) GROUP BY 1", "cbook")
define("findings", """
  WITH j AS (SELECT f.fund_id, f.scheme_name, f.category, f.declared_sector, r.bucket, r.segment, r.segment_floor, r.equity_floor, t.*, COALESCE(d.ds, 0) ds
             FROM cfunds f LEFT JOIN rules r USING (category) LEFT JOIN (SELECT fund_id tid, * EXCLUDE (fund_id) FROM ctot) t ON t.tid = f.fund_id LEFT JOIN cdebt d ON d.fund_id = f.fund_id),
  x AS (
    SELECT fund_id, 'category_known' rule_id, FALSE passed, 'warning' sev FROM j WHERE bucket IS NULL
    UNION ALL SELECT fund_id, 'solution_oriented_discontinued', FALSE, 'critical' FROM j WHERE bucket LIKE 'Solution%'
    UNION ALL SELECT fund_id, 'cap_fidelity_min_equity_and_overlap_checks', FALSE, 'warning' FROM j WHERE bucket IS NOT NULL AND eq IS NULL
    UNION ALL SELECT fund_id, 'cap_fidelity_' || segment || '>= ' || CAST(CAST(round(segment_floor*100) AS INTEGER) AS VARCHAR) || '%', CASE segment WHEN 'large' THEN lg ELSE md END >= segment_floor - 1e-9, 'critical'
      FROM j WHERE eq IS NOT NULL AND segment IN ('large', 'mid')
    UNION ALL SELECT fund_id, 'sector_theme_fidelity>=80%', wd >= 0.8 - 1e-9, 'critical' FROM j WHERE eq IS NOT NULL AND segment LIKE 'declared%' AND declared_sector IS NOT NULL
    UNION ALL SELECT fund_id, 'sectoral_debt>=80%_single_sector', ds >= 0.8, 'critical' FROM j WHERE eq IS NOT NULL AND segment = 'single_sector_debt'
    UNION ALL SELECT fund_id, 'min_equity>=' || CAST(CAST(round(equity_floor*100) AS INTEGER) AS VARCHAR) || '%', eq >= equity_floor - 1e-9, 'critical' FROM j WHERE eq IS NOT NULL AND equity_floor IS NOT NULL
    UNION ALL SELECT fund_id, 'single_issuer<=10%', nb = 0, 'critical' FROM j WHERE bucket IN ('Equity', 'Hybrid') AND n_eq > 0
    UNION ALL SELECT fund_id, 'scheme_name_matches_category', contains(lower(scheme_name), lower(category)), 'warning' FROM j WHERE bucket IS NOT NULL
    UNION ALL SELECT fund_id, 'no_return_focused_words_in_name', NOT regexp_matches(lower(scheme_name), 'assured|multibagger|double'), 'warning' FROM j WHERE bucket IS NOT NULL)
  SELECT fund_id, rule_id, passed, CASE WHEN passed THEN 'info' ELSE sev END severity FROM x""", "cfunds", "rules", "ctot", "cdebt")


@stored
def findings(spark, sf):
    return compliance.verify(funds(spark, sf), current_book(spark, sf))


@query("mandate_findings", sql("SELECT * FROM findings", "findings"))
def _(spark, sf):
    return findings(spark, sf).select("fund_id", "rule_id", "passed", "severity")


define("ofind", """
  SELECT s.fund_id, 'overlap_vs[' || s.other_id || ']<=50%' rule_id, o.x <= 0.5 + 1e-9 passed, CASE WHEN o.x <= 0.5 + 1e-9 THEN 'info' ELSE 'critical' END severity
  FROM sib s JOIN (SELECT fund_id, other_id, AVG(overlap) x FROM dover GROUP BY 1, 2) o USING (fund_id, other_id)
  JOIN (SELECT DISTINCT fund_id FROM holdings) h ON h.fund_id = s.fund_id""", "sib", "dover", "holdings")


@query("overlap_findings", sql("SELECT * FROM ofind", "ofind"))
def _(spark, sf):
    named = H.rule_funds(spark, sf).select("fund_id", "category", F.col("category").alias("scheme_name"), F.lit(None).cast("string").alias("declared_sector"))
    days = holdings.sibling_overlap(X.daily_weights(spark, sf), H.rule_funds(spark, sf), compliance.rule_table(spark), "all")
    mean = days.select("fund_id", "other_id", (F.col("overlap") / F.col("n_days")).alias("overlap"))
    out = compliance.verify(named, newest_book(spark, sf), mean)
    return out.where(F.col("rule_id").startswith("overlap_vs")).select("fund_id", "rule_id", "passed", "severity")


_code = """CASE WHEN rule_id LIKE 'cap_fidelity_min_equity%' THEN 'SEBI_CHECKS_NOT_EVALUATED' WHEN rule_id LIKE 'cap_fidelity%' THEN 'SEBI_CAP_FIDELITY_BREACH'
    WHEN rule_id LIKE 'sector%' THEN 'SEBI_SECTOR_FIDELITY_BREACH' WHEN rule_id LIKE 'min_equity%' THEN 'SEBI_MIN_EQUITY_BREACH' WHEN rule_id LIKE 'solution%' THEN 'SEBI_CATEGORY_DISCONTINUED'
    WHEN rule_id = 'category_known' THEN 'SEBI_CATEGORY_UNKNOWN' WHEN rule_id LIKE 'scheme_name%' THEN 'NAME_CATEGORY_MISMATCH' WHEN rule_id LIKE 'no_return%' THEN 'RETURN_FOCUSED_NAME'
    ELSE 'SEBI_SINGLE_ISSUER_BREACH' END"""
define("calerts", f"""
  SELECT fund_id, code, CASE WHEN severity = 'critical' THEN 'HIGH' WHEN code IN ('SEBI_CHECKS_NOT_EVALUATED', 'SEBI_CATEGORY_UNKNOWN') THEN 'INFO' ELSE 'WATCH' END severity, 'compliance' source,
    CASE WHEN code IN ('SEBI_CHECKS_NOT_EVALUATED', 'SEBI_CATEGORY_UNKNOWN') AND severity <> 'critical' THEN 'COVERAGE' ELSE 'REGULATORY' END basis
  FROM (SELECT *, {_code} code FROM findings WHERE NOT passed)""", "findings")
SHORT = ("fund_id", "code", "severity", "source", "basis")


@query("compliance_alerts", sql("SELECT * FROM calerts", "calerts"))
def _(spark, sf):
    return alerts.compliance_alerts(findings(spark, sf)).select(*SHORT)


# --- eligibility: a customer is a scheme, its orders are its observations ----------------
ELIG_TODAY = "1998-08-02"
define("elig", f"""
  WITH a AS (SELECT c_custkey, c_acctbal, COUNT(o_orderkey)*60 n_obs, MIN(CAST(o_orderdate AS DATE)) allotment_date FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
  s AS (SELECT *, (allotment_date IS NULL AND n_obs = 0) OR COALESCE(allotment_date > DATE '{ELIG_TODAY}', FALSE) unborn, date_diff('day', allotment_date, DATE '{ELIG_TODAY}') age FROM a)
  SELECT CAST(c_custkey AS VARCHAR) fund_id, n_obs, allotment_date, c_acctbal > 0 has_disclosure,
    CASE WHEN unborn THEN 'PRE_LAUNCH' WHEN age < 182 THEN 'NEWBORN' WHEN age < 1095 THEN 'YOUNG' ELSE 'EVALUABLE' END status, CASE WHEN NOT unborn THEN age END age_days,
    CASE WHEN unborn THEN 8 ELSE 8 - (CASE WHEN n_obs >= 60 THEN 2 ELSE 0 END) - (CASE WHEN n_obs >= 126 THEN 2 ELSE 0 END) - (CASE WHEN n_obs >= 756 THEN 2 ELSE 0 END)
      - (CASE WHEN n_obs >= 1260 THEN 1 ELSE 0 END) - CAST(c_acctbal > 0 AS INTEGER) END n_blocked FROM s""")


@stored
def eligible(spark, sf):
    o = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.to_date("o_orderdate")).alias("allotment_date"))
    rows = X.table(spark, sf, "customer").join(o, "c_custkey", "left").select(
        F.col("c_custkey").cast("string").alias("fund_id"), (F.coalesce("_n", F.lit(0)) * 60).alias("n_obs"), "allotment_date",
        (F.col("c_acctbal") > 0).alias("has_disclosure"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("aum_cr"),
        F.when(F.col("c_custkey") % 3 == 0, 0.012).alias("expense_ratio"))
    return suitability.eligibility(rows, F.lit(ELIG_TODAY).cast("date"))


@query("eligibility_gate", sql("SELECT * FROM elig", "elig"))
def _(spark, sf):
    return eligible(spark, sf).select("fund_id", "n_obs", "allotment_date", "has_disclosure", "status", "age_days", F.size("blocked").alias("n_blocked"))


@stored
def prior_by_fund(spark, sf):
    key = F.col("fund_id").cast("bigint")
    asked = eligible(spark, sf).select(
        "fund_id", F.concat(F.lit("Manager "), (key % 400).cast("string")).alias("manager_name"), F.concat(F.lit("Scheme "), (key % 700).cast("string")).alias("exclude_scheme"))
    good = curation.validate_managers(T.manager_file(spark, sf))[0]
    found = curation.prior_funds(good, asked)
    return asked.join(found, ["manager_name", "exclude_scheme"], "left").select("fund_id", "prior_funds")


define("prior", """
  SELECT e.fund_id, COUNT(DISTINCT g.scheme_name) n FROM elig e LEFT JOIN mgrc g ON g.err IS NULL AND g.manager_name = 'Manager ' || CAST(CAST(e.fund_id AS BIGINT) % 400 AS VARCHAR)
    AND g.scheme_name <> 'Scheme ' || CAST(CAST(e.fund_id AS BIGINT) % 700 AS VARCHAR) GROUP BY 1""", "elig", "mgrc")


@query("new_fund_dossiers", sql("""
  SELECT e.fund_id, status, n_blocked, p.n n_prior, CAST((c_custkey % 3 = 0) AS INTEGER) + CAST((c_custkey % 2 = 0) AS INTEGER) n_structural
  FROM elig e JOIN prior p USING (fund_id) JOIN customer ON CAST(c_custkey AS VARCHAR) = e.fund_id WHERE status IN ('PRE_LAUNCH', 'NEWBORN')""", "elig", "prior"))
def _(spark, sf):
    out = suitability.new_fund_dossiers(eligible(spark, sf), prior_by_fund(spark, sf))
    return out.select("fund_id", "status", F.size("blocked").alias("n_blocked"), F.size("prior_funds").cast("bigint").alias("n_prior"), F.size("structural").alias("n_structural"))


@query("new_fund_alerts", sql("""
  SELECT fund_id, 'NFO_NO_TRACK_RECORD' code, 'INFO' severity, 'nfo' source, 'COVERAGE' basis FROM elig WHERE status IN ('PRE_LAUNCH', 'NEWBORN')
  UNION ALL SELECT fund_id, 'NFO_MANAGER_PROXY_UNAVAILABLE', 'INFO', 'nfo', 'COVERAGE' FROM elig JOIN prior USING (fund_id) WHERE status IN ('PRE_LAUNCH', 'NEWBORN') AND n = 0
  UNION ALL SELECT fund_id, 'NFO_SHORT_HISTORY', 'INFO', 'nfo', 'COVERAGE' FROM elig WHERE status = 'YOUNG'""", "elig", "prior"))
def _(spark, sf):
    rows = eligible(spark, sf).join(prior_by_fund(spark, sf), "fund_id").withColumn("has_prior_funds", F.col("prior_funds").isNotNull())
    return alerts.new_fund_alerts(rows).select(*SHORT)


# --- factor, holdings, manager and news alerts -------------------------------------------
define("fin", """
  SELECT a.*, f.category, f.bucket, f.expense_ratio, CASE WHEN CAST(f.fund_id AS BIGINT) % 13 = 7 THEN 'YOUNG' ELSE 'EVALUABLE' END eligibility
  FROM alert_metrics a JOIN cfunds f USING (fund_id)""", "alert_metrics", "cfunds")
_f = "SELECT fund_id, '{c}' code, '{s}' severity, 'factor' source, '{b}' basis FROM fin WHERE eligibility = 'EVALUABLE' AND bucket = '{k}' AND {w}"
_factor_rules = [
    ("EQ_CAPTURE_ASYMMETRY", "WATCH", "GUARDRAIL_ONLY", "Equity", "downside_capture - upside_capture >= 0.10 AND downside_capture > 1.0"),
    ("EQ_DOWNSIDE_CAPTURE_HIGH", "WATCH", "GUARDRAIL_ONLY", "Equity", "NOT (downside_capture - upside_capture >= 0.10 AND downside_capture > 1.0) AND downside_capture > 1.15"),
    ("EQ_UPSIDE_CAPTURE_LOW", "INFO", "GUARDRAIL_ONLY", "Equity", "upside_capture < 0.80"),
    ("EQ_BENCHMARK_LAG", "WATCH", "DESCRIPTIVE_RISK", "Equity", "excess_cagr_3y <= -0.02"),
    ("EQ_BETA_DRIFT", "WATCH", "DESCRIPTIVE_RISK", "Equity", "abs(beta - 1) > 0.35 AND category IN ('Large Cap','Mid Cap','Small Cap','Flexi Cap','Large & Mid Cap')"),
    ("EQ_BETA_DRIFT", "INFO", "DESCRIPTIVE_RISK", "Equity", "abs(beta - 1) > 0.35 AND category NOT IN ('Large Cap','Mid Cap','Small Cap','Flexi Cap','Large & Mid Cap')"),
    ("EQ_DRAWDOWN_VS_BENCH", "WATCH", "DESCRIPTIVE_RISK", "Equity", "max_dd_3y - benchmark_max_dd_3y <= -0.10"),
    ("EQ_DRAWDOWN_DEEP", "WATCH", "DESCRIPTIVE_RISK", "Equity", "max_dd_3y <= -0.40"),
    ("EQ_DRAWDOWN_DEEP", "INFO", "DESCRIPTIVE_RISK", "Equity", "max_dd_3y > -0.40 AND max_dd_3y <= -0.30"),
    ("EQ_ROLL3Y_NEGATIVE_SHARE", "WATCH", "DESCRIPTIVE_RISK", "Equity", "rr3y_negative_share > 0.20"),
    ("EQ_ROLL3Y_NEGATIVE_SHARE", "INFO", "DESCRIPTIVE_RISK", "Equity", "rr3y_negative_share > 0.10 AND rr3y_negative_share <= 0.20"),
    ("EQ_SORTINO_NEGATIVE", "INFO", "DESCRIPTIVE_RISK", "Equity", "sortino < 0"),
    ("EQ_EXPENSE_HIGH", "WATCH", "CAUSAL_COST", "Equity", "expense_ratio >= 0.020"),
    ("EQ_EXPENSE_HIGH", "INFO", "CAUSAL_COST", "Equity", "expense_ratio >= 0.015 AND expense_ratio < 0.020"),
    ("PASSIVE_TRACKING_ERROR_BREACH", "HIGH", "REGULATORY", "Other (Index/ETF/FoF)", "tracking_error > 0.02"),
    ("PASSIVE_TRACKING_ERROR_HIGH", "WATCH", "DESCRIPTIVE_RISK", "Other (Index/ETF/FoF)", "tracking_error > 0.01 AND tracking_error <= 0.02"),
    ("PASSIVE_TRACKING_ERROR_HIGH", "INFO", "DESCRIPTIVE_RISK", "Other (Index/ETF/FoF)", "tracking_error > 0.005 AND tracking_error <= 0.01"),
    ("PASSIVE_TRACKING_DIFF_POOR", "WATCH", "DESCRIPTIVE_RISK", "Other (Index/ETF/FoF)", "tracking_difference_tri <= -0.015"),
    ("PASSIVE_EXPENSE_ABOVE_REG_CAP", "HIGH", "REGULATORY", "Other (Index/ETF/FoF)", "expense_ratio > 0.010"),
    ("PASSIVE_EXPENSE_HIGH", "WATCH", "CAUSAL_COST", "Other (Index/ETF/FoF)", "expense_ratio >= 0.0075 AND expense_ratio <= 0.010"),
    ("PASSIVE_EXPENSE_HIGH", "INFO", "CAUSAL_COST", "Other (Index/ETF/FoF)", "expense_ratio >= 0.005 AND expense_ratio < 0.0075"),
    ("HY_BENCHMARK_LAG", "WATCH", "DESCRIPTIVE_RISK", "Hybrid", "excess_cagr_3y <= -0.02"),
    ("HY_DOWNSIDE_CAPTURE_HIGH", "WATCH", "GUARDRAIL_ONLY", "Hybrid", "downside_capture > 1.15"),
    ("HY_DRAWDOWN_DEEP", "WATCH", "DESCRIPTIVE_RISK", "Hybrid", "max_dd_3y <= -0.30"),
    ("HY_EXPENSE_HIGH", "WATCH", "CAUSAL_COST", "Hybrid", "expense_ratio >= 0.020"),
    ("HY_EXPENSE_HIGH", "INFO", "CAUSAL_COST", "Hybrid", "expense_ratio >= 0.015 AND expense_ratio < 0.020"),
    ("DEBT_NEGATIVE_3Y_WINDOW", "WATCH", "DESCRIPTIVE_RISK", "Debt", "rr3y_negative_share > 0"),
    ("DEBT_EXPENSE_HIGH", "WATCH", "CAUSAL_COST", "Debt", "expense_ratio >= 0.010"),
    ("DEBT_EXPENSE_HIGH", "INFO", "CAUSAL_COST", "Debt", "expense_ratio >= 0.0075 AND expense_ratio < 0.010"),
]
define("falerts", " UNION ALL ".join(_f.format(c=c, s=s, b=b, k=k, w=w) for c, s, b, k, w in _factor_rules), "fin")


@stored
def factor_parts(spark, sf):
    m = metrics.alert_metrics(X.nav(spark, sf), X.bench(spark, sf), X.fund_bench(spark, sf), D)
    young = F.col("fund_id").cast("bigint") % 13 == 7
    rows = m.join(funds(spark, sf), "fund_id").withColumn("eligibility", F.when(young, "YOUNG").otherwise("EVALUABLE"))
    return alerts.factor_alerts(rows)


@query("factor_alerts", sql("SELECT * FROM falerts", "falerts"))
def _(spark, sf):
    return alerts.explode_alerts(factor_parts(spark, sf)).select(*SHORT)


define("fdorm", f"""
  SELECT fund_id, CAST(eligibility = 'EVALUABLE' AND bucket NOT LIKE 'Solution%' AS INTEGER) checks_run,
    CASE WHEN eligibility <> 'EVALUABLE' THEN 1 WHEN bucket LIKE 'Solution%' THEN 1 ELSE CAST(expense_ratio IS NULL AS INTEGER)
      + CASE WHEN bucket = 'Debt' THEN {len(K.DORMANT_DEBT)} WHEN category = 'Arbitrage' THEN {len(K.DORMANT_ARBITRAGE)} ELSE 0 END END n_dormant FROM fin""", "fin")


@query("factor_rules_dormant", sql("SELECT * FROM fdorm", "fdorm"))
def _(spark, sf):
    return factor_parts(spark, sf).select("fund_id", "checks_run", F.size("dormant").alias("n_dormant"))


define("halerts", """
  SELECT b.fund_id, CASE WHEN top10_weight >= 0.65 THEN 'WATCH' ELSE 'INFO' END severity FROM bfacts b WHERE n_equity > 0 AND top10_weight >= 0.45""", "bfacts")


def order_funds(spark, sf):
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("fund_id"), F.lit("Equity").alias("bucket"))


@query("holdings_concentration_alerts", sql("""
  SELECT fund_id, 'HOLDINGS_CONCENTRATION_HIGH' code, severity, 'holdings' source, 'DESCRIPTIVE_RISK' basis FROM halerts""", "halerts"))
def _(spark, sf):
    parts = alerts.holdings_alerts(order_funds(spark, sf), holdings.structure_facts(X.order_books(spark, sf)))
    return alerts.explode_alerts(parts).select(*SHORT)


define("malerts", f"""
  WITH c AS (SELECT lower(scheme_name) k, ARG_MAX(start_date, (start_date, end_date IS NULL, CAST(row_no AS BIGINT))) sd FROM mgrc WHERE err IS NULL GROUP BY 1),
  s AS (SELECT fund_id, macs, date_diff('day', sd, DATE '2001-11-15') tenure FROM macs LEFT JOIN c ON c.k = 'scheme ' || CAST(CAST(fund_id AS BIGINT) % 700 AS VARCHAR))
  SELECT fund_id, 'MANAGER_PICKS_UNDERPERFORMED' code, 'WATCH' severity, 'manager' source, 'MANAGER_HISTORY' basis FROM s WHERE macs < 40
  UNION ALL SELECT fund_id, 'MANAGER_ALPHA_NOT_EVIDENCED', 'INFO', 'manager', 'MANAGER_HISTORY' FROM s WHERE macs >= 40 AND macs < 60
  UNION ALL SELECT fund_id, 'MANAGER_TENURE_SHORT', 'INFO', 'manager', 'MANAGER_HISTORY' FROM s WHERE tenure < 365""", "macs", "mgrc")


@stored
def manager_alert_rows(spark, sf):
    scores = holdings.manager_score(H.audit_rows(spark, sf)).withColumn(
        "scheme_key", F.concat(F.lit("scheme "), (F.col("fund_id").cast("bigint") % 700).cast("string")))
    current = curation.current_manager(curation.validate_managers(T.manager_file(spark, sf))[0])
    return alerts.manager_alerts(scores, current, F.lit(X.TODAY))


@query("manager_alerts", sql("SELECT * FROM malerts", "malerts"))
def _(spark, sf):
    return manager_alert_rows(spark, sf).select(*SHORT)


define("nalerts", """
  SELECT m.fund_id, 'REGULATORY_NEWS_KEYWORD' code, 'WATCH' severity, 'news' source, 'NEWS_KEYWORD' basis FROM manifest m JOIN news n ON n.entity = m.fund_id
  WHERE headline IN ('sebi seeks clarification', 'ban on new units')""", "manifest", "news")


def news_alert_rows(spark, sf):
    flagged = H.news(spark, sf).where("is_flag").select(F.col("entity").alias("fund_id"), "headline")
    return alerts.news_alerts(flagged.join(X.manifest(spark, sf), "fund_id", "left_semi"))


@query("news_alerts", sql("SELECT * FROM nalerts", "nalerts"))
def _(spark, sf):
    return news_alert_rows(spark, sf).select(*SHORT)


define("all_alerts", """
  SELECT fund_id, code, severity, source, basis, CASE severity WHEN 'HIGH' THEN 0 WHEN 'WATCH' THEN 1 ELSE 2 END severity_rank FROM (
    SELECT * FROM calerts UNION ALL SELECT * FROM falerts UNION ALL SELECT * FROM malerts UNION ALL SELECT * FROM nalerts)""", "calerts", "falerts", "malerts", "nalerts")


@stored
def all_alerts(spark, sf):
    return alerts.assemble([alerts.compliance_alerts(findings(spark, sf)), alerts.explode_alerts(factor_parts(spark, sf)),
                            manager_alert_rows(spark, sf), news_alert_rows(spark, sf)])


@query("alert_assembly", sql("SELECT * FROM all_alerts", "all_alerts"))
def _(spark, sf):
    return all_alerts(spark, sf).drop("evidence")


@query("alert_severity_cap", sql(f"""
  SELECT basis, COUNT(*) n, COUNT(*) FILTER (severity = 'HIGH' AND basis IN {K.NEVER_HIGH_BASES}) n_violations FROM all_alerts GROUP BY 1""", "all_alerts"))
def _(spark, sf):
    rows = all_alerts(spark, sf)
    bad = alerts.severity_violations(rows).groupBy("basis").agg(F.count(F.lit(1)).alias("v"))
    return rows.groupBy("basis").agg(F.count(F.lit(1)).alias("n")).join(bad, "basis", "left").select("basis", "n", F.coalesce("v", F.lit(0)).alias("n_violations"))


@query("alert_report", sql("""
  SELECT f.fund_id, COUNT(a.code) n_alerts, COUNT(a.code) FILTER (severity = 'HIGH') n_high, COUNT(a.code) FILTER (severity = 'WATCH') n_watch, COUNT(a.code) FILTER (severity = 'INFO') n_info,
    (SELECT COUNT(*) FROM findings x WHERE x.fund_id = f.fund_id) + COALESCE((SELECT checks_run FROM fdorm d WHERE d.fund_id = f.fund_id), 0) checks_run,
    COALESCE((SELECT n_dormant FROM fdorm d WHERE d.fund_id = f.fund_id), 0) n_dormant
  FROM cfunds f LEFT JOIN all_alerts a USING (fund_id) GROUP BY f.fund_id""", "cfunds", "all_alerts", "findings", "fdorm"))
def _(spark, sf):
    out = alerts.report(all_alerts(spark, sf), [factor_parts(spark, sf)], findings(spark, sf), funds(spark, sf))
    return out.select("fund_id", "n_alerts", "n_high", "n_watch", "n_info", "checks_run", F.size("checks_dormant").alias("n_dormant"))


# --- utility and verdict -----------------------------------------------------------------
NEEDS, RISKS = ("none", "partial", "high"), ("conservative", "moderate", "high")
define("uprof", f"""
  SELECT c_custkey profile_id, CAST(c_custkey % 12 AS DOUBLE) + 0.5 horizon_years, {sql_pick(NEEDS, 'c_custkey')} liquidity_need, {sql_pick(RISKS, 'c_custkey // 3')} risk_appetite FROM customer""")


def _weights_sql(src: str) -> str:
    return f"""
  WITH w AS (SELECT *,
    GREATEST(0.40::DOUBLE + CASE risk_appetite WHEN 'conservative' THEN -0.15 WHEN 'moderate' THEN -0.07 ELSE 0 END::DOUBLE + CASE WHEN horizon_years < 4 THEN -0.12 WHEN horizon_years >= 7 THEN 0.05 ELSE 0 END::DOUBLE
      + CASE liquidity_need WHEN 'high' THEN -0.16 WHEN 'partial' THEN -0.05 ELSE 0.04 END::DOUBLE, 0) g,
    GREATEST(0.15::DOUBLE + CASE risk_appetite WHEN 'conservative' THEN 0.15 WHEN 'moderate' THEN 0.07 ELSE 0 END::DOUBLE + CASE WHEN horizon_years < 4 THEN 0.08 WHEN horizon_years >= 7 THEN -0.05 ELSE 0 END::DOUBLE, 0) d,
    GREATEST(0.05::DOUBLE + CASE WHEN horizon_years < 4 THEN 0.04 ELSE 0 END::DOUBLE + CASE liquidity_need WHEN 'high' THEN 0.12 WHEN 'partial' THEN 0.05 ELSE -0.04 END::DOUBLE, 0) l,
    0.10::DOUBLE + CASE WHEN liquidity_need = 'high' THEN 0.04 ELSE 0 END::DOUBLE t FROM {src})
  SELECT profile_id, g/(g+d+l+t+0.30) w_growth, d/(g+d+l+t+0.30) w_downside, 0.20/(g+d+l+t+0.30) w_consistency, 0.10/(g+d+l+t+0.30) w_cost, l/(g+d+l+t+0.30) w_liquidity, t/(g+d+l+t+0.30) w_drift_thematic FROM w"""


W = tuple(f"w_{k}" for k in K.BASE_UTILITY_WEIGHTS)
define("uweights", _weights_sql("uprof"), "uprof")


@query("utility_weights", sql("SELECT profile_id, " + ", ".join(f"{r6(w)} {w}" for w in W) + " FROM uweights", "uweights"))
def _(spark, sf):
    k = F.col("c_custkey")
    profiles = X.table(spark, sf, "customer").select(
        k.alias("profile_id"), (k % 12 + 0.5).cast("double").alias("horizon_years"), T.choose(NEEDS, k).alias("liquidity_need"), T.choose(RISKS, F.floor(k / 3)).alias("risk_appetite"))
    return rounded(suitability.utility_weights(profiles).select("profile_id", *W))


define("seg", f"""
  SELECT c_mktsegment profile_id, CAST(ascii(c_mktsegment) - 65 AS DOUBLE) + 0.5 horizon_years, {sql_pick(NEEDS, 'ascii(c_mktsegment) - 65')} liquidity_need,
    {sql_pick(RISKS, 'ascii(c_mktsegment) - 64')} risk_appetite FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
define("segw", _weights_sql("seg"), "seg")
define("cband", """
  SELECT fund_id, COALESCE(SUM(weight) FILTER (asset_type = 'equity' AND cap_band = 'small'), 0) small_weight FROM cbook GROUP BY 1""", "cbook")
define("chf", """
  SELECT fund_id, MAX(sw) top_sector_weight FROM (SELECT fund_id, sector, SUM(weight) sw FROM cbook WHERE asset_type = 'equity' GROUP BY 1, 2) GROUP BY 1""", "cbook")
define("ctop", """
  SELECT fund_id, SUM(weight) top10_weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fund_id ORDER BY weight DESC, instrument) p FROM cbook WHERE asset_type = 'equity') WHERE p <= 10 GROUP BY 1""", "cbook")
_clip = lambda e: f"CASE WHEN ({e}) IS NOT NULL THEN GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, {e})) END"
define("subs", f"""
  WITH j AS (SELECT f.*, a.cagr, a.sortino, a.max_dd_3y, a.excess_cagr_3y, a.rr3y_negative_share negative_share, a.beta, b.small_weight, h.top_sector_weight, t.top10_weight,
      COALESCE(h.top_sector_weight, 0) tw FROM cfunds f JOIN alert_metrics a USING (fund_id) LEFT JOIN cband b USING (fund_id) LEFT JOIN chf h USING (fund_id) LEFT JOIN ctop t USING (fund_id))
  SELECT *, {_clip('(cagr - 0.06::DOUBLE)/0.14::DOUBLE')} growth, {_clip('(sortino + 0.5::DOUBLE)/2.5::DOUBLE')} downside, {_clip('1 - COALESCE(negative_share, 0.5)')} consistency,
    COALESCE({_clip('1 - expense_ratio/0.0225::DOUBLE')}, 0.5) AS cost, {_clip('1 - 0.9::DOUBLE*COALESCE(small_weight, 0) - 0.3::DOUBLE*GREATEST(tw - 0.4::DOUBLE, 0)')} liquidity,
    {_clip("1 - CASE WHEN category IN ('Sectoral','Thematic') AND tw > 0.75 THEN 0.6::DOUBLE ELSE 0 END - CASE WHEN bucket = 'Equity' AND COALESCE(abs(beta - 1) > 0.35, FALSE) THEN 0.4::DOUBLE ELSE 0 END")} drift_thematic FROM j""",
       "cfunds", "alert_metrics", "cband", "chf", "ctop")
SUBS = tuple(K.BASE_UTILITY_WEIGHTS)


@stored
def scored_funds(spark, sf):
    m = metrics.alert_metrics(X.nav(spark, sf), X.bench(spark, sf), X.fund_bench(spark, sf), D).select(
        "fund_id", "cagr", "sortino", "max_dd_3y", "excess_cagr_3y", F.col("rr3y_negative_share").alias("negative_share"), "beta")
    book = current_book(spark, sf)
    small = book.groupBy("fund_id").agg(F.coalesce(F.sum(F.when((F.col("asset_type") == "equity") & (F.col("cap_band") == "small"), F.col("weight"))), F.lit(0.0)).alias("small_weight"))
    facts = holdings.structure_facts(book).select("fund_id", "top_sector_weight", "top10_weight")
    rows = funds(spark, sf).join(m, "fund_id").join(small, "fund_id", "left").join(facts, "fund_id", "left")
    return suitability.sub_scores(rows)


@query("profile_sub_scores", sql("SELECT fund_id, " + ", ".join(f"{r6(c)} {c}" for c in SUBS) + " FROM subs", "subs"))
def _(spark, sf):
    return rounded(scored_funds(spark, sf).select("fund_id", *SUBS))


_util = " + ".join(f"w_{k}*{k}" for k in SUBS)
define("util", f"SELECT p.profile_id, s.*, round(100*({_util}), 1) utility_score FROM subs s, segw p", "subs", "segw")


@stored
def utilities(spark, sf):
    segments = X.table(spark, sf, "customer").select("c_mktsegment").distinct()
    # A market segment is an investor profile; its first letter sets the horizon and needs.
    i = F.ascii("c_mktsegment") - 65
    profiles = segments.select(
        F.col("c_mktsegment").alias("profile_id"), (i + 0.5).cast("double").alias("horizon_years"), T.choose(NEEDS, i).alias("liquidity_need"),
        T.choose(RISKS, i + 1).alias("risk_appetite"))
    return suitability.utility(scored_funds(spark, sf), suitability.utility_weights(profiles))


@query("profile_utility", sql("SELECT profile_id, fund_id, utility_score FROM util", "util"))
def _(spark, sf):
    return utilities(spark, sf).select("profile_id", "fund_id", "utility_score")


define("senti2", "SELECT fund_id, net_sentiment, n_red_flags FROM senti", "senti")
define("vin", """
  SELECT u.*, m.macs, COALESCE(c.nc, 0) n_critical, COALESCE(c.nw, 0) n_warning, s.net_sentiment, s.n_red_flags
  FROM util u LEFT JOIN (SELECT fund_id, macs FROM macs) m USING (fund_id)
  LEFT JOIN (SELECT fund_id, COUNT(*) FILTER (severity = 'critical') nc, COUNT(*) FILTER (severity = 'warning') nw FROM findings WHERE NOT passed GROUP BY 1) c USING (fund_id)
  LEFT JOIN senti2 s USING (fund_id)""", "util", "macs", "findings", "senti2")


def _band(x: str, g: float, b: float, high: bool = True) -> str:
    good, bad = (f"{x} >= {g}", f"{x} <= {b}") if high else (f"{x} <= {g}", f"{x} >= {b}")
    return f"CASE WHEN {x} IS NULL THEN 'grey' WHEN {good} THEN 'green' WHEN {bad} THEN 'red' ELSE 'amber' END"


define("colour", f"""
  SELECT *, {_band('cagr', 0.10, 0.06)} c_cagr, {_band('excess_cagr_3y', 0.01, -0.01)} c_excess, {_band('sortino', 0.75, 0.0)} c_sortino, {_band('max_dd_3y', -0.20, -0.35)} c_drawdown,
    {_band('consistency', 0.60, 0.40)} c_consistency, {_band('expense_ratio', 0.010, 0.020, False)} c_expense, {_band('top10_weight', 0.45, 0.65, False)} c_concentration,
    CASE WHEN n_critical > 0 THEN 'red' WHEN n_warning > 0 OR (bucket NOT LIKE 'Other%' AND macs IS NULL) THEN 'amber' ELSE 'green' END c_compliance,
    CASE WHEN utility_score >= 65 THEN 'green' WHEN utility_score < 45 THEN 'red' ELSE 'blue' END c_screen FROM vin""", "vin")
COLOURS = ("c_cagr", "c_excess", "c_sortino", "c_drawdown", "c_consistency", "c_expense", "c_concentration", "c_compliance", "c_screen")


@stored
def coloured(spark, sf):
    macs = holdings.manager_score(H.audit_rows(spark, sf)).select("fund_id", "macs")
    failed = findings(spark, sf).where(~F.col("passed")).groupBy("fund_id").agg(
        F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"))
    tone = H.sentiment_rows(spark, sf).select("fund_id", "net_sentiment", "n_red_flags")
    rows = utilities(spark, sf).join(macs, "fund_id", "left").join(failed, "fund_id", "left").join(tone, "fund_id", "left")
    return suitability.with_colours(rows.fillna(0, ["n_critical", "n_warning"]))


@query("metric_colours", sql(f"SELECT profile_id, fund_id, {', '.join(COLOURS)} FROM colour", "colour"))
def _(spark, sf):
    return coloured(spark, sf).select("profile_id", "fund_id", *COLOURS)


_v = lambda red: f"CASE WHEN breach OR reds >= 3 OR (reds > greens AND {red}) THEN 'SELL / AVOID' WHEN greens >= 3 AND reds = 0 AND NOT {red} THEN 'BUY' ELSE 'HOLD / WATCH' END"
_count = lambda colour: " + ".join(f"CAST({c} = '{colour}' AS INTEGER)" for c in suitability.CORE)
define("verdicts", f"""
  SELECT profile_id, fund_id, greens, reds, breach is_breach, {_v("c_screen = 'red'")} verdict, {_v('TRUE')} red_branch, {_v('FALSE')} other_branch
  FROM (SELECT *, {_count('green')} greens, {_count('red')} reds, n_critical > 0 OR COALESCE(n_red_flags, 0) > 0 breach FROM colour)""", "colour")


@query("rule_based_verdict", sql("SELECT * FROM verdicts", "verdicts"))
def _(spark, sf):
    out = suitability.with_verdict(coloured(spark, sf))
    return out.select("profile_id", "fund_id", "greens", "reds", "is_breach", "verdict", F.col("if_score_red.verdict").alias("red_branch"), F.col("if_score_not_red.verdict").alias("other_branch"))


@query("verdict_flags", sql("""
  SELECT profile_id, fund_id, CAST(bucket NOT LIKE 'Other%' AND macs IS NULL AS INTEGER) + CAST(expense_ratio IS NULL AS INTEGER) + CAST(excess_cagr_3y IS NULL AS INTEGER) n_coverage,
    GREATEST(1, CAST(COALESCE(macs >= 60, FALSE) AS INTEGER) + CAST(expense_ratio IS NOT NULL AND cost >= 0.7 AS INTEGER) + CAST(COALESCE(growth >= 0.6, FALSE) AS INTEGER) + CAST(COALESCE(net_sentiment > 0.3, FALSE) AS INTEGER)) n_observations
  FROM colour""", "colour"))
def _(spark, sf):
    return coloured(spark, sf).select("profile_id", "fund_id", F.size(suitability.coverage_flags()).alias("n_coverage"), F.size(suitability.observations()).alias("n_observations"))


@query("source_confidence", sql("""
  WITH r AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'Historical disclosures' ELSE o_orderpriority END source, CASE WHEN COUNT(*) FILTER (o_orderstatus = 'F')*2 > COUNT(*)*0.6 THEN 'READY' ELSE 'MISSING' END status FROM orders GROUP BY o_orderpriority),
  s AS (SELECT round(LEAST(1, 0.15::DOUBLE + 0.85::DOUBLE*COUNT(*) FILTER (status = 'READY')/COUNT(*)), 2) c, COALESCE(bool_or(source LIKE 'Hist%' AND status = 'READY'), FALSE) h FROM r)
  SELECT CASE WHEN h THEN c ELSE LEAST(c, 0.45::DOUBLE) END confidence FROM s"""))
def _(spark, sf):
    ready = F.count_if(F.col("o_orderstatus") == "F") * 2 > F.count(F.lit(1)) * 0.6
    rows = X.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.when(ready, "READY").otherwise("MISSING").alias("status")).select(
        F.when(F.col("o_orderpriority").startswith("1"), "Historical disclosures").otherwise(F.col("o_orderpriority")).alias("source"), "status")
    return suitability.confidence(rows)


# --- records -----------------------------------------------------------------------------
@stored
def record_rows(spark, sf):
    vol = metrics.recent_facts(X.nav(spark, sf), D).select("fund_id", "vol_1y")
    default = coloured(spark, sf).where(F.col("profile_id") == "BUILDING")
    rows = suitability.with_verdict(default).join(vol, "fund_id", "left").join(X.fund_bench(spark, sf).withColumnRenamed("name", "benchmark"), "fund_id", "left")
    young = F.col("fund_id").cast("bigint") % 13 == 7
    rows = rows.withColumn("eligibility", F.when(young, "YOUNG").otherwise("EVALUABLE")).withColumn("coverage_flags", suitability.coverage_flags())
    return records.fund_records(rows, L.live_scores(spark, sf), all_alerts(spark, sf))


@query("fund_records", sql(f"""
  SELECT c.fund_id, c.scheme_name, c.category, c.declared_sector sector, v.verdict, (SELECT COUNT(*) FROM all_alerts a WHERE a.fund_id = c.fund_id) n_alerts, {r6('c.cagr')} cagr, c.utility_score
  FROM colour c JOIN verdicts v USING (profile_id, fund_id) WHERE profile_id = 'BUILDING'""", "colour", "verdicts", "all_alerts"))
def _(spark, sf):
    out = record_rows(spark, sf).select(
        "fund_id", "scheme_name", "category", "sector", F.col("signal_a.verdict").alias("verdict"), F.size("alerts_b").cast("bigint").alias("n_alerts"),
        F.col("facts.cagr").alias("cagr"), F.col("signal_a.utility_score").alias("utility_score"))
    return rounded(out)


@query("batch_coverage")
def _(spark, sf):
    total = X.manifest(spark, sf).agg(F.count(F.lit(1))).scalar()
    return records.batch_coverage(record_rows(spark, sf), total)


@query("data_flags", sql("""
  SELECT c_custkey, list_filter([CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'SECTOR_UNMAPPED' END, CASE WHEN c_custkey % 5 = 0 THEN 'EXPENSE_UNAVAILABLE' END,
    CASE WHEN c_custkey % 4 IN (1, 2) THEN 'SHORT_HISTORY' END, ['THIN_COHORT', NULL, 'STALE_NAV', 'COHORT_UNSCORED_OTHER', NULL][c_custkey % 5 + 1]], lambda x: x IS NOT NULL) flags FROM customer"""), lists=('flags',))
def _(spark, sf):
    k = F.col("c_custkey")
    statuses = F.array(F.lit("THIN_COHORT"), F.lit("OK"), F.lit("STALE_NAV"), F.lit("NEW_STATUS"), F.lit(None))
    rows = X.table(spark, sf, "customer").select(
        k, T.choose(("Thematic", "ETF", "Large Cap", "Mid Cap"), k).alias("category"), F.when(k % 3 != 0, "Pharma").alias("declared_sector"), F.when(k % 5 != 0, 0.01).alias("expense_ratio"),
        T.choose(("EVALUABLE", "NEWBORN", "YOUNG", "EVALUABLE"), k).alias("eligibility"), statuses[(k % 5).cast("int")].alias("cohort_status"))
    return rows.select("c_custkey", records.data_flags().alias("flags"))
