"""Typed alerts from compliance findings, metrics, holdings, managers, age and news.

Every rule is gated on a present value: a missing metric raises nothing and is listed as
dormant where the rule could not run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import sorted_array
from .compliance import compliance_code

SHAPE = ("code", "severity", "source", "basis", "evidence")


def _alert(code: Column | str, severity: Column | str, source: str, basis: Column | str, *evidence: str) -> Column:
    def text(v: Column | str) -> Column:
        return F.lit(v) if isinstance(v, str) else v

    pairs: list[Column] = []
    for e in evidence:
        pairs += [F.lit(e), F.round(F.col(e).cast("double"), 4).cast("string")]
    held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(text(code).alias("code"), text(severity).alias("severity"), F.lit(source).alias("source"), text(basis).alias("basis"), held.alias("evidence"))


def _tiers(value: Column, *tiers: tuple[Column, Column]) -> Column:
    out = F.lit(None)
    for test, alert in reversed(tiers):
        out = F.when(test, alert).otherwise(out)
    return F.when(value.isNotNull(), out)


def equity_rules() -> list[Column]:
    dc, uc = F.col("downside_capture"), F.col("upside_capture")
    both = dc.isNotNull() & uc.isNotNull()
    asymmetric = both & (dc - uc >= 0.10) & (dc > 1.0)
    gap = F.col("max_dd_3y") - F.col("benchmark_max_dd_3y")
    guard, fact = "GUARDRAIL_ONLY", "DESCRIPTIVE_RISK"
    beta_severity = F.when(F.col("category").isin(*K.CAP_MANDATED), "WATCH").otherwise("INFO")
    return [
        F.when(asymmetric, _alert("EQ_CAPTURE_ASYMMETRY", "WATCH", "factor", guard, "downside_capture", "upside_capture"))
        .when(both & (dc > 1.15), _alert("EQ_DOWNSIDE_CAPTURE_HIGH", "WATCH", "factor", guard, "downside_capture")),
        F.when(uc < 0.80, _alert("EQ_UPSIDE_CAPTURE_LOW", "INFO", "factor", guard, "upside_capture")),
        F.when(F.col("excess_cagr_3y") <= -0.02, _alert("EQ_BENCHMARK_LAG", "WATCH", "factor", fact, "excess_cagr_3y", "info_ratio")),
        F.when(F.abs(F.col("beta") - 1.0) > 0.35, _alert("EQ_BETA_DRIFT", beta_severity, "factor", fact, "beta")),
        F.when(gap <= -0.10, _alert("EQ_DRAWDOWN_VS_BENCH", "WATCH", "factor", fact, "max_dd_3y", "benchmark_max_dd_3y")),
        F.when(F.col("max_dd_3y") <= -0.40, _alert("EQ_DRAWDOWN_DEEP", "WATCH", "factor", fact, "max_dd_3y"))
        .when(F.col("max_dd_3y") <= -0.30, _alert("EQ_DRAWDOWN_DEEP", "INFO", "factor", fact, "max_dd_3y")),
        F.when(F.col("rr3y_negative_share") > 0.20, _alert("EQ_ROLL3Y_NEGATIVE_SHARE", "WATCH", "factor", fact, "rr3y_negative_share"))
        .when(F.col("rr3y_negative_share") > 0.10, _alert("EQ_ROLL3Y_NEGATIVE_SHARE", "INFO", "factor", fact, "rr3y_negative_share")),
        F.when(F.col("sortino") < 0, _alert("EQ_SORTINO_NEGATIVE", "INFO", "factor", fact, "sortino")),
    ]


def passive_rules() -> list[Column]:
    te = F.col("tracking_error")
    return [
        F.when(te > 0.02, _alert("PASSIVE_TRACKING_ERROR_BREACH", "HIGH", "factor", "REGULATORY", "tracking_error"))
        .when(te > 0.01, _alert("PASSIVE_TRACKING_ERROR_HIGH", "WATCH", "factor", "DESCRIPTIVE_RISK", "tracking_error"))
        .when(te > 0.005, _alert("PASSIVE_TRACKING_ERROR_HIGH", "INFO", "factor", "DESCRIPTIVE_RISK", "tracking_error")),
        F.when(F.col("tracking_difference_tri") <= -0.015,
               _alert("PASSIVE_TRACKING_DIFF_POOR", "WATCH", "factor", "DESCRIPTIVE_RISK", "tracking_difference_tri")),
    ]


def hybrid_rules() -> list[Column]:
    return [
        F.when(F.col("excess_cagr_3y") <= -0.02, _alert("HY_BENCHMARK_LAG", "WATCH", "factor", "DESCRIPTIVE_RISK", "excess_cagr_3y")),
        F.when(F.col("downside_capture") > 1.15, _alert("HY_DOWNSIDE_CAPTURE_HIGH", "WATCH", "factor", "GUARDRAIL_ONLY", "downside_capture")),
        F.when(F.col("max_dd_3y") <= -0.30, _alert("HY_DRAWDOWN_DEEP", "WATCH", "factor", "DESCRIPTIVE_RISK", "max_dd_3y")),
    ]


def debt_rules() -> list[Column]:
    return [F.when(F.col("rr3y_negative_share") > 0, _alert("DEBT_NEGATIVE_3Y_WINDOW", "WATCH", "factor", "DESCRIPTIVE_RISK", "rr3y_negative_share"))]


def expense_rule(prefix: str, watch: float, info: float, breach: float | None = None) -> Column:
    ter = F.col("expense_ratio")
    out = (
        F.when(ter >= watch, _alert(f"{prefix}_EXPENSE_HIGH", "WATCH", "factor", "CAUSAL_COST", "expense_ratio"))
        .when(ter >= info, _alert(f"{prefix}_EXPENSE_HIGH", "INFO", "factor", "CAUSAL_COST", "expense_ratio"))
    )
    if breach is None:
        return out
    return F.when(ter > breach, _alert(f"{prefix}_EXPENSE_ABOVE_REG_CAP", "HIGH", "factor", "REGULATORY", "expense_ratio")).otherwise(out)


def _dormant(*codes: str) -> list[Column]:
    return [F.lit(c) for c in codes]


def factor_alerts(rows: DataFrame) -> DataFrame:
    """(fund_id, alerts, dormant, checks_run): the rules of the fund's bucket, only once evaluable.

    ``rows``: alert metrics with bucket, category, expense_ratio, eligibility.
    """
    blank = F.array().cast("array<string>")
    no_ter = F.col("expense_ratio").isNull()
    families = {
        "Equity": (equity_rules() + [expense_rule("EQ", 0.020, 0.015)], [F.when(no_ter, "EQ_EXPENSE_HIGH")]),
        "Other (Index/ETF/FoF)": (passive_rules() + [expense_rule("PASSIVE", 0.0075, 0.005, 0.010)], [F.when(no_ter, "PASSIVE_EXPENSE_HIGH")]),
        "Hybrid": (hybrid_rules() + [expense_rule("HY", 0.020, 0.015)],
                   [F.when(no_ter, "HY_EXPENSE_HIGH"), *[F.when(F.col("category") == "Arbitrage", c) for c in K.DORMANT_ARBITRAGE]]),
        "Debt": (debt_rules() + [expense_rule("DEBT", 0.010, 0.0075)], [F.when(no_ter, "DEBT_EXPENSE_HIGH"), *_dormant(*K.DORMANT_DEBT)]),
    }
    ready = F.col("eligibility") == "EVALUABLE"
    bucket = F.when(F.col("bucket") == "Life Cycle", "Hybrid").otherwise(F.col("bucket"))
    alerts, dormant, checks = None, None, F.lit(0)
    for name, (rules, sleeping) in families.items():
        here = ready & (bucket == name)
        raised, slept = F.when(here, sorted_array(*rules)), F.when(here, sorted_array(*sleeping))
        alerts = raised if alerts is None else F.coalesce(alerts, raised)
        dormant = slept if dormant is None else F.coalesce(dormant, slept)
        checks = F.when(here, 1).otherwise(checks)
    dormant = F.coalesce(
        dormant, F.when(~ready, F.array(F.concat(F.lit("FACTOR_RULES_SKIPPED_"), F.col("eligibility")))),
        F.when(bucket == "Solution Oriented (DISCONTINUED)", F.array(F.lit("FACTOR_RULES_SKIPPED_DISCONTINUED_CATEGORY"))), blank)
    return rows.select("fund_id", alerts.alias("alerts"), dormant.alias("dormant"), checks.alias("checks_run"))


def compliance_alerts(findings: DataFrame) -> DataFrame:
    """One alert per failed finding."""
    code = compliance_code("rule_id")
    coverage = code.isin("SEBI_CHECKS_NOT_EVALUATED", "SEBI_CATEGORY_UNKNOWN")
    critical = F.col("severity") == "critical"
    return findings.where(~F.col("passed")).select(
        "fund_id", code.alias("code"), F.when(critical, "HIGH").when(coverage, "INFO").otherwise("WATCH").alias("severity"),
        F.lit("compliance").alias("source"), F.when(coverage & ~critical, "COVERAGE").otherwise("REGULATORY").alias("basis"),
        F.create_map(F.lit("rule_id"), F.col("rule_id")).alias("evidence"))


def _exploded(rows: DataFrame, *rules: Column) -> DataFrame:
    return rows.select("fund_id", F.explode(sorted_array(*rules)).alias("a")).select("fund_id", "a.*")


def holdings_alerts(funds: DataFrame, facts: DataFrame) -> DataFrame:
    """(fund_id, alerts, dormant, checks_run) of the top-ten concentration rule; equity and hybrid only."""
    rows = funds.where(F.col("bucket").isin("Equity", "Hybrid")).select("fund_id").join(facts, "fund_id", "left")
    seen = F.coalesce(F.col("n_equity") > 0, F.lit(False)) & F.col("top10_weight").isNotNull()
    rule = (
        F.when(F.col("top10_weight") >= K.TOP10_CONCENTRATED, _alert("HOLDINGS_CONCENTRATION_HIGH", "WATCH", "holdings", "DESCRIPTIVE_RISK", "top10_weight", "effective_n"))
        .when(F.col("top10_weight") >= K.TOP10_DIVERSIFIED, _alert("HOLDINGS_CONCENTRATION_HIGH", "INFO", "holdings", "DESCRIPTIVE_RISK", "top10_weight", "effective_n"))
    )
    return rows.select("fund_id", sorted_array(F.when(seen, rule)).alias("alerts"),
                       sorted_array(F.when(~seen, "HOLDINGS_CONCENTRATION_HIGH")).alias("dormant"), seen.cast("int").alias("checks_run"))


def manager_alerts(scores: DataFrame, current: DataFrame | None, today: Column) -> DataFrame:
    """Consistency score and tenure alerts; ``scores`` (fund_id, scheme_key, macs)."""
    rows = scores
    if current is None:
        rows = rows.withColumn("tenure_days", F.lit(None).cast("int"))
    else:
        rows = rows.join(current.select("scheme_key", F.datediff(today, "start_date").alias("tenure_days")), "scheme_key", "left")
    return _exploded(
        rows,
        F.when(F.col("macs") < 40, _alert("MANAGER_PICKS_UNDERPERFORMED", "WATCH", "manager", "MANAGER_HISTORY", "macs"))
        .when(F.col("macs") < 60, _alert("MANAGER_ALPHA_NOT_EVIDENCED", "INFO", "manager", "MANAGER_HISTORY", "macs")),
        F.when(F.col("tenure_days") < 365, _alert("MANAGER_TENURE_SHORT", "INFO", "manager", "MANAGER_HISTORY", "tenure_days")))


def news_alerts(flagged: DataFrame) -> DataFrame:
    """One alert per regulatory headline; ``flagged`` (fund_id, headline)."""
    return flagged.select("fund_id", F.lit("REGULATORY_NEWS_KEYWORD").alias("code"), F.lit("WATCH").alias("severity"), F.lit("news").alias("source"),
                          F.lit("NEWS_KEYWORD").alias("basis"), F.create_map(F.lit("headline"), F.col("headline")).alias("evidence"))


def new_fund_alerts(eligibility: DataFrame) -> DataFrame:
    """Age alerts; ``eligibility`` has status and has_prior_funds."""
    young = F.col("status").isin("PRE_LAUNCH", "NEWBORN")

    def alert(code: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit("INFO").alias("severity"), F.lit("nfo").alias("source"), F.lit("COVERAGE").alias("basis"),
                        F.create_map(F.lit("status"), F.col("status")).alias("evidence"))

    return _exploded(eligibility, F.when(young, alert("NFO_NO_TRACK_RECORD")),
                     F.when(young & ~F.col("has_prior_funds"), alert("NFO_MANAGER_PROXY_UNAVAILABLE")),
                     F.when(F.col("status") == "YOUNG", alert("NFO_SHORT_HISTORY")))


def assemble(branches: list[DataFrame]) -> DataFrame:
    """All alert rows with the severity order 0 HIGH, 1 WATCH, 2 INFO."""
    out = branches[0].select("fund_id", *SHAPE)
    for b in branches[1:]:
        out = out.unionByName(b.select("fund_id", *SHAPE))
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "WATCH", 1).otherwise(2)
    return out.withColumn("severity_rank", rank)


def explode_alerts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("alerts").isNotNull()).select("fund_id", F.explode("alerts").alias("a")).select("fund_id", "a.*")


def severity_violations(alerts: DataFrame) -> DataFrame:
    """Alerts whose basis may never be HIGH but are; must be empty."""
    return alerts.where(F.col("basis").isin(*K.NEVER_HIGH_BASES) & (F.col("severity") == "HIGH"))


def report(alerts: DataFrame, parts: list[DataFrame], findings: DataFrame, funds: DataFrame) -> DataFrame:
    """Per fund: alert counts per severity, checks run and dormant codes."""
    counts = alerts.groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("n_alerts"), *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("HIGH", "WATCH", "INFO")])
    checks = findings.groupBy("fund_id").agg(F.count(F.lit(1)).alias("_c"))
    out = funds.select("fund_id").join(counts, "fund_id", "left").join(checks, "fund_id", "left")
    dormant, run = F.array().cast("array<string>"), F.coalesce("_c", F.lit(0))
    for i, p in enumerate(parts):
        out = out.join(p.select("fund_id", F.col("dormant").alias(f"_d{i}"), F.col("checks_run").alias(f"_n{i}")), "fund_id", "left")
        dormant = F.concat(dormant, F.coalesce(f"_d{i}", F.array().cast("array<string>")))
        run = run + F.coalesce(f"_n{i}", F.lit(0))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_alerts", "n_high", "n_watch", "n_info")]
    return out.select("fund_id", *zero, run.alias("checks_run"), dormant.alias("checks_dormant"))
