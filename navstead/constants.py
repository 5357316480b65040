"""Thresholds, vocabularies and lookup tables the results depend on."""

from __future__ import annotations

# --- Fixed values: calendar, rates and tolerances ---------------------------------
TRADING_DAYS = 252
RISK_FREE_ANNUAL = 0.0675
DAYS_PER_YEAR = 365.25
ASOF_TOLERANCE_DAYS = 10
FORWARD_YEARS = 3
MIN_FORWARD_YEARS = 2.75
DIVIDEND_ADDBACK = 0.013
STALE_MAX_DAYS = 30
MAX_FFILL_ROWS = 5
MIN_SERIES_OBS = 5

# --- Fixed values: price cleaning --------------------------------------------------
SPIKE_RETURN = 0.10
SPIKE_REVERSION = 0.5
PAYOUT_DROP = 0.03
BENCH_CALM = 0.015

# --- Fixed values: peers, cohorts, labels ------------------------------------------
MIN_LOO_PEERS = 2
MIN_JOINT_OBS = 60
MIN_JOINT_YEARS = 2.75
MIN_PERSIST_CHECKPOINTS = 8
PERSIST_CHECKPOINTS = 12
SMALL_SECTOR_BELOW = 3
COHORT_MIN_SIZE = 4
ABSOLUTE_HURDLE = 0.10
EXCESS_HURDLE = 0.02
SECTOR_KEYED = "Sectoral/Thematic"

# --- Fixed values: validation folds and model settings -----------------------------
MODEL_START = "2014-01-31"
FOLD_BLOCKS = (
    ("B1", "2014-01-31", "2015-12-31"),
    ("B2", "2016-01-31", "2017-12-31"),
    ("B3", "2018-01-31", "2019-12-31"),
    ("B4", "2020-01-31", "2021-12-31"),
    ("B5", "2022-01-31", "2023-07-31"),
)
HOLDOUT_TRAIN_END = "2019-07-31"
HOLDOUT_TEST = ("2022-08-31", "2023-07-31")
ANCHOR_GRID = ("2013-01-31", "2024-12-31")
EMBARGO_MONTHS = 1
CALIBRATION_SHARE = 0.25
ISOTONIC_MIN_ROWS = 300
ISOTONIC_MIN_MINORITY = 30
CALIBRATION_MIN_BLOCK = 30
EFFECTIVE_N_DIVISOR = 30
DECILE_SHARE = 0.10
CHALLENGER_MARGIN = 0.03
BOOTSTRAP_REPLICATES = 80
ELASTIC_NET = {"C": 0.1, "l1_ratio": 0.5}
ELASTIC_NET_GRID = (
    {"C": 0.03, "l1_ratio": 0.5},
    {"C": 1.0, "l1_ratio": 0.5},
    {"C": 0.1, "l1_ratio": 0.2},
    {"C": 0.1, "l1_ratio": 0.8},
)
BOOSTED_TREES = {"step": 0.06, "max_leaves": 15, "iterations": 300, "min_leaf": 40}
BOOSTED_TREES_GRID = (
    {"step": 0.1, "max_leaves": 15, "iterations": 300, "min_leaf": 40},
    {"step": 0.06, "max_leaves": 7, "iterations": 300, "min_leaf": 40},
    {"step": 0.06, "max_leaves": 31, "iterations": 300, "min_leaf": 40},
)

# --- Fixed values: feature columns -------------------------------------------------
BASE_FEATURES = (
    "cagr_1y", "cagr_3y", "cagr_5y", "vol_1y", "vol_3y", "sharpe_3y", "sortino_3y",
    "max_dd_3y", "current_dd", "mom_6m", "mom_12m_ex1m", "rr3y_neg_share", "age_years",
    "excess_1y", "excess_3y", "beta_3y", "te_3y", "ir_3y", "upcap_3y", "downcap_3y",
    "excess_persist", "is_thematic", "sector_mom_12m", "sector_vol_1y",
    "sector_rel_strength", "has_1y", "has_3y", "has_5y", "has_peer", "has_persist",
)
ZSCORED_FEATURES = (
    "cagr_1y", "cagr_3y", "cagr_5y", "mom_6m", "mom_12m_ex1m",
    "excess_1y", "excess_3y", "sector_mom_12m", "sector_rel_strength",
)
FEATURES = BASE_FEATURES + ("rank_3y",) + tuple(f"z_{c}" for c in ZSCORED_FEATURES)
DRIFT_FEATURES = (
    "cagr_1y", "cagr_3y", "cagr_5y", "vol_1y", "vol_3y", "sharpe_3y", "sortino_3y",
    "max_dd_3y", "current_dd", "mom_6m", "mom_12m_ex1m", "rr3y_neg_share",
    "excess_1y", "excess_3y", "beta_3y", "te_3y", "ir_3y", "upcap_3y", "downcap_3y",
    "excess_persist", "sector_mom_12m", "sector_vol_1y", "sector_rel_strength",
)

# --- Fixed values: drift, stability, health grades ---------------------------------
PSI_BINS = 10
PSI_MIN_UNIVERSE = 50
PSI_MIN_FINITE = 30
PSI_MODERATE = 0.10
PSI_SIGNIFICANT = 0.25
PSI_FLOOR = 1e-4
MIN_MATURED_FOR_IC = 50
MIN_COMMON_FOR_STABILITY = 20
STABILITY_GREEN, STABILITY_RED = 0.90, 0.70
ERROR_GREEN, ERROR_RED = 0.05, 0.20
LIFT_GREEN, LIFT_RED = 1.20, 1.00
TOP_TIER_PERCENTILE = 0.75
LEDGER_KEY = ("fund_id", "target", "anchor", "model_id")

# --- Fixed values: portfolio limits ------------------------------------------------
WEIGHT_SUM_BAND = (0.95, 1.05)
ISSUER_LIMIT = 0.10
GROUP_LIMIT = 0.20
ADV_PARTICIPATION = 0.20
YIELD_SHOCKS_BPS = (50, 100, 200)
TOP10_DIVERSIFIED = 0.45
TOP10_CONCENTRATED = 0.65
ASSET_TYPES = ("equity", "debt", "derivative", "cash")
CREDIT_SCORES = {
    "SOV": 0.0, "CASH": 0.0, "AAA": 1.0, "A1+": 1.0, "AA+": 2.0, "A1": 2.0, "AA": 3.0,
    "AA-": 4.0, "A2": 4.0, "A+": 5.0, "A": 6.0, "A-": 7.0, "BBB": 8.0, "<BBB": 10.0,
    "UNRATED": 9.0,
}
CREDIT_SCORE_UNKNOWN = 9.0

# --- Fixed values: metadata rules --------------------------------------------------
SEBI_BUCKETS = ("Equity", "Debt", "Hybrid", "Solution Oriented", "Index/ETF")
MAX_EXPENSE_RATIO = 0.0275
TRI_BENCHMARKS = (
    "NIFTY 50 TRI", "NIFTY NEXT 50 TRI", "NIFTY 100 TRI", "NIFTY MIDCAP 150 TRI",
    "NIFTY SMALLCAP 250 TRI", "NIFTY 500 TRI", "SENSEX TRI", "NIFTY BANK TRI",
)
ARBITRAGE_BENCHMARK = "NIFTY 50 ARBITRAGE INDEX"

# --- Fixed values: registry sub-category -> cohort category ------------------------
SUBCATEGORY_TO_CATEGORY = {
    "elss": "ELSS",
    "elss- tax saver fund": "ELSS",
    "elss - tax saver fund": "ELSS",
    "flexi cap fund": "Flexi Cap",
    "focused fund": "Focused",
    "large & mid cap fund": "Large & Mid Cap",
    "large cap fund": "Large Cap",
    "mid cap fund": "Mid Cap",
    "multi cap fund": "Multi Cap",
    "small cap fund": "Small Cap",
    "sectoral/ thematic": "Sectoral/Thematic",
    "sectoral/thematic": "Sectoral/Thematic",
    "sectoral fund": "Sectoral/Thematic",
    "thematic fund": "Sectoral/Thematic",
    "value fund": "Value/Contra",
    "contra fund": "Value/Contra",
    "dividend yield fund": "Dividend Yield",
}

# --- Fixed values: registry fragment -> rule category ------------------------------
FRAGMENT_TO_RULE_CATEGORY = {
    "FLEXI CAP FUND": "Flexi Cap",
    "LARGE CAP FUND": "Large Cap",
    "MID CAP FUND": "Mid Cap",
    "SMALL CAP FUND": "Small Cap",
    "LARGE & MID CAP FUND": "Large & Mid Cap",
    "MULTI CAP FUND": "Multi Cap",
    "VALUE FUND": "Value",
    "CONTRA FUND": "Contra",
    "DIVIDEND YIELD FUND": "Dividend Yield",
    "FOCUSED FUND": "Focused",
    "ELSS": "ELSS",
    "SECTORAL/ THEMATIC": "Thematic",
    "THEMATIC FUND": "Thematic",
    "AGGRESSIVE HYBRID FUND": "Aggressive Hybrid",
    "CONSERVATIVE HYBRID FUND": "Conservative Hybrid",
    "ARBITRAGE FUND": "Arbitrage",
    "INDEX FUNDS": "Index Fund",
    "EQUITY ETF": "ETF",
    "DEBT ETF": "ETF",
}

# --- Fixed values: benchmark names -------------------------------------------------
CATEGORY_BENCHMARKS = {
    "Flexi Cap": "Nifty 500",
    "Large Cap": "Nifty 100",
    "Mid Cap": "Nifty Midcap 150",
    "Small Cap": "Nifty Smallcap 250",
    "Multi Cap": "Nifty 500",
    "ELSS": "Nifty 500",
    "Value/Contra": "Nifty 500",
    "Focused": "Nifty 500",
}
SECTOR_BENCHMARKS = {
    "Banking/Financial Services": "Nifty Bank",
    "FMCG/Consumption": "Nifty FMCG",
    "Infrastructure": "Nifty Infrastructure",
    "Pharma/Healthcare": "Nifty Pharma",
    "IT/Technology": "Nifty IT",
    "Manufacturing": "Nifty India Manufacturing",
    "MNC": "Nifty MNC",
    "Auto/Transportation": "Nifty Auto",
    "Energy/Power": "Nifty Energy",
    "PSU": "Nifty PSE",
    "Commodities/Natural Resources": "Nifty Commodities",
    "Housing/Real Estate": "Nifty Realty",
    "Defence": "Nifty India Defence",
    "ESG": "Nifty100 ESG Sector Leaders",
}

# --- Fixed values: sector vocabulary, checked in this order ------------------------
STRATEGY_MARKERS = (
    (r"innovation|innovative|pioneer", "INNOVATION"),
    (r"momentum", "MOMENTUM"),
    (r"special opportunit", "SPECIAL_SITUATIONS"),
    (r"multi.?factor|quantamental|minimum variance|\bquality\b", "FACTOR"),
    (r"sector rotation", "ROTATION"),
    (r"conglomerate", "CONGLOMERATES"),
    (r"ethical|shariah", "BELIEF_SCREEN"),
    (r"international|global|asian|japan|taiwan|\bus\b|china|europe", "FOREIGN"),
    (r"rural", "RURAL"),
    (r"(?<!financial )(?<!financials )\bservices\b", "SERVICES"),
    (r"\bipo\b|recently listed", "NEW_LISTINGS"),
)
SECTOR_RULES = (
    (r"banking|bfsi|financial services|financials services|financial svcs", "Banking/Financial Services"),
    (r"pharma|healthcare|health care|health and wellness", "Pharma/Healthcare"),
    (r"transportation|logistics|automotive|\bauto\b", "Auto/Transportation"),
    (r"technology|\bteck\b|\btech\b|digital", "IT/Technology"),
    (r"consumption|consumer|fmcg", "FMCG/Consumption"),
    (r"infrastructure|\binfra\b|t\.i\.g\.e\.r|economic reform|build india", "Infrastructure"),
    (r"manufacturing|manufacture", "Manufacturing"),
    (r"\bpsu\b|public sector", "PSU"),
    (r"\bmnc\b|multinational", "MNC"),
    (r"energy|\bpower\b", "Energy/Power"),
    (r"commodit|\bcomma\b|natural resource|agri", "Commodities/Natural Resources"),
    (r"housing|real estate|realty", "Housing/Real Estate"),
    (r"business cycle", "Business Cycle"),
    (r"\besg\b|sustainab|responsible investing", "ESG"),
    (r"defence|defense", "Defence"),
    (r"\bquant\b", "Quant"),
    (r"export", "Exports"),
)
HOUSE_SUFFIXES = (" Mutual Fund", " Asset Management", " AMC")
EXTRA_HOUSE_PREFIXES = (
    "Kotak", "Franklin India", "Franklin", "LIC MF", "Jio BlackRock", "JioBlackRock",
    "Invesco India", "Mirae Asset", "Baroda BNP Paribas", "Canara Robeco", "Bank of India",
    "The Wealth Company", "360 ONE", "Aditya Birla Sun Life", "Motilal Oswal",
    "Nippon India", "quant", "WhiteOak Capital", "Mahindra Manulife", "Bajaj Finserv",
    "PGIM India",
)

# --- Fixed values: curated-file column lists ---------------------------------------
OVERRIDE_COLUMNS = ("amfi_code", "category", "sector", "source_url", "note")
OVERRIDE_FORBIDDEN = (
    "label", "y_cohort_q1", "y", "target", "probability", "prob", "score",
    "verdict", "verdict_color", "cohort_percentile", "rank",
)
MANAGER_REQUIRED = ("manager_name", "scheme_name", "start_date")
MANAGER_OPTIONAL = ("amfi_code", "end_date", "source_url", "note")
MANAGER_FORBIDDEN = (
    "macs", "manager_alpha_consistency_score", "score", "rating", "rank", "skill",
    "alpha", "verdict", "label", "probability", "recommendation",
)

# --- Fixed values: mandate rules per category --------------------------------------
# category, bucket, segment, segment floor, equity floor, overlap cap, overlap scope
CATEGORY_RULES = (
    ("Large Cap", "Equity", "large", 0.80, 0.80, None, None),
    ("Mid Cap", "Equity", "mid", 0.65, 0.65, None, None),
    ("Small Cap", "Equity", "small", 0.65, 0.65, None, None),
    ("Flexi Cap", "Equity", None, None, 0.65, None, None),
    ("Value", "Equity", None, None, 0.80, 0.50, "contra_sibling"),
    ("Contra", "Equity", None, None, 0.80, 0.50, "value_sibling"),
    ("Dividend Yield", "Equity", None, None, 0.80, None, None),
    ("Sectoral", "Equity", "declared_sector", 0.80, 0.80, 0.50, "all_equity_except_large_cap"),
    ("Thematic", "Equity", "declared_theme", 0.80, 0.80, 0.50, "all_equity_except_large_cap"),
    ("Sectoral Debt", "Debt", "single_sector_debt", 0.80, None, None, None),
    ("Corporate Bond", "Debt", None, None, None, None, None),
    ("Short Duration", "Debt", None, None, None, None, None),
    ("Aggressive Hybrid", "Hybrid", None, None, 0.65, None, None),
    ("Conservative Hybrid", "Hybrid", None, None, None, None, None),
    ("Arbitrage", "Hybrid", None, None, 0.65, None, None),
    ("Life Cycle", "Life Cycle", None, None, None, None, None),
    ("Index Fund", "Other (Index/ETF/FoF)", None, None, None, None, None),
    ("ETF", "Other (Index/ETF/FoF)", None, None, None, None, None),
    ("Retirement/Children (legacy)", "Solution Oriented (DISCONTINUED)", None, None, None, None, None),
)
CATEGORY_RULE_SCHEMA = (
    "category string, bucket string, segment string, segment_floor double, "
    "equity_floor double, overlap_cap double, overlap_scope string"
)
OVERLAP_EXEMPT = ("Large Cap", "Index Fund", "ETF")
RETURN_WORDS = (
    "wealth booster", "multibagger", "assured", "guaranteed", "high return",
    "supreme return", "double",
)
REGULATORY_TERMS = (
    "sebi seeks", "show cause", "penalty", "ban", "probe", "investigation",
    "front-running", "discontinue",
)
NEVER_HIGH_BASES = (
    "GUARDRAIL_ONLY", "DESCRIPTIVE_RISK", "MANAGER_HISTORY", "NEWS_KEYWORD", "COVERAGE",
)
CAP_MANDATED = ("Large Cap", "Mid Cap", "Small Cap", "Flexi Cap", "Large & Mid Cap")
DORMANT_DEBT = (
    "DEBT_ISSUER_LIMIT_BREACH", "DEBT_GROUP_LIMIT_BREACH", "DEBT_MANDATE_CREDIT_BREACH",
    "DEBT_CREDIT_QUALITY_LOW", "DEBT_DURATION_STRESS", "DEBT_YIELD_REACHING",
)
DORMANT_ARBITRAGE = ("HY_ARB_SPREAD_LAG", "HY_ARB_SPREAD_COMPRESSING")

# --- Fixed values: eligibility -----------------------------------------------------
NEWBORN_DAYS = 182
YOUNG_DAYS = 3 * 365
OBSERVATION_NEEDS = {
    "nav_basic_stats": 60,
    "beta_alpha": 60,
    "sharpe_sortino": 126,
    "max_drawdown": 126,
    "rolling_3y": 3 * TRADING_DAYS,
    "rolling_5y": 5 * TRADING_DAYS,
    "manager_alpha_score": 3 * TRADING_DAYS,
}

# --- Fixed values: composite factors, metric -> (weight, direction) ----------------
FACTOR_MAP = {
    "Equity": {
        "rr3y_mean": (0.135, 1), "rr5y_mean": (0.09, 1), "sortino": (0.135, 1),
        "info_ratio": (0.135, 1), "alpha": (0.09, 1), "upside_capture": (0.0675, 1),
        "downside_capture": (0.0675, -1), "max_drawdown": (0.045, 1), "beta": (0.135, -1),
        "expense_ratio": (0.10, -1),
    },
    "Index/ETF": {
        "tracking_error": (0.35, -1), "tracking_difference_tri": (0.30, 1),
        "expense_ratio": (0.20, -1), "days_to_liquidate_wavg": (0.15, -1),
    },
    "Debt": {
        "credit_risk_index": (0.25, -1), "ytm": (0.15, 1), "sharpe": (0.15, 1),
        "rr3y_mean": (0.10, 1), "max_group_weight": (0.10, -1), "max_issuer_weight": (0.10, -1),
        "stress_pnl_200bps": (0.10, 1), "expense_ratio": (0.05, -1),
    },
    "Hybrid": {
        "sortino": (0.20, 1), "rr3y_mean": (0.15, 1), "alpha": (0.15, 1),
        "credit_risk_index": (0.125, -1), "max_drawdown": (0.125, 1),
        "downside_capture": (0.10, -1), "arb_spread_ann": (0.10, 1), "expense_ratio": (0.05, -1),
    },
    "Solution Oriented": {
        "rr5y_mean": (0.25, 1), "sortino": (0.20, 1), "alpha": (0.15, 1),
        "max_drawdown": (0.15, 1), "credit_risk_index": (0.15, -1), "expense_ratio": (0.10, -1),
    },
}
FACTOR_TO_FEATURE = {
    "rr3y_mean": "cagr_3y", "rr5y_mean": "cagr_5y", "sortino": "sortino_3y",
    "info_ratio": "ir_3y", "alpha": "excess_3y", "upside_capture": "upcap_3y",
    "downside_capture": "downcap_3y", "max_drawdown": "max_dd_3y", "beta": "beta_3y",
}

# --- Fixed values: investor utility ------------------------------------------------
BASE_UTILITY_WEIGHTS = {
    "growth": 0.40, "downside": 0.15, "consistency": 0.20, "cost": 0.10,
    "liquidity": 0.05, "drift_thematic": 0.10,
}
SCREEN_GREEN, SCREEN_RED = 65.0, 45.0

# --- Fixed values: refusal status -> data flag -------------------------------------
STATUS_FLAGS = {
    "THIN_COHORT": "THIN_COHORT",
    "STALE_NAV": "STALE_NAV",
    "NOT_IN_UNIVERSE": "NOT_IN_UNIVERSE",
    "OUT_OF_TRAINING_UNIVERSE": "OUT_OF_TRAINING_UNIVERSE",
    "SECTOR_UNRESOLVED": "SECTOR_UNRESOLVED",
    "INSUFFICIENT_HISTORY": "INSUFFICIENT_HISTORY",
}
FLAG_OTHER = "COHORT_UNSCORED_OTHER"
IMPUTATION_MEASURED = ("OK", "INSUFFICIENT_HISTORY")
