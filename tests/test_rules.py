import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from navstead import constants as K
from navstead.operators import alerts, compliance, holdings, records, suitability
from navstead.sources import sinks

LINE = "fund_id string, as_of date, instrument string, weight double, asset_type string, sector string, cap_band string"


def book(spark, lines):
    return spark.createDataFrame([(f, dt.date(2020, 1, 1), n, w, k, s, b) for f, n, w, k, s, b in lines], LINE)


def test_ninety_profiles(spark):
    grid = [(i, float(h), n, r) for i, (h, n, r) in enumerate(itertools.product((0.5, 1, 3, 3.9, 4, 5, 6.9, 7, 8, 20), ("none", "partial", "high"), ("conservative", "moderate", "high")))]
    assert len(grid) == 90
    got = suitability.utility_weights(spark.createDataFrame(grid, "profile_id int, horizon_years double, liquidity_need string, risk_appetite string"))
    for r in got.collect():
        w = [r[f"w_{k}"] for k in K.BASE_UTILITY_WEIGHTS]
        assert min(w) >= 0 and abs(sum(w) - 1) < 1e-12


def test_structure_facts_edges(spark):
    lines = [("d", f"I{i}", 0.05, "equity", f"S{i % 4}", "large") for i in range(20)] + [("c", "X", 0.6, "equity", "S", "small"), ("c", "Y", 0.4, "equity", "S", "small")]
    lines += [("b", "G", 1.0, "debt", None, None)]
    got = {r.fund_id: r for r in holdings.structure_facts(book(spark, lines)).collect()}
    assert got["d"].effective_n == pytest.approx(20) and got["d"].concentration_score == pytest.approx(0.75) and got["d"].n_breaches == 0
    assert got["c"].n_breaches == 2 and got["c"].concentration_score == 0 and [b.instrument for b in got["c"].breaches] == ["X", "Y"]
    assert got["b"].n_equity == 0 and got["b"].top10_weight is None and got["b"].concentration_score is None


def test_ten_percent_exactly_is_no_breach(spark):
    facts = holdings.structure_facts(book(spark, [("f", f"I{i}", 0.10, "equity", "S", "mid") for i in range(10)]))
    assert holdings.single_issuer_findings(facts).first().passed


def test_missing_holdings_are_a_coverage_finding(spark):
    funds = spark.createDataFrame([("1", "Good Large Cap Fund", "Large Cap", None), ("2", "Odd Fund", "Odd", None)], "fund_id string, scheme_name string, category string, declared_sector string")
    got = compliance.verify(funds, book(spark, [("9", "X", 1.0, "equity", "S", "large")])).collect()
    one = {r.rule_id: (r.passed, r.severity) for r in got if r.fund_id == "1"}
    assert one["cap_fidelity_min_equity_and_overlap_checks"] == (False, "warning") and "min_equity>=80%" not in one
    assert [(r.rule_id, r.severity) for r in got if r.fund_id == "2"] == [("category_known", "warning")]
    raised = {(r.fund_id, r.code): (r.severity, r.basis) for r in alerts.compliance_alerts(compliance.verify(funds, book(spark, [("9", "X", 1.0, "equity", "S", "large")]))).collect()}
    assert raised[("1", "SEBI_CHECKS_NOT_EVALUATED")] == ("INFO", "COVERAGE")


def test_cap_fidelity_floor(spark):
    funds = spark.createDataFrame([("1", "A Large Cap Fund", "Large Cap", None)], "fund_id string, scheme_name string, category string, declared_sector string")
    lines = [("1", f"I{i}", 0.08, "equity", "S", "large") for i in range(10)] + [("1", "M", 0.2, "cash", None, None)]
    got = {r.rule_id: r.passed for r in compliance.verify(funds, book(spark, lines)).collect()}
    assert got["cap_fidelity_large>= 80%"] and got["min_equity>=80%"]


@pytest.mark.parametrize("age,status", [(0, "NEWBORN"), (181, "NEWBORN"), (182, "YOUNG"), (1094, "YOUNG"), (1095, "EVALUABLE"), (-5, "PRE_LAUNCH")])
def test_eligibility_boundaries(spark, age, status):
    today = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("1", 800, today - dt.timedelta(days=age), True)], "fund_id string, n_obs int, allotment_date date, has_disclosure boolean")
    row = suitability.eligibility(df, F.lit(today)).first()
    assert row.status == status and row.can_score == (status in ("YOUNG", "EVALUABLE"))
    assert len(row.available) + len(row.blocked) == 8 and ("rolling_5y" in row.blocked)


def test_missing_metrics_raise_nothing(spark):
    cols = ("cagr", "sortino", "max_dd_3y", "rr3y_negative_share", "excess_cagr_3y", "beta", "tracking_error", "info_ratio", "upside_capture", "downside_capture",
            "tracking_difference_tri", "benchmark_max_dd_3y", "expense_ratio")
    shape = "fund_id string, bucket string, category string, eligibility string, " + ", ".join(f"{c} double" for c in cols)
    data = [(b, b, "Arbitrage", "EVALUABLE", *[None] * len(cols)) for b in ("Equity", "Hybrid", "Debt", "Other (Index/ETF/FoF)")] + [("y", "Equity", "x", "YOUNG", *[None] * len(cols))]
    got = {r.fund_id: r for r in alerts.factor_alerts(spark.createDataFrame(data, shape)).collect()}
    assert all(not r.alerts for r in got.values())
    assert got["Equity"].dormant == ["EQ_EXPENSE_HIGH"] and len(got["Debt"].dormant) == 7 and len(got["Hybrid"].dormant) == 3
    assert got["y"].dormant == ["FACTOR_RULES_SKIPPED_YOUNG"] and got["y"].checks_run == 0


def test_verdict_branches(spark):
    shape = "greens int, reds int, is_breach boolean, bucket string, macs double"
    data = [(3, 0, False, "Equity", None), (3, 0, True, "Equity", 70.0), (1, 2, False, "Equity", None), (0, 3, False, "Equity", None), (2, 0, False, "Equity", None)]
    got = spark.createDataFrame(data, shape).select(suitability.verdict_of(F.lit(True)).alias("r"), suitability.verdict_of(F.lit(False)).alias("n")).collect()
    assert [(g.r.verdict, g.n.verdict) for g in got] == [
        ("HOLD / WATCH", "BUY"), ("SELL / AVOID", "SELL / AVOID"), ("SELL / AVOID", "HOLD / WATCH"), ("SELL / AVOID", "SELL / AVOID"), ("HOLD / WATCH", "HOLD / WATCH")]
    assert got[0].n.verdict_caveat and not got[1].n.verdict_caveat


def test_every_refusal_has_its_own_flag(spark):
    statuses = list(K.STATUS_FLAGS) + ["BRAND_NEW"]
    df = spark.createDataFrame([(s, "ETF", None, 0.01, "EVALUABLE") for s in statuses], "cohort_status string, category string, declared_sector string, expense_ratio double, eligibility string")
    flags = [r[0] for r in df.select(records.data_flags()).collect()]
    assert all(len(f) == 1 for f in flags) and len({f[0] for f in flags}) == len(statuses) and flags[-1] == [K.FLAG_OTHER]


def test_nan_cannot_reach_the_artifact(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], (True, float("-inf")), {"k": float("nan")})], "a double, b array<double>, c struct<d:boolean,e:double>, m map<string,double>")
    row = sinks.json_safe(df).first()
    assert row.a is None and row.b == [1.0, None] and row.c.d is True and row.c.e is None and row.m == {"k": None}


def test_snapshot_ties_take_the_earlier_file(spark):
    books = spark.createDataFrame([("1", dt.date(2020, 1, 1)), ("1", dt.date(2020, 1, 21))], "fund_id string, as_of date")
    got = {r.label: r.as_of for r in holdings.snapshots(books, F.lit(dt.date(2020, 1, 11))).collect()}
    assert got["current"] == dt.date(2020, 1, 1)


def test_overlap_days_count_by_existence(spark):
    w = spark.createDataFrame([("a", dt.date(2020, 1, 1), "X", 0.5), ("a", dt.date(2020, 1, 2), "X", 0.5), ("b", dt.date(2020, 1, 1), "X", 0.2), ("b", dt.date(2020, 1, 2), "Y", 0.9),
                               ("b", dt.date(2020, 1, 3), "X", 0.9)], "fund_id string, dt date, ticker string, weight double")
    pairs = spark.createDataFrame([("a", "b")], "fund_id string, other_id string")
    row = holdings.quarterly_overlap(w, pairs).first()
    assert row.overlap == pytest.approx(0.1) and row.n_days == 2


def test_sibling_overlap_equals_the_asked_pairs_and_moves_no_pair(spark):
    w = spark.sql("SELECT string(f) fund_id, date_add(DATE '2024-01-01', int(d)) dt, concat('t', t) ticker, (1 + (f * 7 + d * 3 + t) % 5) / 10D weight "
                  "FROM range(12) a(f), range(6) b(d), range(4) c(t) WHERE (f + d) % 3 > 0 AND (f + t + d) % 4 > 0")
    funds = spark.sql("SELECT string(f) fund_id, concat('h', f % 2) amc, element_at(array('Thematic', 'Value', 'Mid Cap', 'Large Cap'), int(f % 4) + 1) category FROM range(12) a(f)")
    rules = spark.createDataFrame(list(K.CATEGORY_RULES), K.CATEGORY_RULE_SCHEMA)
    got = holdings.sibling_overlap(w, funds, rules)
    asked = holdings.daily_overlap(w, holdings.sibling_pairs(funds, rules).select("fund_id", "other_id"))
    rows = lambda df: sorted((r.fund_id, r.other_id, r.dt, round(r.overlap, 9)) for r in df.collect())
    assert rows(got) == rows(asked) and len(rows(got)) > 20
    plan = got._jdf.queryExecution().sparkPlan().toString()  # the join of houses and days is the last step
    assert "Join" in plan.split("\n")[1]


def test_days_of_siblings_are_added_up_where_they_meet(spark, monkeypatch):
    """Sums by quarter and over all days equal the daily rows, whatever the blocks; missing weights share nothing, their days count."""
    w = spark.sql("SELECT string(f) fund_id, date_add(DATE '2024-03-28', int(d)) dt, concat('t', t) ticker, IF((f + d + t) % 9 = 0, NULL, (1 + (f * 7 + d * 3 + t) % 5) / 10D) weight "
                  "FROM range(24) a(f), range(8) b(d), range(4) c(t) WHERE (f + d) % 3 > 0 AND (f + t + d) % 4 > 0")
    funds = spark.sql("SELECT string(f) fund_id, concat('h', f % 2) amc, element_at(array('Thematic', 'Value', 'Mid Cap', 'Large Cap'), int(f / 2 % 4) + 1) category FROM range(24) a(f)")
    rules = spark.createDataFrame(list(K.CATEGORY_RULES), K.CATEGORY_RULE_SCHEMA)
    daily = holdings.sibling_overlap(w, funds, rules)
    rows = lambda df: sorted((r.fund_id, r.other_id, getattr(r, "quarter", None), round(r.overlap, 9), r.n_days) for r in df.collect())
    want = rows(holdings.quarterly_means(daily))
    spans = rows(daily.groupBy("fund_id", "other_id").agg(F.sum("overlap").alias("overlap"), F.count("*").alias("n_days")))
    assert len(want) > len(spans) > 50
    for size, most in ((1024, 2_000_000), (3, 5)):
        monkeypatch.setattr(holdings, "HOUSE_BLOCK", size)
        monkeypatch.setattr(holdings, "MOST_MATCHES", most)
        by_quarter = holdings.sibling_overlap(w, funds, rules, "quarter")
        assert rows(holdings.quarterly_means(by_quarter)) == want
        assert rows(holdings.sibling_overlap(w, funds, rules, "all")) == spans
        plan = holdings.quarterly_means(by_quarter)._jdf.queryExecution().sparkPlan().toString()
        assert "Aggregate" not in plan.split("FlatMapCoGroupsInArrow")[0]  # no pair goes through a shuffle
