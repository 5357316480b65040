import pytest

from navstead import constants as K
from navstead.operators import curation, universe
from navstead.sources import scans


@pytest.mark.parametrize("raw,category,reason", [
    ("Open Ended Schemes(Equity Scheme - Large Cap Fund)", "Large Cap", "mapped"),
    ("Open Ended Scheme (Equity Schemes - Large  &  Mid Cap Fund)", "Large & Mid Cap", "mapped"),
    ("Open Ended Schemes(Equity Scheme - ELSS- Tax Saver Fund)", "ELSS", "mapped"),
    ("Close Ended Schemes(Equity Scheme - Large Cap Fund)", None, "close_ended"),
    ("Open Ended Schemes(Debt Scheme - Liquid Fund)", None, "not_equity"),
    ("Open Ended Schemes(Other Scheme - Exchange Traded Funds (ETFs) - Equity ETF)", None, "not_equity"),
    ("Close Ended Schemes(Income)", None, "legacy_label"),
    ("Some House Mutual Fund (IDF)", None, "unreadable"),
    ("Open Ended Schemes(Equity Scheme - Moon Fund)", None, "unmapped_subcategory"),
    ("  ", None, "empty"), (None, None, "null"),
])
def test_category_parse(spark, raw, category, reason):
    row = spark.createDataFrame([(raw,)], "c string").select(universe.parse_category("c").alias("p")).first().p
    assert (row.category, row.reason) == (category, reason)
    assert row.parsed == (reason not in ("unreadable", "empty", "null"))


def test_plan_and_option(spark):
    names = [("X Direct Plan Growth", "DIRECT", "GROWTH"), ("X Regular IDCW Growth Option", "REGULAR", "IDCW"), ("X Directed Growthy", "UNKNOWN", "UNKNOWN"),
             ("X Reinvestment", "UNKNOWN", "IDCW")]
    df = spark.createDataFrame(names, "n string, p string, o string")
    for r in df.select("*", universe.plan_of("n").alias("gp"), universe.option_of("n").alias("go")).collect():
        assert (r.gp, r.go) == (r.p, r.o)


def test_sector_proposals(spark):
    manifest = spark.createDataFrame([("Bajaj Mutual Fund", "Banking/Financial Services"), ("Bajaj Finserv Mutual Fund", "FMCG/Consumption"), ("Z", "Pharma/Healthcare")],
                                     "amc string, sector string")
    cases = {
        "Bajaj Finserv Consumption Fund - Direct Plan - Growth": ("FMCG/Consumption", "consumption"),
        "Bajaj Banking and Financial Services Fund-Direct Growth": ("Banking/Financial Services", "banking"),
        "Z Services Fund": (None, None), "Z Global Pharma Fund": (None, None), "Z Pharma Fund Growth": ("Pharma/Healthcare", "pharma"),
        "Z Defence Fund": (None, None), "Z Financial Services Fund": ("Banking/Financial Services", "financial services"),
    }
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(cases)], "fund_id string, scheme_name string")
    for r in curation.propose_sectors(df, manifest).collect():
        assert (r.sector, r.matched_on) == cases[r.scheme_name], r


def test_plan_tail_is_cut_only_after_fund(spark):
    df = spark.createDataFrame([("Nippon India Growth Mid Cap Fund - Direct Plan - Growth",), ("No Tail Here Growth",)], "n string")
    got = [r[0] for r in df.select(curation.strip_plan_tail("n")).collect()]
    assert got == ["Nippon India Growth Mid Cap Fund", "No Tail Here Growth"]


def test_curated_resolution_refuses_two_names(spark):
    m = spark.createDataFrame([("100", "Tata Mid Cap Fund"), ("101", "Tata Large & Mid Cap Fund"), ("102", "Other Fund")], "fund_id string, scheme_name string")
    q = spark.createDataFrame([(1, "tata mid cap fund"), (2, "Tata Mid"), (3, "101"), (4, "other"), (5, "nothing")], "query_id int, q string")
    got = {r.query_id: (r.status, r.fund_id) for r in universe.resolve_curated(q, m).collect()}
    assert got == {1: ("RESOLVED", "100"), 2: ("AMBIGUOUS", None), 3: ("RESOLVED", "101"), 4: ("RESOLVED", "102"), 5: ("NOT_FOUND", None)}


def test_market_resolution_prefers_direct_growth_then_tightest(spark):
    m = spark.createDataFrame([
        ("1", "INF1", "Tata Mid Cap Fund Regular Growth", 1), ("2", "INF2", "Tata Large & Mid Cap Fund Direct Growth", 2), ("3", "INF3", "Tata Mid Cap Fund Direct Growth", 3),
        ("4", "INF4", "Tata Mid Cap Fund Direct IDCW", 4)], "fund_id string, isin string, scheme_name string, line_no int")
    q = spark.createDataFrame([(1, "tata mid"), (2, "inf4"), (3, "2")], "query_id int, q string")
    assert {r.query_id: r.fund_id for r in universe.resolve_market(q, m).collect()} == {1: "3", 2: "4", 3: "2"}


def test_third_copy_of_an_override_is_dropped_too(spark):
    m = spark.createDataFrame([("Large Cap", "IT")], "category string, sector string")
    raw = spark.createDataFrame([("1", "Large Cap", None, "u"), ("1", None, "IT", "u"), ("1", None, "IT", "u"), ("2", None, "IT", None), (" ", None, "IT", "u")],
                                "amfi_code string, category string, sector string, source_url string")
    good, issues = curation.validate_overrides(raw, m, m)
    assert [r.amfi_code for r in good.collect()] == ["2"]
    found = sorted((r.row_key or "", r.severity, r.message) for r in issues.collect())
    assert found == [("", "ERROR", "blank code")] + [("1", "ERROR", "duplicate code")] * 3 + [("2", "WARN", "no source_url")]


@pytest.mark.parametrize("column,word", [("score", "forbidden"), ("colour", "unknown")])
def test_a_bad_header_rejects_the_file(spark, column, word):
    m = spark.createDataFrame([("Large Cap", "IT")], "category string, sector string")
    good, issues = curation.validate_overrides(spark.createDataFrame([("1", "x")], f"amfi_code string, {column} string"), m, m)
    assert good.count() == 0 and word in issues.first().message


def test_manager_file_and_current_manager(spark):
    raw = spark.createDataFrame([
        (2, "A", "S1", "2020-01-01", None, "u"), (3, "B", "S1 ", "2021-01-01", "2022-01-01", "u"), (4, "C", "s1", "2021-01-01", None, "u"),
        (5, "D", "S2", "2021-05-01", "2020-01-01", "u"), (6, "C", "S3", "bad", None, "u"), (7, "C", "S4", "2019-01-01", None, None)],
        "row_no int, manager_name string, scheme_name string, start_date string, end_date string, source_url string")
    good, issues = curation.validate_managers(raw)
    assert {r.message for r in issues.where("severity = 'ERROR'").collect()} == {"end before start", "bad start_date"}
    assert {r.scheme_key: r.manager_name for r in curation.current_manager(good).collect()} == {"s1": "C", "s4": "C"}
    asked = spark.createDataFrame([("c", "S1")], "manager_name string, exclude_scheme string")
    assert curation.prior_funds(good, asked).first().prior_funds == {"S4": "managed 2019-01-01–present"}


def test_registry_text_from_disk(spark, tmp_path):
    text = ["Scheme Code;ISIN;x;Name;NAV;Date", "", "Open Ended Schemes(Equity Scheme - Mid Cap Fund)", "", "House (IDF) Mutual Fund",
            "119551;INF209KA12Z1;-;Fund A - Direct Growth;103.5;05-Jan-2024", "119552;;;Fund B;N.A.;05-Jan-2024", "Close Ended Schemes(Income)", "119553;;;Fund C;10;5 Jan 2024"]
    (tmp_path / "nav.txt").write_text("\n".join(text))
    lines = scans.registry_lines(spark, str(tmp_path / "nav.txt"))
    got = {r.fund_id: (r.isin, r.category_raw, r.amc, r.nav) for r in scans.scheme_master(lines).collect()}
    assert got == {"119551": ("INF209KA12Z1", text[2], text[4], 103.5), "119553": (None, text[7], text[4], 10.0)}
    assert [(r.fund_id, str(r.dt)) for r in scans.nav_from_registry(lines).collect()] == [("119551", "2024-01-05")]


def test_every_rule_category_is_known():
    assert len(K.CATEGORY_RULES) == 19 and len(K.SECTOR_RULES) == 17


@pytest.mark.parametrize("resolve", [universe.resolve_curated, universe.resolve_market])
def test_resolution_sends_no_growing_side_through_the_driver(spark, resolve):
    """Small files that an explode or a decoded column makes large must not be broadcast by their file size."""
    names = spark.createDataFrame([("1", "A1", "Alpha Bank Fund", 1), ("2", "A2", "Beta Bank Fund", 2)], "fund_id string, isin string, scheme_name string, line_no long")
    asked = spark.createDataFrame([(1, "1"), (2, "beta bank fund"), (3, "bank alpha"), (4, "none")], "query_id long, q string")
    got = resolve(asked, names)
    assert {r.query_id: r.fund_id for r in got.collect()} == {1: "1", 2: "2", 3: "1", 4: None}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_house_prefixes_send_no_growing_side_through_the_driver(spark):
    names = spark.createDataFrame([("1", "Alpha Bank Fund"), ("2", "Other Pharma Fund")], "fund_id string, name string")
    got = curation.strip_house(names, spark.createDataFrame([("Alpha",)], "prefix string"), "fund_id", "name")
    assert {r.fund_id: r.body for r in got.collect()} == {"1": "Bank Fund", "2": "Other Pharma Fund"}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString().split("LeftOuter")[0].rsplit("\n", 1)[-1]


def test_bundled_files_give_the_rows_of_single_files(spark, tmp_path):
    files = {"7_2020-03.csv": "﻿Weight,Symbol\r\n0.5,\"A, B\"\r\n0.25,C", "8_2020-04.csv": "name,note\nA,x", "9_2020-05.csv": "Type,NAME,weight\nDebt,D,0.1\n\nCash,E,none",
             "readme.csv": "name,weight\nA,1"}
    (tmp_path / "single").mkdir()
    for name, body in files.items():
        (tmp_path / "single" / name).write_bytes(body.encode())
    spark.createDataFrame(list(files.items()), "file string, body string").repartition(2).write.parquet(str(tmp_path / "bundled"))
    single, bundled = scans.disclosures(spark, str(tmp_path / "single")), scans.bundled_disclosures(spark, str(tmp_path / "bundled"))
    rows = sorted(tuple(r) for r in bundled.select("fund_id", "instrument", "weight", "asset_type").collect())
    assert rows == [("7", "A, B", 0.5, "equity"), ("7", "C", 0.25, "equity"), ("9", "D", 0.1, "debt")]
    assert sorted(map(str, single.collect())) == sorted(map(str, bundled.collect()))


def test_a_line_is_parsed_once(spark):
    files = spark.createDataFrame([("7_2020-03.csv", "name,weight\nA,1")], "file string, body string")
    plan = scans.disclosure_rows(files)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_csv(") <= 2  # the header and a line


def test_names_do_not_go_through_the_driver_to_meet_house_prefixes(spark):
    """The size check sees one row per name, the join has one per name and prefix length: no side of it is broadcast."""
    manifest = spark.createDataFrame([(f"House {'x' * i}", None) for i in range(40)], "amc string, sector string")
    names = spark.range(50).selectExpr("string(id) fund_id", "concat('House ', repeat('x', int(id % 40)), ' Pharma Fund') scheme_name")
    got = curation.strip_house(names, curation.house_prefixes(manifest), "fund_id", "scheme_name")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and "Broadcast" not in plan
    assert {r.body for r in got.collect()} == {"Pharma Fund"}
