"""Registry text, universe gate, curation files, resolution and managers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import word_any
from ..operators import cleaning, curation, universe
from ..session import stored
from ..sources import scans
from . import fixtures as X
from .oracle import define, r6, sql
from .registry import query, rounded

# --- Fixed values: wording of the derived registry -----------------------------------
HEADERS = (
    "Open Ended Schemes(Equity Scheme - Large Cap Fund)", "Open Ended Schemes(Equity Scheme - Sectoral/ Thematic)",
    "Close Ended Schemes(Income)", "Open Ended Schemes(Debt Scheme - Liquid Fund)",
    "Open Ended Schemes(Equity Scheme - ELSS- Tax Saver Fund)", "Open Ended Schemes(Other Scheme - FoF Domestic (ETFs))",
    "Close Ended Schemes(Equity Scheme - Mid Cap Fund)", "Open Ended Schemes(Equity Scheme - Dividend Yield Fund)",
)
HOUSES = ("Kotak", "Franklin India", "Franklin", "Nippon India", "quant", "Plain")
THEMES = (
    "Banking and Financial Services", "Pharma", "Momentum", "Infrastructure", "Global Technology", "Services",
    "Financial Services", "Consumption", "Quality", "PSU", "Flexi Cap", "Business Cycle",
)
TAILS = (
    " - Direct Plan - Growth", " - Regular Plan - Growth", " Direct IDCW Payout", "-Direct Growth", " - Dividend Reinvestment",
    " Growth Option - Direct Plan", "",
)
SECTORS = ("Banking/Financial Services", "Pharma/Healthcare", "Infrastructure", "PSU", "FMCG/Consumption")


def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def choose(items, index):
    return F.array(*[F.lit(i) for i in items])[(index % len(items)).cast("int")]


define("clines", f"""
  SELECT r_name source, n_nationkey, c_custkey, CAST(100000 + c_custkey AS VARCHAR) code, n_name,
    {sql_list(HOUSES)}[c_custkey % 6 + 1] || ' ' || {sql_list(THEMES)}[c_custkey % 12 + 1] || ' ' || CAST(c_custkey AS VARCHAR) || ' Fund' || {sql_list(TAILS)}[c_custkey % 7 + 1] scheme_name,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'INF' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END isin,
    CASE WHEN c_custkey % 13 = 0 THEN 'N.A.' ELSE CAST(CAST(round(abs(c_acctbal)) AS BIGINT) + 10 AS VARCHAR) END nav
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
define("lines", f"""
  SELECT r_name source, n_nationkey*10000000000::BIGINT line_no, {sql_list(HEADERS)}[n_nationkey % 8 + 1] AS txt FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT r_name, n_nationkey*10000000000::BIGINT + 1, n_name || ' Mutual Fund (IDF)' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT source, n_nationkey*10000000000::BIGINT + 2 + c_custkey, code || ';' || isin || ';;' || scheme_name || ';' || nav || ';15-Nov-2001' FROM clines""", "clines")
define("master", r"""
  SELECT regexp_extract(txt, '^(\d{4,8});', 1) fund_id, NULLIF(split_part(txt, ';', 2), '') isin, split_part(txt, ';', 4) scheme_name,
    h category_raw, b amc, CAST(split_part(txt, ';', 5) AS DOUBLE) nav, split_part(txt, ';', 6) AS date, line_no
  FROM (SELECT *, LAST_VALUE(CASE WHEN txt NOT LIKE '%;%' AND txt LIKE '%Schemes(%' THEN txt END IGNORE NULLS) OVER w h,
          LAST_VALUE(CASE WHEN txt NOT LIKE '%;%' AND txt NOT LIKE '%Schemes(%' THEN txt END IGNORE NULLS) OVER w b
        FROM lines WINDOW w AS (PARTITION BY source ORDER BY line_no ROWS UNBOUNDED PRECEDING))
  WHERE txt LIKE '%;%' AND split_part(txt, ';', 5) <> 'N.A.'""", "lines")


@stored
def lines(spark, sf):
    """Registry lines per region; a segment is a run of 500 line numbers."""
    n = X.table(spark, sf, "nation").join(X.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = F.col("n_nationkey").cast("bigint") * 10_000_000_000
    source = F.col("r_name").alias("source")
    heads = n.where(F.col("n_nationkey") % 5 != 4).select(source, base.alias("line_no"), choose(HEADERS, F.col("n_nationkey")).alias("text"))
    banners = n.select(source, (base + 1).alias("line_no"), F.concat("n_name", F.lit(" Mutual Fund (IDF)")).alias("text"))
    key = F.col("c_custkey")
    name = F.concat(choose(HOUSES, key), F.lit(" "), choose(THEMES, key), F.lit(" "), key.cast("string"), F.lit(" Fund"), choose(TAILS, key))
    isin = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("INF"), F.lpad(key.cast("string"), 9, "0")))
    nav = F.when(key % 13 == 0, "N.A.").otherwise((F.round(F.abs("c_acctbal")).cast("bigint") + 10).cast("string"))
    records = X.table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(  # a row per nation; the check takes customers for the smaller side
        source, (base + 2 + key).alias("line_no"),
        F.concat_ws(";", (key + 100000).cast("string"), isin, F.lit(""), name, nav, F.lit("15-Nov-2001")).alias("text"))
    rows = heads.unionByName(banners).unionByName(records)
    return rows.withColumn("segment", F.floor(F.col("line_no") / 500))


@stored
def master(spark, sf):
    return scans.scheme_master(lines(spark, sf))


@query("scheme_master_scan", sql("SELECT fund_id, isin, scheme_name, category_raw, amc, nav, date FROM master", "master"))
def _(spark, sf):
    return scans.scheme_master(lines(spark, sf)).select("fund_id", "isin", "scheme_name", "category_raw", "amc", "nav", "date")


@query("registry_nav_scan", sql("SELECT fund_id, DATE '2001-11-15' dt, nav FROM master", "master"))
def _(spark, sf):
    return scans.nav_from_registry(lines(spark, sf))


define("mcat", """
  SELECT *, CASE category_raw
      WHEN 'Open Ended Schemes(Equity Scheme - Large Cap Fund)' THEN 'Large Cap' WHEN 'Open Ended Schemes(Equity Scheme - Sectoral/ Thematic)' THEN 'Sectoral/Thematic'
      WHEN 'Open Ended Schemes(Equity Scheme - ELSS- Tax Saver Fund)' THEN 'ELSS' WHEN 'Open Ended Schemes(Equity Scheme - Dividend Yield Fund)' THEN 'Dividend Yield' END cat,
    CASE WHEN category_raw IS NULL THEN 'null' WHEN category_raw LIKE '%(Income)' THEN 'legacy_label' WHEN category_raw NOT LIKE '%(Equity Scheme%' THEN 'not_equity'
      WHEN category_raw LIKE 'Close%' THEN 'close_ended' ELSE 'mapped' END why FROM master""", "master")
define("man2", f"""
  SELECT fund_id, scheme_name, amc, CASE CAST(fund_id AS BIGINT) % 12 WHEN 0 THEN 'Large Cap' WHEN 4 THEN 'Sectoral/Thematic' ELSE 'ELSS' END category,
    CASE WHEN CAST(fund_id AS BIGINT) % 12 = 4 THEN {sql_list(SECTORS)}[CAST(fund_id AS BIGINT) % 5 + 1] END sector
  FROM master WHERE CAST(fund_id AS BIGINT) % 4 = 0""", "master")


@stored
def trained_manifest(spark, sf):
    """Every fourth registry scheme is in the trained sample."""
    key = F.col("fund_id").cast("bigint")
    rows = master(spark, sf).where(key % 4 == 0)
    category = F.when(key % 12 == 0, "Large Cap").when(key % 12 == 4, "Sectoral/Thematic").otherwise("ELSS")
    return rows.select("fund_id", "scheme_name", "amc", category.alias("category"), F.when(key % 12 == 4, choose(SECTORS, key)).alias("sector"))


@query("category_parse", sql("""
  SELECT fund_id, cat category, category_raw IS NOT NULL parsed, COALESCE(category_raw LIKE '%(Equity Scheme%', FALSE) is_equity,
    COALESCE(category_raw LIKE 'Open%', FALSE) is_open_ended, why reason FROM mcat""", "mcat"))
def _(spark, sf):
    rows = master(spark, sf).select("fund_id", universe.parse_category("category_raw").alias("p"))
    return rows.select("fund_id", "p.category", "p.parsed", "p.is_equity", "p.is_open_ended", "p.reason")


define("gate", """
  SELECT *, CASE WHEN category_raw IS NULL THEN 'UNMAPPED_CATEGORY' WHEN cat IN ('Large Cap', 'Sectoral/Thematic', 'ELSS') THEN 'TRAINED' ELSE 'OUT_OF_TRAINING_UNIVERSE' END status,
    CASE WHEN regexp_matches(scheme_name, '(?i)\\bdirect\\b') THEN 'DIRECT' WHEN regexp_matches(scheme_name, '(?i)\\bregular\\b') THEN 'REGULAR' ELSE 'UNKNOWN' END AS plan,
    CASE WHEN regexp_matches(scheme_name, '(?i)\\bidcw\\b|\\bdividend\\b|\\bpayout\\b|\\breinvest') THEN 'IDCW' WHEN regexp_matches(scheme_name, '(?i)\\bgrowth\\b') THEN 'GROWTH' ELSE 'UNKNOWN' END AS opt
  FROM mcat""", "mcat")


@query("universe_gate", sql("""
  SELECT fund_id, cat category, status, CASE WHEN status = 'OUT_OF_TRAINING_UNIVERSE' AND cat IS NOT NULL THEN 'category_not_trained' ELSE why END reason FROM gate""", "gate"))
def _(spark, sf):
    return universe.classify(master(spark, sf), trained_manifest(spark, sf)).select("fund_id", "category", "status", "reason")


@query("universe_gate_report", sql(f"""
  SELECT status, cat category, COUNT(*) n, {r6('COUNT(*)/CAST((SELECT COUNT(*) FROM gate) AS DOUBLE)')} share FROM gate GROUP BY 1, 2""", "gate"))
def _(spark, sf):
    return rounded(universe.gate_report(universe.classify(master(spark, sf), trained_manifest(spark, sf))))


@query("plan_option_parse", sql("SELECT fund_id, plan, opt AS option FROM gate", "gate"))
def _(spark, sf):
    return master(spark, sf).select("fund_id", universe.plan_of("scheme_name").alias("plan"), universe.option_of("scheme_name").alias("option"))


define("cand", """
  SELECT g.fund_id, g.scheme_name, g.cat category, m.fund_id IS NOT NULL in_manifest FROM gate g LEFT JOIN man2 m USING (fund_id)
  WHERE status = 'TRAINED' AND plan = 'DIRECT' AND opt = 'GROWTH'""", "gate", "man2")


@query("canonical_candidates", sql("SELECT * FROM cand", "cand"))
def _(spark, sf):
    return universe.candidates(master(spark, sf), trained_manifest(spark, sf))


@query("rule_bucket_and_category", sql("""
  SELECT fund_id, CASE WHEN category_raw LIKE '%Debt Scheme%' THEN 'Debt' ELSE 'Equity' END bucket,
    CASE category_raw WHEN 'Open Ended Schemes(Equity Scheme - Large Cap Fund)' THEN 'Large Cap' WHEN 'Open Ended Schemes(Equity Scheme - Sectoral/ Thematic)' THEN 'Thematic'
      WHEN 'Close Ended Schemes(Income)' THEN 'Income' WHEN 'Open Ended Schemes(Debt Scheme - Liquid Fund)' THEN 'Liquid Fund'
      WHEN 'Open Ended Schemes(Equity Scheme - ELSS- Tax Saver Fund)' THEN 'ELSS- Tax Saver Fund' WHEN 'Open Ended Schemes(Other Scheme - FoF Domestic (ETFs))' THEN 'FoF Domestic (ETFs'
      WHEN 'Close Ended Schemes(Equity Scheme - Mid Cap Fund)' THEN 'Mid Cap' WHEN 'Open Ended Schemes(Equity Scheme - Dividend Yield Fund)' THEN 'Dividend Yield' ELSE 'Unknown' END category
  FROM master""", "master"))
def _(spark, sf):
    return master(spark, sf).select(
        "fund_id", universe.rule_bucket("category_raw").alias("bucket"), universe.rule_category("category_raw").alias("category"))


# --- sector proposals ------------------------------------------------------------------
def _case(rules, value) -> str:
    out = []
    for pattern, label in rules:
        p = pattern.replace("'", "''")
        if "(?<!" in p:
            test = "regexp_matches(regexp_replace(body, 'financials? services', '', 'g'), '\\bservices\\b')"
        else:
            test = f"regexp_matches(body, '{p}')"
        out.append(f"WHEN {test} THEN {value(p, label)}")
    return "CASE " + " ".join(out) + " END"


define("bodies", r"""
  WITH t AS (SELECT fund_id, scheme_name, regexp_replace(scheme_name, '(?i)^(.*?\bfund\b)(.*?)\b(direct|regular|growth|idcw|dividend|cumulative|payout|reinvest).*$', '\1\2') cut FROM master),
  u AS (SELECT fund_id, scheme_name, regexp_replace(cut, '[\s\-–—,]+$', '') nm FROM t)
  SELECT fund_id, scheme_name, lower(ltrim(CASE
    WHEN nm LIKE 'Kotak%' THEN substr(nm, 6) WHEN nm LIKE 'Franklin India%' THEN substr(nm, 15) WHEN nm LIKE 'Franklin%' THEN substr(nm, 9)
    WHEN nm LIKE 'Nippon India%' THEN substr(nm, 13) WHEN nm LIKE 'quant%' THEN substr(nm, 6) ELSE nm END)) body FROM u""", "master")
define("props", f"""
  WITH p AS (SELECT fund_id, scheme_name, {_case(K.STRATEGY_MARKERS, lambda p, v: f"'{v}'")} veto,
      {_case(K.SECTOR_RULES, lambda p, v: f"'{v}'")} sector, {_case(K.SECTOR_RULES, lambda p, v: f"regexp_extract(body, '({p})', 1)")} token FROM bodies)
  SELECT fund_id, scheme_name, CASE WHEN veto IS NULL AND k.sector IS NOT NULL THEN p.sector END sector, CASE WHEN veto IS NULL AND k.sector IS NOT NULL THEN token END matched_on,
    CASE WHEN veto IS NOT NULL THEN veto WHEN p.sector IS NULL THEN 'no sector keyword in the name' WHEN k.sector IS NULL THEN 'not an existing sector' END reason
  FROM p LEFT JOIN (SELECT DISTINCT sector FROM man2 WHERE sector IS NOT NULL) k ON k.sector = p.sector""", "bodies", "man2")


@query("sector_proposals", sql("SELECT * FROM props", "props"))
def _(spark, sf):
    return curation.propose_sectors(master(spark, sf).select("fund_id", "scheme_name"), trained_manifest(spark, sf))


# --- curated files ---------------------------------------------------------------------
define("ovr", """
  SELECT NULLIF(CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 2 THEN CAST(100000 + c_custkey - 1 AS VARCHAR) ELSE CAST(100000 + c_custkey AS VARCHAR) END, '') amfi_code,
    NULLIF(['Large Cap', '', 'Untrained', ''][c_custkey % 4 + 1], '') category, NULLIF(['Pharma/Healthcare', 'Nowhere', ''][c_custkey % 3 + 1], '') sector,
    CASE WHEN c_custkey % 5 > 0 THEN 'http://sheet' END source_url, CAST(NULL AS VARCHAR) note FROM customer""")
define("ovc", """
  SELECT *, CASE WHEN amfi_code IS NULL THEN 'blank code' WHEN COUNT(*) OVER (PARTITION BY amfi_code) > 1 THEN 'duplicate code'
      WHEN category IS NULL AND sector IS NULL THEN 'neither category nor sector' WHEN category = 'Untrained' THEN 'untrained category' END err FROM ovr""", "ovr")


def override_file(spark, sf):
    key = F.col("c_custkey")
    code = F.when(key % 10 == 0, "").when(key % 10 == 2, (key + 99999).cast("string")).otherwise((key + 100000).cast("string"))
    return X.table(spark, sf, "customer").select(
        code.alias("amfi_code"), choose(("Large Cap", "", "Untrained", ""), key).alias("category"),
        choose(("Pharma/Healthcare", "Nowhere", ""), key).alias("sector"), F.when(key % 5 > 0, "http://sheet").alias("source_url"))


def overrides(spark, sf):
    m = trained_manifest(spark, sf)
    return curation.validate_overrides(override_file(spark, sf), m, m)


@query("override_validation", sql("SELECT amfi_code, category, sector, source_url, note FROM ovc WHERE err IS NULL", "ovc"))
def _(spark, sf):
    return overrides(spark, sf)[0]


@query("override_issues", sql("""
  SELECT amfi_code row_key, 'ERROR' severity, err message FROM ovc WHERE err IS NOT NULL
  UNION ALL SELECT amfi_code, 'WARN', 'unknown sector' FROM ovc WHERE err IS NULL AND sector = 'Nowhere'
  UNION ALL SELECT amfi_code, 'WARN', 'no source_url' FROM ovc WHERE err IS NULL AND source_url IS NULL""", "ovc"))
def _(spark, sf):
    return overrides(spark, sf)[1]


define("outside", """
  SELECT c.fund_id, c.scheme_name, c.category, CASE WHEN c.category <> 'Sectoral/Thematic' THEN 'ready' WHEN o.sector IS NOT NULL THEN 'resolved'
      WHEN o.amfi_code IS NOT NULL THEN 'listed' ELSE 'todo' END state
  FROM cand c LEFT JOIN ovc o ON o.amfi_code = c.fund_id AND o.err IS NULL WHERE NOT in_manifest""", "cand", "ovc")


def outside(spark, sf):
    return curation.outside_candidates(master(spark, sf), trained_manifest(spark, sf), overrides(spark, sf)[0])


@query("curation_gaps", sql("SELECT * FROM outside", "outside"))
def _(spark, sf):
    return outside(spark, sf)


@query("curation_gap_counts", sql("""
  SELECT COUNT(*) n_outside, COUNT(*) FILTER (state = 'ready') n_ready, COUNT(*) FILTER (state <> 'ready') n_blocked, COUNT(*) FILTER (state = 'resolved') n_resolved,
    COUNT(*) FILTER (state IN ('listed', 'todo')) n_uncurated, COUNT(*) FILTER (state = 'todo') n_todo FROM outside""", "outside"))
def _(spark, sf):
    return curation.gap_counts(outside(spark, sf))


@query("curation_worklist", sql("""
  SELECT fund_id amfi_code, 'Sectoral/Thematic' category, '' sector, '' source_url, scheme_name note FROM outside WHERE state = 'todo'""", "outside"))
def _(spark, sf):
    return curation.worklist(outside(spark, sf))


@query("fetch_candidates", sql("SELECT DISTINCT fund_id FROM outside WHERE state IN ('ready', 'resolved')", "outside"))
def _(spark, sf):
    return curation.fetch_candidates(outside(spark, sf))


# --- managers: an order is a stint; the clerk of the order is the scheme's manager ------
define("mgr", """
  SELECT CAST(o_orderkey AS VARCHAR) row_no, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'Manager ' || CAST(o_custkey % 300 AS VARCHAR) END manager_name,
    'Scheme ' || CAST(o_orderkey % 700 AS VARCHAR) scheme_name, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END start_date,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) + (CASE WHEN o_orderkey % 41 = 0 THEN -30 ELSE 400 END) * INTERVAL 1 DAY AS DATE) END end_date,
    CASE WHEN o_orderkey % 4 > 0 THEN 'http://sid' END source_url FROM orders""")
define("mgrc", """
  SELECT *, CASE WHEN manager_name IS NULL THEN 'blank name' WHEN start_date IS NULL THEN 'bad start_date' WHEN end_date < start_date THEN 'end before start' END err FROM mgr""", "mgr")


def manager_file(spark, sf):
    o = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    end = F.date_add(day, F.when(o % 41 == 0, -30).otherwise(400).cast("int"))
    return X.table(spark, sf, "orders").select(
        o.alias("row_no"), F.when(o % 97 == 0, " ").otherwise(F.concat(F.lit("Manager "), (F.col("o_custkey") % 300).cast("string"))).alias("manager_name"),
        F.concat(F.lit("Scheme "), (o % 700).cast("string")).alias("scheme_name"),
        F.when(o % 53 == 0, "soon").otherwise(day.cast("string")).alias("start_date"), F.when(o % 3 == 0, end.cast("string")).alias("end_date"),
        F.when(o % 4 > 0, "http://sid").alias("source_url"))


@query("manager_validation", sql("SELECT row_no, manager_name, scheme_name, start_date, end_date, source_url FROM mgrc WHERE err IS NULL", "mgrc"))
def _(spark, sf):
    return curation.validate_managers(manager_file(spark, sf))[0].drop("amfi_code", "note")


@query("manager_issues", sql("""
  WITH g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lower(manager_name), lower(scheme_name), start_date ORDER BY CAST(row_no AS BIGINT)) k FROM mgrc WHERE err IS NULL)
  SELECT row_no row_key, 'ERROR' severity, err message FROM mgrc WHERE err IS NOT NULL
  UNION ALL SELECT row_no, 'WARN', 'no source_url' FROM g WHERE source_url IS NULL UNION ALL SELECT row_no, 'WARN', 'duplicate' FROM g WHERE k > 1""", "mgrc"))
def _(spark, sf):
    return curation.validate_managers(manager_file(spark, sf))[1]


@query("current_manager", sql("""
  SELECT lower(scheme_name) scheme_key, manager_name, start_date, end_date FROM mgrc WHERE err IS NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY lower(scheme_name) ORDER BY start_date DESC, end_date IS NULL DESC, CAST(row_no AS BIGINT) DESC) = 1""", "mgrc"))
def _(spark, sf):
    return curation.current_manager(curation.validate_managers(manager_file(spark, sf))[0])


@query("manager_prior_funds", sql("""
  WITH a AS (SELECT DISTINCT 'Manager ' || CAST(c_custkey % 300 AS VARCHAR) manager_name, 'Scheme ' || CAST(c_custkey % 700 AS VARCHAR) exclude_scheme FROM customer),
  h AS (SELECT a.*, g.scheme_name, 'managed ' || CAST(start_date AS VARCHAR) || '–' || COALESCE(CAST(end_date AS VARCHAR), 'present') span, CAST(row_no AS BIGINT) r
        FROM a JOIN mgrc g ON g.err IS NULL AND g.manager_name = a.manager_name AND g.scheme_name <> a.exclude_scheme),
  l AS (SELECT manager_name, exclude_scheme, scheme_name, ARG_MAX(span, r) span FROM h GROUP BY 1, 2, 3)
  SELECT manager_name, exclude_scheme, COUNT(*) n_funds, MIN(scheme_name || ': ' || span) first_note FROM l GROUP BY 1, 2""", "mgrc"))
def _(spark, sf):
    key = F.col("c_custkey")
    asked = X.table(spark, sf, "customer").select(
        F.concat(F.lit("Manager "), (key % 300).cast("string")).alias("manager_name"), F.concat(F.lit("Scheme "), (key % 700).cast("string")).alias("exclude_scheme"))
    found = curation.prior_funds(curation.validate_managers(manager_file(spark, sf))[0], asked)
    notes = F.transform(F.map_entries("prior_funds"), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return found.select("manager_name", "exclude_scheme", F.size("prior_funds").cast("bigint").alias("n_funds"), F.array_min(notes).alias("first_note"))


# --- resolution ------------------------------------------------------------------------
define("asks", f"""
  SELECT c_custkey query_id, CASE c_custkey % 4 WHEN 0 THEN CAST(100000 + c_custkey AS VARCHAR)
    WHEN 1 THEN lower({sql_list(HOUSES)}[c_custkey % 6 + 1] || ' ' || {sql_list(THEMES)}[c_custkey % 12 + 1] || ' ' || CAST(c_custkey AS VARCHAR) || ' Fund' || {sql_list(TAILS)}[c_custkey % 7 + 1])
    WHEN 2 THEN {sql_list(THEMES)}[c_custkey % 12 + 1] || ' ' || CAST(c_custkey + 2 AS VARCHAR) || ' fund' ELSE 'INF' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END q FROM customer""")


def asks(spark, sf):
    key = F.col("c_custkey")
    name = F.lower(F.concat(choose(HOUSES, key), F.lit(" "), choose(THEMES, key), F.lit(" "), key.cast("string"), F.lit(" Fund"), choose(TAILS, key)))
    tokens = F.concat(choose(THEMES, key), F.lit(" "), (key + 2).cast("string"), F.lit(" fund"))
    q = F.when(key % 4 == 0, (key + 100000).cast("string")).when(key % 4 == 1, name).when(key % 4 == 2, tokens).otherwise(
        F.concat(F.lit("INF"), F.lpad(key.cast("string"), 9, "0")))
    return X.table(spark, sf, "customer").select(key.alias("query_id"), q.alias("q"))


_tokens = "(SELECT bool_and(contains(upper(n.scheme_name), t)) FROM (SELECT UNNEST(string_split(upper(a.q), ' ')) t))"


@query("resolve_curated", sql("""
  WITH h AS (SELECT query_id, fund_id, 1 tier FROM asks JOIN man2 ON q = fund_id UNION ALL SELECT query_id, fund_id, 2 FROM asks JOIN man2 ON upper(q) = upper(scheme_name)
    UNION ALL SELECT query_id, fund_id, 3 FROM asks, man2 WHERE list_bool_and(list_transform(string_split(upper(q), ' '), lambda t: contains(upper(scheme_name), t)))),
  c AS (SELECT query_id, tier, MIN(fund_id) fund_id, COUNT(*) n FROM h GROUP BY 1, 2),
  b AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY tier) = 1)
  SELECT query_id, CASE WHEN tier IS NULL THEN 'NOT_FOUND' WHEN tier = 3 AND n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END status,
    CASE WHEN tier < 3 OR n = 1 THEN fund_id END fund_id, tier FROM asks LEFT JOIN b USING (query_id)""", "asks", "man2"))
def _(spark, sf):
    return universe.resolve_curated(asks(spark, sf), trained_manifest(spark, sf))


@query("resolve_market", sql("""
  WITH h AS (SELECT query_id, m.*, 1 tier FROM asks JOIN master m ON q = fund_id UNION ALL SELECT query_id, m.*, 2 FROM asks JOIN master m ON upper(q) = isin
    UNION ALL SELECT query_id, m.*, 3 FROM asks JOIN master m ON upper(q) = upper(scheme_name)
    UNION ALL SELECT query_id, m.*, 4 FROM asks, master m WHERE list_bool_and(list_transform(string_split(upper(q), ' '), lambda t: contains(upper(scheme_name), t)))),
  s AS (SELECT *, (CASE WHEN upper(scheme_name) LIKE '%DIRECT%' THEN 2 ELSE 0 END) + (CASE WHEN upper(scheme_name) LIKE '%GROWTH%' THEN 2 ELSE 0 END)
          - (CASE WHEN upper(scheme_name) LIKE '%IDCW%' OR upper(scheme_name) LIKE '%DIVIDEND%' THEN 3 ELSE 0 END) sc FROM h),
  b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY tier, sc DESC, length(scheme_name), line_no) = 1)
  SELECT query_id, b.fund_id, b.scheme_name, b.tier FROM asks LEFT JOIN b USING (query_id)""", "asks", "master"))
def _(spark, sf):
    return universe.resolve_market(asks(spark, sf), master(spark, sf))


# --- cap list, metadata, names ---------------------------------------------------------
define("caps", """
  SELECT p_partkey, ['-', 'SYM' || CAST(p_partkey AS VARCHAR), 'nan', ' sym' || CAST(p_partkey // 2 AS VARCHAR)][p_partkey % 4 + 1] nse,
    CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'B' || CAST(p_partkey AS VARCHAR) END bse, CASE WHEN p_partkey % 50 = 0 THEN 'none' ELSE p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) END company,
    ['LARGE CAP', 'Mid Cap stocks', 'small', 'other'][p_size % 4 + 1] cat FROM part""")
define("capclean", """
  SELECT p_partkey, COALESCE(CASE WHEN trim(nse) NOT IN ('-', 'nan') THEN trim(nse) END, bse) symbol, company,
    CASE cat WHEN 'LARGE CAP' THEN 'Large Cap' WHEN 'Mid Cap stocks' THEN 'Mid Cap' WHEN 'small' THEN 'Small Cap' END cap_band FROM caps WHERE company <> 'none' AND cat <> 'other'""", "caps")


def raw_caps(spark, sf):
    k = F.col("p_partkey")
    nse = F.array(F.lit("-"), F.concat(F.lit("SYM"), k.cast("string")), F.lit("nan"), F.concat(F.lit(" sym"), F.floor(k / 2).cast("string")))[(k % 4).cast("int")]
    return X.table(spark, sf, "part").select(
        k, nse.alias("NSE Symbol"), F.when(k % 8 != 0, F.concat(F.lit("B"), k.cast("string"))).alias("BSE Symbol"),
        F.when(k % 50 == 0, "none").otherwise(F.concat("p_name", F.lit(" "), (k % 500).cast("string"))).alias("Company name"),
        F.array(*[F.lit(c) for c in ("LARGE CAP", "Mid Cap stocks", "small", "other")])[F.col("p_size") % 4].alias("Categorization"))


@query("cap_list_cleaning", sql("SELECT symbol, company, cap_band FROM capclean", "capclean"))
def _(spark, sf):
    return scans.cap_list(raw_caps(spark, sf))


@query("cap_band_lookup", sql("""
  WITH k AS (SELECT p_partkey, 0 i, upper(symbol) lookup_key, split_part(lower(cap_band), ' ', 1) b FROM capclean WHERE symbol IS NOT NULL
             UNION ALL SELECT p_partkey, 1, upper(company), split_part(lower(cap_band), ' ', 1) FROM capclean)
  SELECT lookup_key, ARG_MAX(b, (p_partkey, i)) cap_band FROM k GROUP BY 1""", "capclean"))
def _(spark, sf):
    band = F.lower(F.regexp_extract("Categorization", r"(?i)(large|mid|small)", 1))
    keyed = raw_caps(spark, sf).where((F.col("Company name") != "none") & (band != ""))
    sym = F.trim("NSE Symbol")
    listed = keyed.select("p_partkey", F.coalesce(F.when(~F.lower(sym).isin("", "-", "nan", "none"), sym), F.col("BSE Symbol")).alias("symbol"),
                          F.col("Company name").alias("company"), band.alias("cap_band"))
    return scans.cap_lookup(listed.select("symbol", "company", "cap_band", F.col("p_partkey").alias("_row")), F.col("_row"))


@query("metadata_validation", sql("""
  SELECT CAST(c_custkey AS VARCHAR) fund_id, list_filter([CASE WHEN length(CAST(c_custkey AS VARCHAR)) NOT BETWEEN 4 AND 8 THEN 'code_shape' END,
      CASE WHEN c_custkey % 6 = 1 THEN 'isin_shape' END, CASE WHEN c_acctbal <= 0 THEN 'aum' END, CASE WHEN c_custkey % 40 > 27 THEN 'expense_ratio' END,
      CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0 THEN 'index_benchmark' END, CASE WHEN c_custkey % 9 = 0 THEN 'arbitrage_benchmark' END], lambda x: x IS NOT NULL) errors
  FROM customer"""), lists=('errors',))
def _(spark, sf):
    k = F.col("c_custkey")
    rows = X.table(spark, sf, "customer").select(
        k.cast("string").alias("fund_id"), F.when(k % 3 == 0, F.lit(None)).when(k % 6 == 1, "XX1").otherwise("INF123456789").cast("string").alias("isin"),
        F.col("c_name").alias("scheme_name"), F.lit("House").alias("amc"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Index/ETF").otherwise("Equity").alias("category"),
        F.when(k % 9 == 0, "Arbitrage").otherwise("Other").alias("sub_category"), F.when(k % 2 == 0, "Some Index").otherwise("nifty 50 tri").alias("benchmark"),
        F.col("c_acctbal").alias("aum_cr"), (F.col("c_custkey") % 40 / 1000.0).alias("expense_ratio"), F.lit("2000-01-01").cast("date").alias("inception_date"))
    return cleaning.metadata_errors(rows).select("fund_id", "errors")


@query("missing_parameters", sql("""
  SELECT CAST(c_custkey AS VARCHAR) fund_id, list_filter([CASE WHEN c_custkey % 5 = 4 THEN 'category_not_in_registry:Oddity' END, CASE WHEN c_acctbal < 0 THEN 'holdings_unavailable' END,
      CASE WHEN c_custkey % 5 = 1 AND c_custkey % 3 > 0 THEN 'tri_benchmark_name' END, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'declared_sector_or_theme' END,
      CASE WHEN c_custkey % 5 = 2 THEN 'portfolio_ytm_and_duration_feed' END], lambda x: x IS NOT NULL) missing FROM customer"""), lists=('missing',))
def _(spark, sf):
    k = F.col("c_custkey")
    rows = X.table(spark, sf, "customer").select(
        k.cast("string").alias("fund_id"), choose(("Thematic", "ETF", "Corporate Bond", "Large Cap", "Oddity"), k).alias("category"),
        choose(("Equity", "Other (Index/ETF/FoF)", "Debt", "Equity", "Equity"), k).alias("bucket"), F.when(k % 3 == 0, "NIFTY TRI").alias("benchmark"),
        F.when(k % 2 == 1, "Pharma").alias("declared_sector"), (F.col("c_acctbal") >= 0).alias("holdings_available"))
    return curation.missing_parameters(rows).select("fund_id", "missing")


@query("headline_keyword_scan", sql(r"""
  SELECT doc_id, regexp_matches(lower(text), '\b(?:sebi seeks|show cause|penalty|ban|probe|investigation|front\-running|discontinue)\b') flagged FROM documents"""))
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", word_any("text", K.REGULATORY_TERMS).alias("flagged"))
