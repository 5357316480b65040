"""Portfolio structure, credit, liquidity, overlap, manager audit, news."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import word_any
from ..operators import cleaning, holdings
from ..session import stored
from . import fixtures as X
from .oracle import define, r6, sql
from .registry import query, rounded

_scores = " ".join(f"WHEN '{g}' THEN {v}::DOUBLE" for g, v in K.CREDIT_SCORES.items())


def facts_cte(src: str) -> str:
    return f"""
  WITH e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fund_id, as_of ORDER BY weight DESC, instrument) place FROM {src} WHERE asset_type = 'equity'),
  b AS (SELECT fund_id, as_of, COUNT(*) FILTER (asset_type = 'equity') n_equity,
      COALESCE(SUM(weight) FILTER (asset_type = 'equity'), 0) equity_weight, COALESCE(SUM(weight) FILTER (asset_type = 'cash'), 0) cash_weight,
      COALESCE(SUM(weight) FILTER (asset_type = 'debt'), 0) debt_weight, SUM(weight*weight) FILTER (asset_type = 'equity') sq,
      COUNT(*) FILTER (asset_type = 'equity' AND weight > 0.10 + 1e-9) n_breaches FROM {src} GROUP BY 1, 2),
  t AS (SELECT fund_id, as_of, MAX(instrument) FILTER (place = 1) top1_name, MAX(weight) FILTER (place = 1) top1_weight,
      SUM(weight) FILTER (place <= 5) top5_weight, SUM(weight) top10_weight,
      STRING_AGG(instrument || ' ' || printf('%.1f', weight*100) || '%', ', ' ORDER BY place) FILTER (place <= 5 AND weight > 0.10 + 1e-9) listed
      FROM e WHERE place <= 10 GROUP BY 1, 2),
  s AS (SELECT fund_id, as_of, sector top_sector, sw top_sector_weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fund_id, as_of ORDER BY sw DESC, sector) p FROM
      (SELECT fund_id, as_of, sector, SUM(weight) sw FROM e GROUP BY 1, 2, 3)) WHERE p = 1)
  SELECT *, equity_weight*equity_weight/sq effective_n, CASE WHEN top10_weight IS NOT NULL THEN GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, (0.65::DOUBLE - top10_weight)/0.20::DOUBLE)) END concentration_score
  FROM b LEFT JOIN t USING (fund_id, as_of) LEFT JOIN s USING (fund_id, as_of)"""


define("hfacts", facts_cte("holdings"), "holdings")
define("bfacts", facts_cte("books"), "books")
FACT_NUM = ("equity_weight", "cash_weight", "debt_weight", "top1_weight", "top5_weight", "top10_weight", "effective_n", "concentration_score")
_fact_cols = ", ".join(f"{r6(c)} {c}" for c in FACT_NUM)


@query("holdings_structure", sql(f"SELECT fund_id, as_of, n_equity, n_breaches, {_fact_cols} FROM hfacts", "hfacts"))
def _(spark, sf):
    out = holdings.structure_facts(X.holdings(spark, sf))
    return rounded(out.select("fund_id", "as_of", "n_equity", "n_breaches", *FACT_NUM))


@query("concentrated_books", sql(
    f"SELECT fund_id, as_of, n_equity, n_breaches, top_sector, {r6('top_sector_weight')} top_sector_weight, {_fact_cols} FROM bfacts", "bfacts"))
def _(spark, sf):
    out = holdings.structure_facts(X.order_books(spark, sf))
    return rounded(out.select("fund_id", "as_of", "n_equity", "n_breaches", "top_sector", "top_sector_weight", *FACT_NUM))


@query("single_issuer_findings", sql(
    "SELECT fund_id, as_of, 'single_issuer<=10%' rule_id, n_breaches = 0 passed, n_breaches FROM bfacts WHERE n_equity > 0", "bfacts"))
def _(spark, sf):
    facts = holdings.structure_facts(X.order_books(spark, sf))
    found = holdings.single_issuer_findings(facts).drop("detail")
    return found.join(facts.select("fund_id", "as_of", "n_breaches"), ["fund_id", "as_of"])


@query("top_ten_holdings", sql(f"""
  SELECT fund_id, as_of, instrument, {r6('weight')} weight, place FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY fund_id, as_of ORDER BY weight DESC, instrument) place FROM holdings WHERE asset_type = 'equity')
  WHERE place <= 10""", "holdings"))
def _(spark, sf):
    return rounded(holdings.top_equities(X.holdings(spark, sf)).select("fund_id", "as_of", "instrument", "weight", "place"))


@query("disclosure_weight_sums", sql(f"""
  SELECT fund_id, as_of, COUNT(*) n_lines, {r6('SUM(weight)')} weight_sum, SUM(weight) BETWEEN 0.95 AND 1.05 ok FROM holdings GROUP BY 1, 2""", "holdings"))
def _(spark, sf):
    return rounded(cleaning.weight_sums(X.holdings(spark, sf)))


@query("holding_validation", sql("""
  SELECT fund_id, as_of, instrument, asset_type, list_filter([CASE WHEN length(instrument) < 2 THEN 'instrument' END,
    CASE WHEN NOT (weight > 0 AND weight <= 1) THEN 'weight' END, CASE WHEN rating = 'D' THEN 'rating' END], lambda x: x IS NOT NULL) errors FROM holdings""", "holdings"), lists=('errors',))
def _(spark, sf):
    return cleaning.holding_errors(X.holdings(spark, sf)).select("fund_id", "as_of", "instrument", "asset_type", "errors")


@query("disclosure_flatten", sql(f"SELECT fund_id, as_of, instrument, {r6('weight')} weight FROM books", "books"))
def _(spark, sf):
    # An order's lines arrive as one nested disclosure, as in the raw feed.
    nested = X.order_books(spark, sf).groupBy("fund_id", "as_of").agg(F.collect_list(F.struct("instrument", "weight")).alias("holdings"))
    return rounded(cleaning.flatten_disclosures(nested))


@query("credit_risk_index", sql(f"""
  SELECT fund_id, as_of, {r6(f"SUM(weight*CASE rating {_scores} ELSE 9.0::DOUBLE END)/SUM(weight)")} credit_risk_index
  FROM holdings WHERE asset_type IN ('debt', 'cash') GROUP BY 1, 2""", "holdings"))
def _(spark, sf):
    return rounded(holdings.credit_risk_index(X.holdings(spark, sf)))


define("durations", """
  SELECT fund_id, as_of, SUM(weight*modified_duration)/SUM(weight) modified_duration,
    SUM(weight*COALESCE(macaulay_duration, modified_duration))/SUM(weight) macaulay_duration, SUM(weight*COALESCE(ytm, 0))/SUM(weight) ytm
  FROM holdings WHERE asset_type = 'debt' AND modified_duration IS NOT NULL GROUP BY 1, 2""", "holdings")


@query("duration_profile", sql(
    f"SELECT fund_id, as_of, {r6('modified_duration')} modified_duration, {r6('macaulay_duration')} macaulay_duration, {r6('ytm')} ytm FROM durations", "durations"))
def _(spark, sf):
    return rounded(holdings.duration_profile(X.holdings(spark, sf)))


@query("yield_shock_losses", sql("SELECT fund_id, as_of, " + ", ".join(
    f"{r6(f'-COALESCE(w, 0)*COALESCE(modified_duration, 0)*{b / 10000}::DOUBLE')} stress_pnl_{b}bps" for b in K.YIELD_SHOCKS_BPS) + """
  FROM (SELECT fund_id, as_of, SUM(weight) FILTER (asset_type = 'debt') w FROM holdings GROUP BY 1, 2) LEFT JOIN durations USING (fund_id, as_of)""",
  "holdings", "durations"))
def _(spark, sf):
    return rounded(holdings.yield_shocks(X.holdings(spark, sf)))


@query("debt_concentration", sql(f"""
  WITH i AS (SELECT fund_id, as_of, MAX(w) mi, COUNT(*) FILTER (w > 0.10) ib FROM (SELECT fund_id, as_of, instrument, SUM(weight) w FROM holdings WHERE asset_type = 'debt' GROUP BY 1, 2, 3) GROUP BY 1, 2),
  g AS (SELECT fund_id, as_of, MAX(w) mg, COUNT(*) FILTER (w > 0.20) gb, ARG_MAX(corporate_group, (w, corporate_group)) tg FROM
        (SELECT fund_id, as_of, corporate_group, SUM(weight) w FROM holdings WHERE asset_type = 'debt' AND corporate_group IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT b.fund_id, b.as_of, {r6('COALESCE(mi, 0)')} max_issuer_weight, {r6('COALESCE(mg, 0)')} max_group_weight, COALESCE(ib, 0) issuer_breaches,
    COALESCE(gb, 0) group_breaches, tg top_group
  FROM (SELECT DISTINCT fund_id, as_of FROM holdings) b LEFT JOIN i USING (fund_id, as_of) LEFT JOIN g USING (fund_id, as_of)""", "holdings"))
def _(spark, sf):
    return rounded(holdings.concentration_flags(X.holdings(spark, sf)))


def aum(spark, sf):
    return X.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("fund_id"), (F.abs("s_acctbal") + 100).alias("aum_cr"))


define("liq", """
  SELECT h.*, weight*(abs(s_acctbal) + 100)/(0.20::DOUBLE*adv_cr) AS days FROM holdings h JOIN supplier ON CAST(s_suppkey AS VARCHAR) = fund_id
  WHERE asset_type = 'equity' AND adv_cr IS NOT NULL""", "holdings")


@query("liquidity_profile", sql(f"""
  SELECT fund_id, as_of, {r6('SUM(weight*COALESCE(market_cap_cr, 0))/SUM(weight)')} wavg_market_cap_cr,
    {r6('SUM(weight*days)/SUM(weight)')} days_to_liquidate_wavg, {r6('QUANTILE_CONT(days, 0.9)')} days_to_liquidate_p90 FROM liq GROUP BY 1, 2""", "liq"))
def _(spark, sf):
    return rounded(holdings.liquidity_profile(X.holdings(spark, sf), aum(spark, sf)))


@query("hybrid_profile", sql(f"""
  WITH h AS (SELECT fund_id, as_of, COALESCE(SUM(weight) FILTER (asset_type = 'equity'), 0) e, COALESCE(SUM(weight) FILTER (asset_type = 'equity' AND is_hedged), 0) d
             FROM holdings GROUP BY 1, 2)
  SELECT fund_id, as_of, {r6('e')} equity_allocation, {r6('CASE WHEN e > 1e-12 THEN d/e ELSE 0.0::DOUBLE END')} hedged_ratio, {r6('e - d')} unhedged_equity,
    CASE WHEN e - d >= 0.65 THEN 'aggressive' WHEN e - d >= 0.40 THEN 'balanced' WHEN e - d >= 0.10 THEN 'conservative' ELSE 'arbitrage/defensive' END hybrid_band FROM h""", "holdings"))
def _(spark, sf):
    return rounded(holdings.hybrid_profile(X.holdings(spark, sf)))


@query("risk_profile_by_bucket", sql(f"""
  WITH m AS (SELECT CAST(s_suppkey AS VARCHAR) fund_id, ['Equity','Debt','Hybrid','Solution Oriented','Index/ETF'][s_suppkey % 5 + 1] category FROM supplier),
  c AS (SELECT fund_id, as_of, SUM(weight*CASE rating {_scores} ELSE 9.0::DOUBLE END)/SUM(weight) x FROM holdings WHERE asset_type IN ('debt', 'cash') GROUP BY 1, 2),
  l AS (SELECT fund_id, as_of, SUM(weight*days)/SUM(weight) x FROM liq GROUP BY 1, 2)
  SELECT b.fund_id, b.as_of, category, {r6("CASE WHEN category IN ('Debt','Hybrid','Solution Oriented') THEN c.x END")} credit_risk_index,
    {r6("CASE WHEN category <> 'Debt' THEN l.x END")} days_to_liquidate_wavg
  FROM (SELECT DISTINCT fund_id, as_of FROM holdings) b JOIN m USING (fund_id) LEFT JOIN c USING (fund_id, as_of) LEFT JOIN l USING (fund_id, as_of)""", "holdings", "liq"))
def _(spark, sf):
    kinds = F.array(*[F.lit(c) for c in ("Equity", "Debt", "Hybrid", "Solution Oriented", "Index/ETF")])
    meta = aum(spark, sf).withColumn("category", kinds[(F.col("fund_id").cast("bigint") % 5).cast("int")])
    out = holdings.risk_profile(X.holdings(spark, sf), meta)
    return rounded(out.select("fund_id", "as_of", "category", "credit_risk_index", "days_to_liquidate_wavg"))


@query("category_inference", sql("""
  WITH s AS (SELECT fund_id, as_of, COALESCE(SUM(weight) FILTER (asset_type = 'equity'), 0) eq, COALESCE(SUM(weight) FILTER (asset_type = 'equity' AND cap_band = 'large'), 0) lg,
      COALESCE(SUM(weight) FILTER (asset_type = 'equity' AND cap_band = 'mid'), 0) md, COALESCE(SUM(weight) FILTER (asset_type = 'equity' AND cap_band = 'small'), 0) sm FROM holdings GROUP BY 1, 2),
  t AS (SELECT fund_id, as_of, MAX(w) top FROM (SELECT fund_id, as_of, sector, SUM(weight) w FROM holdings WHERE asset_type = 'equity' GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT fund_id, as_of, CASE WHEN eq < 0.30 THEN 'Corporate Bond' WHEN top >= 0.80 THEN 'Sectoral' WHEN lg >= 0.80 THEN 'Large Cap' WHEN sm >= 0.65 THEN 'Small Cap'
    WHEN md >= 0.65 THEN 'Mid Cap' WHEN eq >= 0.65 THEN 'Flexi Cap' ELSE 'Aggressive Hybrid' END category
  FROM s LEFT JOIN t USING (fund_id, as_of)""", "holdings"))
def _(spark, sf):
    return holdings.infer_category(X.holdings(spark, sf), X.manifest(spark, sf))


define("blist", """
  SELECT CAST(p_partkey AS VARCHAR) lookup_key, CASE WHEN p_retailprice >= 1200 THEN 'large' WHEN p_retailprice >= 1000 THEN 'mid' ELSE 'small' END cap_band
  FROM part WHERE p_size > 5""")


def band_list(spark, sf):
    p = X.table(spark, sf, "part").where(F.col("p_size") > 5)
    band = F.when(F.col("p_retailprice") >= 1200, "large").when(F.col("p_retailprice") >= 1000, "mid").otherwise("small")
    return p.select(F.col("p_partkey").cast("string").alias("lookup_key"), band.alias("cap_band"))


@query("cap_band_overlay", sql("""
  SELECT h.fund_id, h.as_of, h.instrument, CASE WHEN asset_type = 'equity' AND b.cap_band IS NOT NULL THEN b.cap_band ELSE h.cap_band END cap_band
  FROM holdings h LEFT JOIN blist b ON b.lookup_key = upper(h.instrument)""", "holdings", "blist"))
def _(spark, sf):
    return holdings.overlay_cap_bands(X.holdings(spark, sf), band_list(spark, sf)).select("fund_id", "as_of", "instrument", "cap_band")


define("snaps", """
  SELECT fund_id, label, ARG_MIN(as_of, (abs(date_diff('day', target, as_of)), as_of)) as_of
  FROM (SELECT DISTINCT fund_id, as_of FROM holdings),
       (VALUES ('t-5y', DATE '1996-11-15'), ('t-3y', DATE '1998-11-15'), ('current', DATE '2001-11-15')) v(label, target) GROUP BY 1, 2""", "holdings")


@query("nearest_snapshots", sql("""
  SELECT m.fund_id, l.label, s.as_of, s.as_of IS NOT NULL available
  FROM (SELECT fund_id FROM manifest UNION ALL SELECT DISTINCT 'new ' || amc FROM manifest WHERE amc IS NOT NULL) m
  CROSS JOIN (VALUES ('t-5y'), ('t-3y'), ('current')) l(label) LEFT JOIN snaps s ON s.fund_id = m.fund_id AND s.label = l.label""", "manifest", "snaps"))
def _(spark, sf):
    """All books; a new fund of each house has published nothing."""
    listed = X.manifest(spark, sf)
    new = listed.where(F.col("amc").isNotNull()).select(F.concat(F.lit("new "), "amc").alias("fund_id")).distinct()
    books = X.holdings(spark, sf).select("fund_id", "as_of").distinct()
    return holdings.snapshots(books, F.lit(X.TODAY), listed.select("fund_id").union(new))


@query("active_share", sql(f"""
  WITH ix AS (SELECT instrument, SUM(weight)/(SELECT SUM(weight) FROM holdings) w FROM holdings GROUP BY 1),
  j AS (SELECT fund_id, as_of, SUM(abs(h.weight - COALESCE(ix.w, 0))) d, SUM(COALESCE(ix.w, 0)) m FROM holdings h LEFT JOIN ix USING (instrument) GROUP BY 1, 2)
  SELECT fund_id, as_of, {r6('(d + (SELECT SUM(w) FROM ix) - m)/2')} active_share FROM j""", "holdings"))
def _(spark, sf):
    book = X.holdings(spark, sf)
    total = book.agg(F.sum("weight")).scalar()
    index = book.groupBy("instrument").agg(F.sum("weight").alias("_w")).select("instrument", (F.col("_w") / total).alias("weight"))
    return rounded(holdings.active_share(book, index))


def rule_funds(spark, sf):
    cats = F.array(*[F.lit(c) for c in ("Thematic", "Large Cap", "Flexi Cap", "Value", "Corporate Bond", "Mid Cap")])
    return X.manifest(spark, sf).select("fund_id", "amc", cats[(F.col("fund_id").cast("bigint") % 6).cast("int")].alias("category"))


def rule_table(spark):
    return spark.createDataFrame(list(K.CATEGORY_RULES), K.CATEGORY_RULE_SCHEMA)


define("rfunds", """
  SELECT fund_id, amc, ['Thematic','Large Cap','Flexi Cap','Value','Corporate Bond','Mid Cap'][CAST(fund_id AS BIGINT) % 6 + 1] category FROM manifest""", "manifest")
define("sib", """
  SELECT a.fund_id, b.fund_id other_id FROM rfunds a JOIN rfunds b ON a.amc = b.amc AND a.fund_id <> b.fund_id
  WHERE a.category IN ('Thematic', 'Value') AND b.category IN ('Thematic', 'Flexi Cap', 'Value', 'Mid Cap')""", "rfunds")


@query("sibling_schemes", sql("SELECT fund_id, other_id, 0.5::DOUBLE overlap_cap FROM sib", "sib"))
def _(spark, sf):
    return holdings.sibling_pairs(rule_funds(spark, sf), rule_table(spark))


define("dover", """
  WITH d AS (SELECT DISTINCT fund_id, dt FROM dweights),
  c AS (SELECT s.fund_id, s.other_id, a.dt FROM sib s JOIN d a ON a.fund_id = s.fund_id JOIN d b ON b.fund_id = s.other_id AND b.dt = a.dt),
  o AS (SELECT s.fund_id, s.other_id, a.dt, SUM(LEAST(a.weight, b.weight)) x FROM sib s JOIN dweights a ON a.fund_id = s.fund_id
        JOIN dweights b ON b.fund_id = s.other_id AND b.dt = a.dt AND b.ticker = a.ticker GROUP BY 1, 2, 3)
  SELECT c.fund_id, c.other_id, c.dt, COALESCE(x, 0) overlap FROM c LEFT JOIN o USING (fund_id, other_id, dt)""", "sib", "dweights")


@query("portfolio_overlap", sql(f"SELECT fund_id, other_id, dt, {r6('overlap')} overlap FROM dover", "dover"))
def _(spark, sf):
    return rounded(holdings.sibling_overlap(X.daily_weights(spark, sf), rule_funds(spark, sf), rule_table(spark)))


@query("quarterly_overlap", sql(f"""
  SELECT fund_id, other_id, CAST(date_trunc('quarter', dt) AS DATE) AS quarter, {r6('AVG(overlap)')} overlap, COUNT(*) n_days FROM dover GROUP BY 1, 2, 3""", "dover"))
def _(spark, sf):
    return rounded(holdings.quarterly_means(holdings.sibling_overlap(X.daily_weights(spark, sf), rule_funds(spark, sf), rule_table(spark), "quarter")))


# Instrument prices: average unit price of a part per ship month; sector levels per brand.
define("prices", """
  SELECT CAST(l_partkey AS VARCHAR) instrument, last_day(CAST(l_shipdate AS DATE)) dt, SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT))/CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) px
  FROM lineitem GROUP BY 1, 2""")
define("brand_levels", """
  SELECT p_brand sector, last_day(CAST(l_shipdate AS DATE)) dt, SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT))/CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS level
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
define("picks", """
  SELECT s.fund_id, s.label, s.as_of, e.instrument, e.sector, e.weight FROM snaps s JOIN (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY fund_id, as_of ORDER BY weight DESC, instrument) place FROM holdings WHERE asset_type = 'equity') e
  ON e.fund_id = s.fund_id AND e.as_of = s.as_of AND place <= 10 WHERE s.label <> 'current'""", "snaps", "holdings")


def _since(src: str, key: str, v: str, tag: str) -> str:
    return f"""(SELECT {key}, as_of, CASE WHEN MAX(dt) > MIN(dt) THEN POWER(ARG_MAX({v}, dt)/ARG_MIN({v}, dt), 365.25::DOUBLE/date_diff('day', MIN(dt), MAX(dt))) - 1 END {tag}_cagr, MIN(fall) {tag}_dd FROM (
      SELECT a.{key}, a.as_of, s.dt, s.{v}, s.{v}/MAX(s.{v}) OVER (PARTITION BY a.{key}, a.as_of ORDER BY s.dt) - 1 fall
      FROM (SELECT DISTINCT {key}, as_of FROM picks) a JOIN {src} s ON s.{key} = a.{key} AND s.dt >= a.as_of) GROUP BY 1, 2)"""


define("audit", f"""
  SELECT p.*, x.stock_cagr, x.stock_dd stock_max_dd, y.sector_cagr, x.stock_cagr - y.sector_cagr excess_cagr, COALESCE(x.stock_cagr - y.sector_cagr > 0, FALSE) beat_sector
  FROM picks p JOIN {_since('prices', 'instrument', 'px', 'stock')} x USING (instrument, as_of) JOIN {_since('brand_levels', 'sector', 'level', 'sector')} y USING (sector, as_of)""",
       "picks", "prices", "brand_levels")


@stored
def audit_rows(spark, sf):
    book = X.holdings(spark, sf)
    snaps = holdings.snapshots(book.select("fund_id", "as_of").distinct(), F.lit(X.TODAY)).where(F.col("label") != "current")
    picks = holdings.top_equities(book).join(snaps.select("fund_id", "label", "as_of"), ["fund_id", "as_of"]).select(
        "fund_id", "label", "as_of", "instrument", "sector", "weight")
    li = X.table(spark, sf, "lineitem")
    unit = (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.sum(F.col("l_quantity").cast("bigint")).cast("double"))
    month = F.last_day(F.to_date("l_shipdate")).alias("dt")
    prices = li.groupBy(F.col("l_partkey").cast("string").alias("instrument"), month).agg(unit.alias("px"))
    brands = li.join(X.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("sector"), month).agg(unit.alias("level"))
    return holdings.stock_audit(picks, prices, brands)


_audit = ("weight", "stock_cagr", "stock_max_dd", "sector_cagr", "excess_cagr")


@query("stock_pick_audit", sql("SELECT fund_id, label, as_of, instrument, sector, beat_sector, "
                               + ", ".join(f"{r6(c)} {c}" for c in _audit) + " FROM audit", "audit"))
def _(spark, sf):
    return rounded(audit_rows(spark, sf))


define("macs", """
  WITH w AS (SELECT fund_id, label, AVG(CAST(beat_sector AS INTEGER)) hit, SUM(weight*excess_cagr)/SUM(weight) ex, SUM(weight*stock_max_dd)/SUM(weight) dd FROM audit GROUP BY 1, 2)
  SELECT fund_id, COUNT(*) n_windows, AVG(hit) hit_rate, AVG(ex) mean_excess, AVG(dd) avg_stock_max_dd,
    round(100*(0.45::DOUBLE*AVG(hit) + 0.35::DOUBLE*GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, (AVG(ex) + 0.06::DOUBLE)/0.12::DOUBLE))
      + 0.20::DOUBLE*CASE WHEN MIN(ex) > 0 THEN 1.0::DOUBLE WHEN MAX(ex) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 1) macs
  FROM w GROUP BY 1""", "audit")


@query("manager_consistency_score", sql(
    f"SELECT fund_id, n_windows, {r6('hit_rate')} hit_rate, {r6('mean_excess')} mean_excess, {r6('avg_stock_max_dd')} avg_stock_max_dd, macs FROM macs", "macs"))
def _(spark, sf):
    return rounded(holdings.manager_score(audit_rows(spark, sf)))


# News: an event is an item; the user is the entity; the kind sets the tone and headline.
HEADLINES = ("record inflows", "sebi seeks clarification", "banking rally", "ban on new units", "quiet month")
define("news", """
  SELECT CAST(user_id AS VARCHAR) entity, CAST(ts AS DATE) dt, CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END tone,
    ['record inflows','sebi seeks clarification','banking rally','ban on new units','quiet month'][event_id % 5 + 1] headline FROM events""")


def news(spark, sf):
    heads = F.array(*[F.lit(h) for h in HEADLINES])
    tone = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "purchase", 1).otherwise(0)
    rows = X.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity"), F.to_date("ts").alias("dt"), tone.alias("tone"),
        heads[(F.col("event_id") % 5).cast("int")].alias("headline"))
    return rows.withColumn("is_flag", word_any("headline", K.REGULATORY_TERMS))


define("ents", """
  SELECT fund_id, fund_id entity FROM manifest UNION SELECT fund_id, CAST(CAST(fund_id AS BIGINT) + 1 AS VARCHAR) FROM manifest""", "manifest")
define("senti", """
  WITH n AS (SELECT entity, POWER(0.5::DOUBLE, GREATEST(0, date_diff('day', dt, DATE '2024-02-01'))/14.0::DOUBLE) w, tone,
               headline IN ('sebi seeks clarification', 'ban on new units') f FROM news)
  SELECT e.fund_id, COALESCE(round(SUM(w*tone)/SUM(w), 2), 0) + 0.0 net_sentiment, COUNT(w) n_items, COUNT(w) FILTER (f) n_red_flags
  FROM ents e LEFT JOIN n USING (entity) GROUP BY 1""", "ents", "news")


def sentiment_rows(spark, sf):
    funds = X.manifest(spark, sf).select("fund_id", F.col("fund_id").alias("amc"), (F.col("fund_id").cast("bigint") + 1).cast("string").alias("manager"))
    return holdings.sentiment(news(spark, sf), holdings.news_entities(funds, X.holdings(spark, sf)), F.lit("2024-02-01").cast("date"))


@query("news_sentiment", sql("SELECT fund_id, net_sentiment, n_items, n_red_flags FROM senti", "senti"))
def _(spark, sf):
    return rounded(sentiment_rows(spark, sf))


@query("news_keyword_flags", sql("""
  SELECT entity, dt, headline, headline IN ('sebi seeks clarification', 'ban on new units') is_flag, COUNT(*) n FROM news GROUP BY 1, 2, 3, 4""", "news"))
def _(spark, sf):
    return news(spark, sf).groupBy("entity", "dt", "headline", "is_flag").agg(F.count(F.lit(1)).alias("n"))
