"""Fund-shaped inputs derived by Spark from the test tables (see FIXTURES.md part 2).

A supplier is a fund, its ship dates are its price dates, a nation is a fund house or sector,
a region is a category.  Everything grows with the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

# --- Fixed values: settings of the derived series ----------------------------------
OBS_PER_YEAR = 80
TODAY = dt.date(2001, 11, 15)
ANCHOR_FROM, ANCHOR_TO = dt.date(1996, 1, 1), dt.date(1998, 10, 1)
SECTOR_REGIONS = ("AFRICA", "EUROPE")
NO_SERIES_REGION = "MIDDLE EAST"
PRICE_RETURN_REGION = "ASIA"
DERIVED_BLOCKS = (
    ("B1", "1996-01-31", "1996-06-30"),
    ("B2", "1996-07-31", "1996-12-31"),
    ("B3", "1997-01-31", "1997-06-30"),
    ("B4", "1997-07-31", "1998-02-28"),
    ("B5", "1998-03-31", "1998-10-31"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _levels(steps: DataFrame, key: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("dt")
    walk = F.sum("step").over(w).cast("double") * 3 + F.row_number().over(w)
    return steps.select(key, "dt", (F.lit(100.0) * F.exp(walk / 1000.0)).alias(value),
                        F.row_number().over(w).alias("k"))


def _steps(lines: DataFrame, key: str) -> DataFrame:
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    return lines.groupBy(key, F.to_date("l_shipdate").alias("dt")).agg(
        (F.sum(cents) - F.count(F.lit(1)) * 5).alias("step"))


@stored
def nav_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("fund_id"), "l_shipdate", "l_discount")
    return _levels(_steps(lines, "fund_id"), "fund_id", "nav")


def nav(spark: SparkSession, sf: str) -> DataFrame:
    return nav_rows(spark, sf).drop("k")


@stored
def dirty_nav(spark: SparkSession, sf: str) -> DataFrame:
    """Prices with injected bad prints, and payouts on every tenth fund."""
    rows = nav_rows(spark, sf)
    key = F.col("fund_id").cast("bigint")
    payout = key % 10 == 3
    bad = F.when((key * 31 + F.col("k")) % 97 == 0, 1.13).otherwise(1.0)
    paid = F.when(payout & (F.col("k") > 200), 0.94).otherwise(1.0)
    return rows.select("fund_id", "dt", (F.col("nav") * bad * paid).alias("nav"), payout.alias("is_payout_plan"))


@stored
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    sectoral = F.col("r_name").isin(*SECTOR_REGIONS)
    return (
        s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").cast("string").alias("fund_id"),
            F.concat(F.lit("Fund "), "s_name").alias("scheme_name"),
            F.col("n_name").alias("amc"), F.col("r_name").alias("region"),
            F.when(sectoral, "Sectoral/Thematic").otherwise(F.col("r_name")).alias("category"),
            F.when(sectoral, F.col("n_name")).alias("sector"),
        )
    )


def anchors(spark: SparkSession) -> DataFrame:
    months = F.sequence(F.lit(ANCHOR_FROM), F.lit(ANCHOR_TO), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("m")).select(F.last_day("m").alias("anchor"))


def fund_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Every fund at every month-end of the derived grid."""
    months = F.sequence(F.lit(ANCHOR_FROM), F.lit(ANCHOR_TO), F.expr("interval 1 month"))
    funds = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fund_id"))
    return funds.select("fund_id", F.explode(months).alias("m")).select("fund_id", F.last_day("m").alias("anchor"))


@stored
def bench(spark: SparkSession, sf: str) -> DataFrame:
    """Regional index levels and one all-market series."""
    funds = manifest(spark, sf).where(F.col("region") != NO_SERIES_REGION).select("fund_id", F.col("region").alias("name"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("fund_id"), "l_shipdate", "l_discount")
    regional = _steps(lines.join(funds, "fund_id"), "name")
    market = _steps(lines.withColumn("name", F.lit("ALL")), "name")
    # A region pools many steps a day; a tenth of the pooled step keeps levels fund-like.
    pooled = regional.unionByName(market).withColumn("step", F.floor(F.col("step") / 10))
    return _levels(pooled, "name", "level").drop("k")


def bench_meta(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.col("r_name").alias("name"))
    named = r.unionByName(spark.range(1).select(F.lit("ALL").alias("name")))
    return named.select(
        "name",
        F.when(F.col("name") == NO_SERIES_REGION, "NONE").otherwise("file").alias("source"),
        F.when(F.col("name") == PRICE_RETURN_REGION, "PRI").otherwise("fund_NAV").alias("return_type"),
    )


def fund_bench(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).select("fund_id", F.col("region").alias("name"))


def quarter_end(ship: str = "l_shipdate"):
    return F.last_day(F.add_months(F.trunc(F.to_date(ship), "quarter"), 2))


@stored
def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """One book per fund and quarter, its lines weighted by extended price."""
    value = table(spark, sf, "lineitem").groupBy("l_suppkey", quarter_end().alias("as_of"), "l_partkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("v"))
    total = value.groupBy("l_suppkey", "as_of").agg(F.sum("v").alias("t"))
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type") == "PROMO", "debt").when(F.col("p_type") == "STANDARD", "cash").otherwise("equity")
    band = F.when(F.col("p_size") <= 16, "large").when(F.col("p_size") <= 33, "mid").otherwise("small")
    grades = F.array(*[F.lit(g) for g in ("SOV", "AAA", "AA+", "AA", "A+", "BBB", "UNRATED", "D")])
    return (
        value.join(total, ["l_suppkey", "as_of"]).join(p, value.l_partkey == p.p_partkey)
        .select(
            F.col("l_suppkey").cast("string").alias("fund_id"), "as_of",
            F.col("l_partkey").cast("string").alias("instrument"),
            (F.col("v").cast("double") / F.col("t").cast("double")).alias("weight"),
            kind.alias("asset_type"), F.col("p_brand").alias("sector"), band.alias("cap_band"),
            grades[(F.col("l_partkey") % 8).cast("int")].alias("rating"),
            F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("GROUP"), (F.col("l_partkey") % 5).cast("string"))).alias("corporate_group"),
            F.when(F.col("l_partkey") % 11 != 0, F.col("p_retailprice")).alias("market_cap_cr"),
            F.when(F.col("l_partkey") % 7 != 0, F.col("p_size").cast("double") / 4 + 1).alias("adv_cr"),
            F.when(F.col("l_partkey") % 6 != 0, F.col("p_size").cast("double") / 10).alias("modified_duration"),
            F.when(F.col("l_partkey") % 4 == 0, F.col("p_size").cast("double") / 9).alias("macaulay_duration"),
            F.when(F.col("l_partkey") % 5 != 0, F.col("p_size").cast("double") / 1000).alias("ytm"),
            (F.col("l_partkey") % 9 == 0).alias("is_hedged"),
        )
    )


@stored
def order_books(spark: SparkSession, sf: str) -> DataFrame:
    """Small concentrated books: an order is a fund, its lines are issuers."""
    li = table(spark, sf, "lineitem")
    value = li.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("v"))
    total = value.groupBy("l_orderkey").agg(F.sum("v").alias("t"))
    return value.join(total, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("fund_id"), F.lit(dt.date(2001, 11, 1)).alias("as_of"),
        F.col("l_suppkey").cast("string").alias("instrument"),
        (F.col("v").cast("double") / F.col("t").cast("double")).alias("weight"),
        F.when(F.col("l_suppkey") % 4 == 0, "debt").otherwise("equity").alias("asset_type"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")).alias("sector"),
    )


@stored
def daily_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights per fund and ship date; a ticker is a brand."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    li = table(spark, sf, "lineitem")
    value = li.join(p, li.l_partkey == p.p_partkey).groupBy(
        "l_suppkey", F.to_date("l_shipdate").alias("dt"), "p_brand"
    ).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("v"))
    total = value.groupBy("l_suppkey", "dt").agg(F.sum("v").alias("t"))
    return value.join(total, ["l_suppkey", "dt"]).select(
        F.col("l_suppkey").cast("string").alias("fund_id"), "dt", F.col("p_brand").alias("ticker"),
        (F.col("v").cast("double") / F.col("t").cast("double")).alias("weight"))
