"""Mandate checks per fund as long findings: (fund_id, rule_id, passed, severity, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import percent, sorted_array
from . import holdings

EPS = 1e-9


def rule_table(spark: SparkSession) -> DataFrame:
    """The category rules; a fixed table of nineteen rows."""
    return spark.createDataFrame(list(K.CATEGORY_RULES), K.CATEGORY_RULE_SCHEMA)


def book_totals(lines: DataFrame, funds: DataFrame) -> DataFrame:
    """Per fund: equity weight, weight per cap band, in the declared sector, and in the largest debt sector.

    ``lines`` hold one book per fund.
    """
    rows = lines.join(funds.select("fund_id", "declared_sector"), "fund_id")
    equity = F.col("asset_type") == "equity"

    def total(mask: Column) -> Column:
        return F.coalesce(F.sum(F.when(mask, F.col("weight"))), F.lit(0.0))

    sums = rows.groupBy("fund_id").agg(
        total(equity).alias("eq"), *[total(equity & (F.col("cap_band") == b)).alias(f"w_{b}") for b in ("large", "mid", "small")],
        total(equity & (F.col("sector") == F.col("declared_sector"))).alias("w_declared"))
    debt = rows.where(F.col("asset_type") == "debt").groupBy("fund_id", "sector").agg(F.sum("weight").alias("w")).groupBy("fund_id").agg(
        F.max("w").alias("w_debt_sector"))
    return sums.join(debt, "fund_id", "left")


def _finding(rule: Column | str, passed: Column, failed_severity: str, detail: Column) -> Column:
    return F.struct(
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), passed.alias("passed"),
        F.when(passed, "info").otherwise(failed_severity).alias("severity"), detail.alias("detail"))


def _floor_name(prefix: str, floor: Column) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%.0f%%", floor * 100))


def verify(funds: DataFrame, lines: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """All findings.  ``funds``: fund_id, scheme_name, category, declared_sector; ``lines``: current
    books; ``overlaps``: (fund_id, other_id, overlap)."""
    spark = funds.sparkSession
    facts = holdings.structure_facts(lines)
    issuer = holdings.single_issuer_findings(facts).select(
        "fund_id", F.struct("rule_id", "passed", "detail").alias("issuer"))
    rows = (
        funds.select("fund_id", "scheme_name", "category", "declared_sector").join(rule_table(spark), "category", "left").join(book_totals(lines, funds), "fund_id", "left").join(issuer, "fund_id", "left")
    )
    known, has_book = F.col("bucket").isNotNull(), F.col("eq").isNotNull()
    segment, floor = F.col("segment"), F.col("segment_floor")
    seg_weight = F.when(segment == "large", F.col("w_large")).when(segment == "mid", F.col("w_mid")).when(segment == "small", F.col("w_small"))
    name = F.lower("scheme_name")
    in_name = F.contains(name, F.lower("category"))
    words = F.filter(F.array(*[F.lit(w) for w in K.RETURN_WORDS]), lambda w: F.contains(name, w))
    declared = segment.isin("declared_sector", "declared_theme") & F.col("declared_sector").isNotNull()
    debt_share = F.coalesce("w_debt_sector", F.lit(0.0))
    ruled = known & has_book
    found = sorted_array(
        F.when(~known, _finding("category_known", F.lit(False), "warning", F.concat(F.lit("category not in the registry: "), F.coalesce("category", F.lit("?"))))),
        F.when(F.col("bucket") == "Solution Oriented (DISCONTINUED)",
               _finding("solution_oriented_discontinued", F.lit(False), "critical", F.lit("category discontinued"))),
        F.when(known & ~has_book, _finding("cap_fidelity_min_equity_and_overlap_checks", F.lit(False), "warning", F.lit("NOT AVAILABLE: no portfolio disclosure, checks not evaluated"))),
        F.when(ruled & seg_weight.isNotNull() & floor.isNotNull(),
               _finding(F.concat(F.lit("cap_fidelity_"), segment, _floor_name(">= ", floor)), seg_weight >= floor - EPS, "critical",
                        F.concat(segment, F.lit("-cap exposure "), percent(seg_weight)))),
        F.when(ruled & declared, _finding("sector_theme_fidelity>=80%", F.col("w_declared") >= F.coalesce(floor, F.lit(0.80)) - EPS, "critical",
                                          F.concat("declared_sector", F.lit(" exposure "), percent("w_declared")))),
        F.when(ruled & (segment == "single_sector_debt"), _finding("sectoral_debt>=80%_single_sector", debt_share >= 0.80, "critical",
                                                                     F.concat(F.lit("largest debt sector "), percent(debt_share)))),
        F.when(ruled & F.col("equity_floor").isNotNull(),
               _finding(_floor_name("min_equity>=", F.col("equity_floor")), F.col("eq") >= F.col("equity_floor") - EPS, "critical",
                        F.concat(F.lit("equity allocation "), percent("eq")))),
        F.when(ruled & F.col("bucket").isin("Equity", "Hybrid") & F.col("issuer").isNotNull(),
               _finding(F.col("issuer.rule_id"), F.col("issuer.passed"), "critical", F.col("issuer.detail"))),
        F.when(known, _finding("scheme_name_matches_category", in_name, "warning", F.concat(F.lit("category "), F.col("category")))),
        F.when(known, _finding("no_return_focused_words_in_name", F.size(words) == 0, "warning", F.concat(F.lit("flagged: "), F.array_join(words, ", ")))),
    )
    out = rows.select("fund_id", F.explode(found).alias("f")).select("fund_id", "f.*")
    if overlaps is None:
        return out
    capped = overlaps.join(rows.where(ruled & F.col("overlap_cap").isNotNull()).select("fund_id", "overlap_cap"), "fund_id")
    passed = F.col("overlap") <= F.col("overlap_cap") + EPS
    pairs = capped.select("fund_id", _finding(
        F.concat(F.lit("overlap_vs["), F.col("other_id"), F.lit("]<=50%")), passed, "critical",
        F.concat(F.lit("mean daily overlap "), percent("overlap"))).alias("f"))
    return out.unionByName(pairs.select("fund_id", "f.*"))


def compliance_code(rule_id: Column | str) -> Column:
    """Typed alert code of a finding; prefixes are tested in this order."""
    r = F.col(rule_id) if isinstance(rule_id, str) else rule_id
    return (
        F.when(r.startswith("cap_fidelity_min_equity_and_overlap"), "SEBI_CHECKS_NOT_EVALUATED")
        .when(r.startswith("cap_fidelity_"), "SEBI_CAP_FIDELITY_BREACH")
        .when(r.startswith("sector_theme_fidelity") | r.startswith("sectoral_debt"), "SEBI_SECTOR_FIDELITY_BREACH")
        .when(r.startswith("min_equity"), "SEBI_MIN_EQUITY_BREACH").when(r.startswith("overlap_vs"), "SEBI_OVERLAP_BREACH")
        .when(r == "solution_oriented_discontinued", "SEBI_CATEGORY_DISCONTINUED").when(r == "category_known", "SEBI_CATEGORY_UNKNOWN")
        .when(r == "scheme_name_matches_category", "NAME_CATEGORY_MISMATCH").when(r == "no_return_focused_words_in_name", "RETURN_FOCUSED_NAME")
        .when(r.startswith("single_issuer"), "SEBI_SINGLE_ISSUER_BREACH").otherwise(F.concat(F.lit("SEBI_OTHER["), r, F.lit("]")))
    )
