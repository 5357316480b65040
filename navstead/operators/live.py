"""Batch scoring at each fund's own latest anchor, behind ordered refusal gates.

Reference funds (the manifest) are scored as if no candidate existed.  A candidate is measured
against reference peers only: group totals, cross-section statistics and rank pools hold
reference rows, and the candidate is placed among them.  All candidates go through together.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ranking import cumulative_counts
from ..session import cut_lineage
from . import cohorts, inference, peers, universe
from . import features as feats
from .series import asof, with_returns, window_drawdown


class LiveScores(NamedTuple):
    """Scores with ``cohort_id`` and ``cohort_added``, and the members (cohort_id, fund_id)."""

    rows: DataFrame
    members: DataFrame


def live_anchors(nav: DataFrame, today: Column) -> DataFrame:
    """(fund_id, anchor, staleness_days): the earlier of the last price date and today."""
    last = nav.groupBy("fund_id").agg(F.max("dt").alias("_last"))
    anchor = F.least(F.col("_last"), today)
    return last.select("fund_id", anchor.alias("anchor"), F.datediff(today, anchor).alias("staleness_days"))


def requests_state(requests: DataFrame, manifest: DataFrame, nav: DataFrame, master: DataFrame, overrides: DataFrame,
                   today: Column) -> DataFrame:
    """Per requested fund: membership, registry verdict, sector, anchor, and the first gates' status."""
    listed = manifest.select("fund_id", F.lit(True).alias("_listed"), F.col("category").alias("_mcat"), F.col("sector").alias("_msec"))
    verdict = universe.classify(master, manifest).select("fund_id", F.col("status").alias("_verdict"), F.col("category").alias("_vcat"))
    curated = overrides.where(F.col("sector").isNotNull()).groupBy(F.col("amfi_code").alias("fund_id")).agg(F.max("sector").alias("_osec"))
    rows = (
        requests.select("fund_id").distinct().join(listed, "fund_id", "left").join(live_anchors(nav, today), "fund_id", "left")
        .join(verdict, "fund_id", "left").join(curated, "fund_id", "left")
    )
    known = F.col("_listed").isNotNull() & F.col("anchor").isNotNull()
    trained = F.col("_verdict") == universe.TRAINED
    keyed = F.col("_vcat") == K.SECTOR_KEYED
    status = (
        F.when(~known & (F.col("_verdict") == universe.OUTSIDE), "OUT_OF_TRAINING_UNIVERSE")
        .when(~known & trained & keyed & F.col("_osec").isNull(), "SECTOR_UNRESOLVED")
        .when(~known & ~F.coalesce(trained & F.col("anchor").isNotNull(), F.lit(False)), "NOT_IN_UNIVERSE")
        .when(F.col("staleness_days") > K.STALE_MAX_DAYS, "STALE_NAV")
    )
    return rows.select(
        "fund_id", known.alias("is_ref"), F.when(known, F.col("_mcat")).otherwise(F.col("_vcat")).alias("category"),
        F.when(known, F.col("_msec")).when(keyed, F.col("_osec")).alias("sector"), "anchor", "staleness_days", status.alias("early_status"))


def reference_pairs(manifest: DataFrame, nav: DataFrame, anchors: DataFrame) -> DataFrame:
    """Manifest funds with a fresh price at each live anchor.

    Anchors lie within the staleness limit of today, so there are at most a month of them.
    """
    dates = anchors.select("anchor").distinct().agg(F.collect_set("anchor")).scalar()
    asked = manifest.select("fund_id").withColumn("anchor", F.explode(dates))
    return asof(nav, asked, "fund_id", ["nav"], "anchor").where(F.col("hit").isNotNull()).select("fund_id", "anchor")


def candidate_sector_days(returns: DataFrame, manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sector and all-sector composites as each candidate sees them: reference members plus itself."""
    keyed = candidates.where((F.col("category") == K.SECTOR_KEYED) & F.col("sector").isNotNull())
    named = keyed.select("fund_id", F.explode(F.array("sector", F.lit("*"))).alias("series"))
    members = manifest.where(F.col("category") == K.SECTOR_KEYED).select(
        "fund_id", F.explode(F.array_compact(F.array("sector", F.lit("*")))).alias("series"))
    totals = peers.group_day_totals(returns, members, "series").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(peers.SALTS - 1))))
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("fund_id"), F.lit(peers.SALTS)).cast("int"))
    shared = salted.join(totals, ["series", "_salt"]).select("fund_id", "series", "dt", "total", "n")
    own = named.join(returns, "fund_id").select("fund_id", "series", "dt", F.col("r").alias("total"), F.lit(1).cast("bigint").alias("n"))
    return shared.unionByName(own).groupBy("fund_id", "series", "dt").agg((F.sum("total") / F.sum("n")).alias("r"))


def live_rows(nav: DataFrame, manifest: DataFrame, candidates: DataFrame, pairs: DataFrame, days: int) -> DataFrame:
    """Features of reference pairs and of candidates (fund_id, category, sector, anchor) in one pass, with ``is_ref``."""
    base = manifest.select("fund_id", "category", "sector").withColumn("is_ref", F.lit(True))
    added = candidates.select("fund_id", "category", "sector").withColumn("is_ref", F.lit(False))
    # A manifest fund among the candidates has no prices of its own, so it is in no total.
    both = base.join(added.select("fund_id"), "fund_id", "left_anti").unionByName(added)
    keyed = peers.with_group_key(both, pinned=manifest)
    asked = pairs.unionByName(candidates.select("fund_id", "anchor"))
    own = feats.own_and_peer_features(nav, keyed, asked, days)
    falls = window_drawdown(nav, asked, 36).withColumnRenamed("max_dd", "max_dd_3y")

    returns = with_returns(nav).where(F.col("r").isNotNull()).select("fund_id", "dt", "r")
    private = candidate_sector_days(returns, manifest, candidates).select(F.concat_ws("|", "fund_id", "series").alias("series"), "dt", "r")
    daily = peers.sector_composites(returns, manifest).unionByName(private)
    themed = F.col("category") == K.SECTOR_KEYED
    sector_series = F.when(themed & F.col("is_ref"), F.col("sector")).when(themed, F.concat_ws("|", "fund_id", "sector"))
    market_series = F.when(themed & F.col("is_ref"), "*").when(themed, F.concat_ws("|", "fund_id", F.lit("*")))
    named = asked.join(keyed.withColumn("series", sector_series).withColumn("_all", market_series), "fund_id")
    wanted = named.select("anchor", F.explode(F.array_compact(F.array("series", "_all"))).alias("series")).distinct()
    context = feats.composite_features(daily, wanted, days)
    whole = context.select(F.col("series").alias("_all"), "anchor", F.col("mom").alias("_all_mom"))
    rows = (
        named.join(own, ["fund_id", "anchor"]).join(falls, ["fund_id", "anchor"], "left")
        .join(context, ["series", "anchor"], "left").join(whole, ["_all", "anchor"], "left")
    )
    return feats.finish_rows(rows, themed, F.col("_all_mom"), ("is_ref",))


def candidate_percentile(reference: DataFrame, candidates: DataFrame, keys: Sequence[str], value: str, out: str, min_count: int) -> DataFrame:
    """Average-tie percentile of each candidate among the reference rows and itself alone."""
    cols = [*keys, value]
    pool = reference.select(*cols, F.lit(1).alias("_ref")).unionByName(candidates.select(*cols, F.lit(0).alias("_ref")))
    table = cumulative_counts(pool, keys, value, {"ref": F.sum("_ref")})
    pct = F.when(F.col("total_ref") + 1 >= min_count, (F.col("below_ref") + (F.col("ref") + 2) / 2.0) / (F.col("total_ref") + 1))
    return candidates.join(table.select(*cols, pct.alias(out)), cols, "left")


def score_live(requests: DataFrame, manifest: DataFrame, nav: DataFrame, master: DataFrame, overrides: DataFrame, model: DataFrame,
               features: Sequence[str], today: Column, days: int = K.TRADING_DAYS, target: str = "cohort_q1") -> LiveScores:
    """One row per requested fund: status, and for OK the probability and cohort percentile.

    The cohort is named by its id, whose members stand once in the second table; a candidate is not
    among them and is named beside it, so the result grows with the rows, not with the cohorts' squares.
    """
    state = cut_lineage(requests_state(requests, manifest, nav, master, overrides, today))
    open_rows = state.where(F.col("early_status").isNull())
    pairs = cut_lineage(reference_pairs(manifest, nav, open_rows))
    rows = cut_lineage(live_rows(nav, manifest, open_rows.where(~F.col("is_ref")), pairs, days))
    reference, raw = rows.where("is_ref"), rows.where(~F.col("is_ref"))
    stats = feats.cross_section_stats(reference)
    placed = candidate_percentile(*(df.withColumn("_growth", F.round("cagr_3y", feats.RANK_DIGITS)) for df in (reference, raw)),
                                  ["gkey", "anchor"], "_growth", "rank_3y", 3).drop("_growth")
    panel = feats.with_z_scores(feats.with_peer_rank(reference).unionByName(placed), stats)
    scored = cut_lineage(_scores(panel.select("fund_id", "anchor", "gkey", "is_ref", *K.FEATURES), model, features, target))
    own = open_rows.where("is_ref").select("fund_id", "anchor")

    has_year = F.coalesce(F.col("has_1y") == 1.0, F.lit(False))
    sizes_of = scored.where("is_ref").groupBy("gkey", "anchor").agg(
        F.count(F.lit(1)).alias("_present"), F.count_if(has_year).alias("_scoreable"))
    sizes = scored.where("is_ref").groupBy("anchor").agg(F.count(F.lit(1)).alias("_universe"))
    pool = scored.where(F.col("is_ref") & has_year)
    ranks = cumulative_counts(pool, ["gkey", "anchor"], "probability").select(
        "gkey", "anchor", "probability", ((F.col("below") + (F.col("cnt") + 1) / 2.0) / F.col("n")).alias("_pct"))
    ref_rows = scored.where("is_ref").join(own, ["fund_id", "anchor"], "left_semi").join(ranks, ["gkey", "anchor", "probability"], "left")
    new_rows = candidate_percentile(pool, scored.where(~F.col("is_ref")), ["gkey", "anchor"], "probability", "_pct", 1)
    wide = ref_rows.unionByName(new_rows).join(sizes_of, ["gkey", "anchor"], "left").join(sizes, "anchor", "left")

    extra = (~F.col("is_ref")).cast("int")
    present = F.coalesce("_present", F.lit(0)) + extra
    scoreable = F.coalesce("_scoreable", F.lit(0)) + F.when(has_year, extra).otherwise(0)
    late = (
        F.when(present < K.COHORT_MIN_SIZE, "THIN_COHORT").when(~has_year, "INSUFFICIENT_HISTORY")
        .when(scoreable < K.COHORT_MIN_SIZE, "THIN_COHORT").otherwise("OK")
    )
    graded = wide.select(
        "fund_id", "gkey", late.alias("late_status"), F.when(present < K.COHORT_MIN_SIZE, present).when(~has_year, present).otherwise(scoreable).alias("cohort_n"),
        (F.coalesce("_universe", F.lit(0)) + extra).alias("universe_n"), "probability", "_pct", "imputed", "feature_values", "signal_context", "model_id")
    out = state.join(graded, "fund_id", "left")
    status = F.coalesce("early_status", "late_status", F.lit("STALE_NAV"))
    ok = status == "OK"
    measured = status.isin(*K.IMPUTATION_MEASURED)
    members = pool.select("gkey", "anchor", "fund_id")
    ids = cohorts.cohort_ids(members, ["gkey", "anchor"])
    final = out.join(ids, ["gkey", "anchor"], "left")
    rows = final.select(
        "fund_id", status.alias("status"), F.lit(target).alias("target"), "anchor", "staleness_days",
        F.when(late_seen(status), F.col("gkey")).when(status.isin("OUT_OF_TRAINING_UNIVERSE", "SECTOR_UNRESOLVED"), F.col("category")).alias("cohort_key"), F.when(late_seen(status), F.col("cohort_n")).otherwise(0).cast("int").alias("cohort_n"),
        F.when(late_seen(status), F.col("universe_n")).otherwise(0).cast("int").alias("universe_n"),
        F.when(ok, F.col("probability")).alias("probability"), F.when(ok, F.col("_pct")).alias("cohort_percentile"),
        F.when(measured, F.col("imputed")).alias("imputed_features"), F.when(measured, F.lit(len(features))).alias("n_features"),
        F.when(ok, F.col("cohort_id")).alias("cohort_id"), F.when(ok & ~F.col("is_ref"), F.col("fund_id")).alias("cohort_added"),
        F.when(ok, F.col("feature_values")).alias("features"), F.when(ok, F.col("signal_context")).alias("signal_context"),
        F.when(ok, F.col("model_id")).alias("model_id"))
    return LiveScores(rows, members.join(ids, ["gkey", "anchor"]).select("cohort_id", "fund_id").distinct())


def late_seen(status: Column) -> Column:
    return status.isin("OK", "THIN_COHORT", "INSUFFICIENT_HISTORY")


def _scores(rows: DataFrame, model: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    scored = inference.score(rows, model.where(F.col("target") == target), features)
    return scored.select(
        "fund_id", "anchor", "gkey", "is_ref", "has_1y", "probability", "signal_context", "model_id",
        inference.imputed(features).alias("imputed"), inference.feature_map(K.FEATURES).alias("feature_values"))
