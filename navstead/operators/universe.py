"""Registry text: category parsing, universe gate, plan and option, entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import col
from ..functions.text import lookup, normal

TRAINED, OUTSIDE, UNMAPPED = "TRAINED", "OUT_OF_TRAINING_UNIVERSE", "UNMAPPED_CATEGORY"


def parse_category(raw: Column | str) -> Column:
    """Struct (category, asset_class, parsed, is_equity, is_open_ended, reason) of a registry label.

    Shape: ``Family Schemes(Asset - Sub)``; the inner part runs to the last parenthesis and is
    split at the first hyphen that has whitespace on both sides.
    """
    text = F.trim(col(raw))
    shape = r"(?i)^(.*?)\s*Schemes?\s*\((.*)\)\s*$"
    matched = text.rlike(shape)
    family = normal(F.regexp_extract(text, shape, 1))
    inner = F.trim(F.regexp_extract(text, shape, 2))
    parts = F.split(inner, r"\s+-\s+", 2)
    two = F.size(parts) == 2
    asset = F.trim(parts[0])
    sub = normal(F.get(parts, F.lit(1)))
    equity = two & asset.rlike(r"(?i)^equity\s+schemes?$")
    is_open = family == "open ended"
    mapped = lookup(sub, K.SUBCATEGORY_TO_CATEGORY)
    reason = (
        F.when(col(raw).isNull(), "null").when(text == "", "empty").when(~matched, "unreadable").when(~two, "legacy_label")
        .when(~equity, "not_equity").when(~is_open, "close_ended").when(mapped.isNull(), "unmapped_subcategory").otherwise("mapped")
    )
    readable = F.coalesce(matched, F.lit(False))
    return F.struct(
        F.when(reason == "mapped", mapped).alias("category"),
        F.when(readable & two, asset).alias("asset_class"),
        readable.alias("parsed"), (readable & equity).alias("is_equity"), (readable & is_open).alias("is_open_ended"),
        reason.alias("reason"),
    )


def classify(master: DataFrame, manifest: DataFrame) -> DataFrame:
    """Master rows with ``status``, ``category`` and ``reason`` against the manifest's own categories."""
    trained = manifest.where(F.col("category").isNotNull()).select("category").distinct().withColumn("_in", F.lit(True))
    parsed = master.withColumn("_p", parse_category("category_raw")).withColumn("category", F.col("_p.category"))
    joined = parsed.join(trained, "category", "left")
    status = F.when(~F.col("_p.parsed"), UNMAPPED).when(F.col("_in"), TRAINED).otherwise(OUTSIDE)
    reason = F.when(F.col("category").isNotNull() & F.col("_in").isNull(), "category_not_trained").otherwise(F.col("_p.reason"))
    return joined.select(*[c for c in master.columns if c != "category"], "category", status.alias("status"), reason.alias("reason"))


def plan_of(name: Column | str) -> Column:
    c = col(name)
    return F.when(c.rlike(r"(?i)\bdirect\b"), "DIRECT").when(c.rlike(r"(?i)\bregular\b"), "REGULAR").otherwise("UNKNOWN")


def option_of(name: Column | str) -> Column:
    c = col(name)
    payout = r"(?i)\bidcw\b|\bdividend\b|\bpayout\b|\breinvest"
    return F.when(c.rlike(payout), "IDCW").when(c.rlike(r"(?i)\bgrowth\b"), "GROWTH").otherwise("UNKNOWN")


def candidates(master: DataFrame, manifest: DataFrame) -> DataFrame:
    """Direct growth schemes of trained categories, with ``in_manifest``."""
    gated = classify(master, manifest).where(
        (F.col("status") == TRAINED) & (plan_of("scheme_name") == "DIRECT") & (option_of("scheme_name") == "GROWTH"))
    known = manifest.select("fund_id").distinct().withColumn("_known", F.lit(True))
    return gated.join(known, "fund_id", "left").select(
        "fund_id", "scheme_name", "category", F.coalesce("_known", F.lit(False)).alias("in_manifest"))


def gate_report(classified: DataFrame) -> DataFrame:
    """Count and share of each (status, category)."""
    total = classified.agg(F.count(F.lit(1))).scalar()
    return classified.groupBy("status", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def rule_bucket(raw: Column | str) -> Column:
    up = F.upper(col(raw))
    return (
        F.when(up.contains("DEBT SCHEME"), "Debt").when(up.contains("HYBRID SCHEME"), "Hybrid")
        .when(up.contains("EXCHANGE TRADED") | up.contains("INDEX FUND") | up.contains("FUND OF FUNDS"), "Other (Index/ETF/FoF)")
        .otherwise("Equity")
    )


def rule_category(raw: Column | str) -> Column:
    """Category label for the rules: the fragment after the last `` - `` of the first parenthesis."""
    c = col(raw)
    inner = F.coalesce(F.nullif(F.regexp_extract(c, r"\(([^)]+)\)", 1), F.lit("")), c)
    fragment = F.trim(F.element_at(F.split(inner, " - "), -1))
    label = F.coalesce(lookup(F.upper(fragment), K.FRAGMENT_TO_RULE_CATEGORY), fragment)
    return F.when(c.isNull() | (c == ""), "Unknown").otherwise(label)


# --- entity resolution ---------------------------------------------------------------
def _grams(text: Column) -> Column:
    """Distinct substrings of one to three characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    pieces = F.transform(starts, lambda i: F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.substr(text, i, n)))
    return F.array_distinct(F.flatten(pieces))


def by_shuffle(side: DataFrame) -> DataFrame:
    """A join side that grows with the input: it goes through a shuffle and a sort, never whole through the driver.

    The size check sees compressed files and not what an explode adds, and takes such sides for small ones.
    """
    return side.hint("merge")


def _token_hits(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Names that contain every query token.

    A name that contains a token contains every three letters in a row of it.  Each query is
    matched through its rarest such piece in an equi join, so a word that most names share
    never pairs all of them with all queries.
    """
    tokens = F.filter(F.split(F.upper(F.trim("q")), r"\s+"), lambda t: t != "")
    widest = F.transform(tokens, lambda t: F.filter(_grams(t), lambda g: F.length(g) == F.least(F.length(t), F.lit(3))))
    asked = queries.withColumn("_toks", tokens).where(F.size("_toks") > 0)
    pieces = asked.select("query_id", F.explode(F.array_distinct(F.flatten(widest))).alias("_gram"))
    indexed = names.withColumn("_up", F.upper("scheme_name")).withColumn("_gram", F.explode(_grams(F.col("_up"))))
    spread = indexed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    rarest = pieces.join(by_shuffle(spread), "_gram", "left").groupBy("query_id").agg(
        F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), F.col("_gram"))).alias("_gram"))
    hits = asked.join(by_shuffle(rarest), "query_id").join(by_shuffle(indexed), "_gram")
    return hits.where(F.forall("_toks", lambda t: F.contains(F.col("_up"), t))).drop("_gram", "_toks", "_up")


def resolve_curated(queries: DataFrame, manifest: DataFrame) -> DataFrame:
    """(query_id, q) to one manifest fund: code, then exact name, then all tokens; several names refuse."""
    names = manifest.select("fund_id", "scheme_name")
    q = queries.select("query_id", "q")
    listed = by_shuffle(names)
    by_code = q.join(by_shuffle(names.select("fund_id")), F.trim("q") == F.col("fund_id")).select("query_id", "fund_id", F.lit(1).alias("tier"))
    by_name = q.join(listed, F.upper(F.trim("q")) == F.upper("scheme_name")).select("query_id", "fund_id", F.lit(2).alias("tier"))
    by_tokens = _token_hits(q, names).select("query_id", "fund_id", F.lit(3).alias("tier"))
    counted = by_code.unionByName(by_name).unionByName(by_tokens).groupBy("query_id", "tier").agg(
        F.min("fund_id").alias("fund_id"), F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("query_id").agg(F.min_by(F.struct("tier", "fund_id", "n"), "tier").alias("b"))
    joined = q.join(by_shuffle(best), "query_id", "left")
    status = F.when(F.col("b").isNull(), "NOT_FOUND").when((F.col("b.tier") == 3) & (F.col("b.n") > 1), "AMBIGUOUS").otherwise("RESOLVED")
    return joined.select("query_id", status.alias("status"), F.when(status == "RESOLVED", F.col("b.fund_id")).alias("fund_id"),
                         F.col("b.tier").alias("tier"))


def resolve_market(queries: DataFrame, master: DataFrame) -> DataFrame:
    """(query_id, q) to one scheme of the whole market, best plan first, then the tightest name."""
    names = master.select("fund_id", "isin", "scheme_name", "line_no")
    q = queries.select("query_id", "q")
    up = F.upper(F.trim("q"))
    listed = by_shuffle(names)
    tiers = [
        q.join(listed, up == F.col("fund_id")), q.join(listed, up == F.upper("isin")), q.join(listed, up == F.upper("scheme_name")),
        _token_hits(q, names),
    ]
    hits = None
    for tier, df in enumerate(tiers, 1):
        part = df.select("query_id", "fund_id", "scheme_name", "line_no", F.lit(tier).alias("tier"))
        hits = part if hits is None else hits.unionByName(part)
    n = F.upper("scheme_name")
    score = (
        F.when(n.contains("DIRECT"), 2).otherwise(0) + F.when(n.contains("GROWTH"), 2).otherwise(0)
        - F.when(n.contains("IDCW") | n.contains("DIVIDEND"), 3).otherwise(0)
    )
    order = F.struct(F.col("tier"), (-score).alias("s"), F.length("scheme_name").alias("l"), F.col("line_no"))
    best = hits.groupBy("query_id").agg(F.min_by(F.struct("fund_id", "scheme_name", "tier"), order).alias("b"))
    return q.join(by_shuffle(best), "query_id", "left").select("query_id", "b.fund_id", "b.scheme_name", "b.tier")


def dossiers(resolved: DataFrame, manifest: DataFrame, nav: DataFrame, snapshots: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per resolved fund: category, benchmark, price span, snapshots; no prices is an error row."""
    from .peers import benchmark_name

    prices = nav.groupBy("fund_id").agg(F.count(F.lit(1)).alias("n_obs"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    marks = snapshots.groupBy("fund_id").agg(*[
        F.max(F.when(F.col("label") == k, F.col("as_of"))).alias(c) for k, c in (("t-5y", "as_of_5y"), ("t-3y", "as_of_3y"), ("current", "as_of_now"))])
    out = resolved.join(manifest, "fund_id").join(prices, "fund_id", "left").join(marks, "fund_id", "left")
    if names is not None:
        out = out.join(names.select("fund_id", F.col("name").alias("benchmark")), "fund_id", "left")
    else:
        by_sector = F.when(F.col("sector").isNotNull(), lookup("sector", K.SECTOR_BENCHMARKS))
        out = out.withColumn("benchmark", F.coalesce(by_sector, benchmark_name("category", "sector")))
    category = F.when(F.col("category") == K.SECTOR_KEYED, "Thematic").otherwise(F.col("category"))
    return out.select(
        "fund_id", "scheme_name", "amc", category.alias("category"), F.col("sector").alias("declared_sector"), "benchmark",
        "n_obs", "first_dt", "last_dt", "as_of_5y", "as_of_3y", "as_of_now", F.col("as_of_now").isNotNull().alias("holdings_available"),
        F.lit(None).cast("double").alias("expense_ratio"), F.lit(None).cast("double").alias("aum_cr"),
        F.when(F.col("n_obs").isNull(), "no_price_history").alias("error"))


