"""Hand-curated files: validation with per-row issues, sector proposals, gap lists, managers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import blank_to_null, normal, sorted_array, squeeze
from . import universe


def _file_issue(columns: list[str], forbidden: tuple[str, ...], allowed: tuple[str, ...], required: tuple[str, ...]) -> str | None:
    """The reason a whole file is rejected, from its header alone."""
    names = {c.strip().lower() for c in columns}
    if names & set(forbidden):
        return f"forbidden columns {sorted(names & set(forbidden))}"
    if names - set(allowed):
        return f"unknown columns {sorted(names - set(allowed))}"
    if set(required) - names:
        return f"missing columns {sorted(set(required) - names)}"
    return None


def _lowered(raw: DataFrame) -> DataFrame:
    return raw.toDF(*[c.strip().lower() for c in raw.columns])


def _with_missing(raw: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    for c in columns:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return raw


def _reject(raw: DataFrame, reason: str, shape: str) -> tuple[DataFrame, DataFrame]:
    spark = raw.sparkSession
    issue = spark.createDataFrame([(None, "ERROR", reason)], "row_key string, severity string, message string")
    return spark.createDataFrame([], shape), issue


def validate_overrides(raw: DataFrame, trained: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, issues).  A code that appears more than once loses all of its rows."""
    reason = _file_issue(raw.columns, K.OVERRIDE_FORBIDDEN, K.OVERRIDE_COLUMNS, ("amfi_code",))
    if reason:
        return _reject(raw, reason, ", ".join(f"{c} string" for c in K.OVERRIDE_COLUMNS))
    rows = _with_missing(_lowered(raw), K.OVERRIDE_COLUMNS)
    rows = rows.select(*[blank_to_null(F.col(c).cast("string")).alias(c) for c in K.OVERRIDE_COLUMNS])
    copies = rows.groupBy("amfi_code").agg(F.count(F.lit(1)).alias("_copies"))
    known = trained.select("category").distinct().withColumn("_trained", F.lit(True))
    used = sectors.where(F.col("sector").isNotNull()).select("sector").distinct().withColumn("_used", F.lit(True))
    any_sector = used.agg(F.count(F.lit(1)) > 0).scalar()
    checked = rows.join(copies, "amfi_code", "left").join(known, "category", "left").join(used, "sector", "left")
    error = (
        F.when(F.col("amfi_code").isNull(), "blank code").when(F.col("_copies") > 1, "duplicate code")
        .when(F.col("category").isNull() & F.col("sector").isNull(), "neither category nor sector")
        .when(F.col("category").isNotNull() & F.col("_trained").isNull(), "untrained category")
    )
    checked = checked.withColumn("_error", error)
    warn = sorted_array(
        F.when(F.col("sector").isNotNull() & F.col("_used").isNull() & any_sector, F.lit("unknown sector")),
        F.when(F.col("source_url").isNull(), F.lit("no source_url")))
    accepted = checked.where(F.col("_error").isNull())
    issues = (
        checked.where(F.col("_error").isNotNull()).select(F.col("amfi_code").alias("row_key"), F.lit("ERROR").alias("severity"), F.col("_error").alias("message"))
        .unionByName(accepted.select(F.col("amfi_code").alias("row_key"), F.lit("WARN").alias("severity"), F.explode(warn).alias("message")))
    )
    return accepted.select(*K.OVERRIDE_COLUMNS), issues


def validate_managers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with parsed dates, issues).  ``row_no`` is the line in the file."""
    allowed = K.MANAGER_REQUIRED + K.MANAGER_OPTIONAL
    reason = _file_issue([c for c in raw.columns if c != "row_no"], K.MANAGER_FORBIDDEN, allowed, K.MANAGER_REQUIRED)
    if reason:
        return _reject(raw, reason, ", ".join(f"{c} string" for c in allowed))
    rows = _with_missing(_lowered(raw), allowed)
    rows = rows.select(
        F.col("row_no").cast("string").alias("row_no"), blank_to_null("manager_name").alias("manager_name"), blank_to_null("scheme_name").alias("scheme_name"),
        F.try_to_date("start_date", "yyyy-MM-dd").alias("start_date"), F.try_to_date("end_date", "yyyy-MM-dd").alias("end_date"),
        "amfi_code", blank_to_null("source_url").alias("source_url"), "note")
    error = (
        F.when(F.col("manager_name").isNull() | F.col("scheme_name").isNull(), "blank name").when(F.col("start_date").isNull(), "bad start_date")
        .when(F.col("end_date") < F.col("start_date"), "end before start")
    )
    checked = rows.withColumn("_error", error)
    good = checked.where(F.col("_error").isNull())
    key = [F.lower("manager_name"), F.lower("scheme_name"), F.col("start_date")]
    first = good.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(F.col("row_no").cast("bigint")).alias("_first"))
    matched = good.join(first, reduce(lambda a, b: a & b, [k == F.col(f"_k{i}") for i, k in enumerate(key)]))
    warn = sorted_array(
        F.when(F.col("source_url").isNull(), F.lit("no source_url")),
        F.when(F.col("row_no").cast("bigint") > F.col("_first"), F.lit("duplicate")))
    issues = (
        checked.where(F.col("_error").isNotNull()).select(F.col("row_no").alias("row_key"), F.lit("ERROR").alias("severity"), F.col("_error").alias("message"))
        .unionByName(matched.select(F.col("row_no").alias("row_key"), F.lit("WARN").alias("severity"), F.explode(warn).alias("message")))
    )
    return good.drop("_error"), issues


def current_manager(managers: DataFrame) -> DataFrame:
    """Per scheme the row with the latest start; an open end wins a tie, then the later row."""
    order = F.struct(F.col("start_date"), F.col("end_date").isNull().alias("o"), F.col("row_no").cast("bigint").alias("r"))
    return managers.groupBy(normal("scheme_name").alias("scheme_key")).agg(
        F.max_by(F.struct("manager_name", "start_date", "end_date"), order).alias("m")).select("scheme_key", "m.*")


def prior_funds(managers: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (manager_name, exclude_scheme): map of the manager's other schemes to their span."""
    left = asked.select("manager_name", "exclude_scheme").distinct().withColumn("_m", normal("manager_name")).withColumn("_x", normal("exclude_scheme"))
    rows = managers.select(normal("manager_name").alias("_m"), normal("scheme_name").alias("_s"), "scheme_name", "start_date", "end_date",
                           F.col("row_no").cast("bigint").alias("_r"))
    span = F.concat(F.lit("managed "), F.col("start_date").cast("string"), F.lit("–"), F.coalesce(F.col("end_date").cast("string"), F.lit("present")))
    hits = left.join(rows, "_m").where(F.col("_s") != F.col("_x")).withColumn("span", span)
    latest = hits.groupBy("manager_name", "exclude_scheme", "scheme_name").agg(F.max_by("span", "_r").alias("span"))
    return latest.groupBy("manager_name", "exclude_scheme").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("scheme_name", "span")))).alias("prior_funds"))


# --- sector proposals ------------------------------------------------------------------
def strip_plan_tail(name: Column | str) -> Column:
    """Cut the plan and option words, only after the word ``fund``."""
    s = squeeze(name)
    head = F.regexp_extract(s, r"(?i)^(.*?\bfund\b)", 1)
    tail = F.substr(s, F.length(head) + 1)
    cut = F.regexp_replace(tail, r"(?i)\b(direct|regular|growth|idcw|dividend|cumulative|payout|reinvest).*$", "")
    whole = F.regexp_replace(F.concat(head, cut), r"^[\s\-–—,]+|[\s\-–—,]+$", "")
    return F.when(head == "", s).otherwise(whole)


def house_prefixes(manifest: DataFrame) -> DataFrame:
    """Fund-house names as they begin scheme names, from the manifest and a fixed supplement."""
    base = F.trim("amc")
    for suffix in K.HOUSE_SUFFIXES:
        base = F.when(base.endswith(suffix), F.substr(base, F.lit(1), F.length(base) - len(suffix))).otherwise(base)
    own = manifest.where(F.col("amc").isNotNull()).select(F.trim(base).alias("prefix"))
    extra = manifest.sparkSession.createDataFrame([(p,) for p in K.EXTRA_HOUSE_PREFIXES], "prefix string")
    return own.unionByName(extra).where(F.length("prefix") > 0).distinct()


def strip_house(names: DataFrame, prefixes: DataFrame, key: str, name: str) -> DataFrame:
    """``body``: the name without its longest house prefix.

    A prefix must equal the name's leading characters, so names meet prefixes in an equi join on
    (length, leading text) over the distinct prefix lengths.  Each name is there once per length, of which the
    size check knows nothing: the join goes through a shuffle, or the names would go through the driver.
    """
    table = prefixes.select(F.lower(F.trim("prefix")).alias("_lead")).distinct().withColumn("_len", F.length("_lead"))
    lengths = table.select("_len").distinct().agg(F.collect_set("_len")).scalar()
    tried = names.withColumn("_len", F.explode(lengths)).where(F.length(name) >= F.col("_len"))
    tried = tried.withColumn("_lead", F.lower(F.substr(F.col(name), F.lit(1), F.col("_len"))))
    best = tried.select(key, "_len", "_lead").join(universe.by_shuffle(table), ["_len", "_lead"]).groupBy(key).agg(F.max("_len").alias("_cut"))
    joined = names.join(universe.by_shuffle(best), key, "left")
    rest = F.regexp_replace(F.substr(F.col(name), F.col("_cut") + 1), r"^[\s\-–—]+", "")
    return joined.withColumn("body", F.when(F.col("_cut").isNotNull(), rest).otherwise(F.col(name))).drop("_cut")


def _first_match(body: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(label, token) of the first matching rule in list order."""
    out = F.lit(None).cast("struct<label:string,token:string>")
    for pattern, label in reversed(rules):
        out = F.when(body.rlike(pattern), F.struct(F.lit(label).alias("label"), F.regexp_extract(body, f"({pattern})", 1).alias("token"))).otherwise(out)
    return out


def propose_sectors(schemes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(fund_id, sector, matched_on, reason): strategy words veto, then the sector rules in order."""
    named = schemes.withColumn("_name", strip_plan_tail("scheme_name"))
    body = F.lower("body")
    rows = strip_house(named, house_prefixes(manifest), "fund_id", "_name")
    rows = rows.withColumn("_veto", _first_match(body, K.STRATEGY_MARKERS)).withColumn("_hit", _first_match(body, K.SECTOR_RULES))
    known = manifest.where(F.col("sector").isNotNull()).select(F.trim("sector").alias("_sector")).distinct().withColumn("_known", F.lit(True))
    rows = rows.withColumn("_sector", F.when(F.col("_veto").isNull(), F.col("_hit.label"))).join(known, "_sector", "left")
    ok = F.col("_known").isNotNull()
    reason = (
        F.when(F.col("_veto").isNotNull(), F.col("_veto.label")).when(F.col("_hit").isNull(), "no sector keyword in the name")
        .when(~ok, "not an existing sector")
    )
    return rows.select("fund_id", "scheme_name", F.when(ok, F.col("_sector")).alias("sector"),
                       F.when(ok, F.col("_hit.token")).alias("matched_on"), reason.alias("reason"))


# --- gaps ------------------------------------------------------------------------------
def outside_candidates(master: DataFrame, manifest: DataFrame, overrides: DataFrame) -> DataFrame:
    """Scoreable direct-growth schemes missing from the manifest with their curation state."""
    curated = overrides.groupBy(F.col("amfi_code").alias("fund_id")).agg(F.max("sector").alias("_sector"), F.lit(True).alias("_row"))
    rows = universe.candidates(master, manifest).where(~F.col("in_manifest")).join(curated, "fund_id", "left")
    blocked = F.col("category") == K.SECTOR_KEYED
    state = F.when(~blocked, "ready").when(F.col("_sector").isNotNull(), "resolved").when(F.col("_row"), "listed").otherwise("todo")
    return rows.select("fund_id", "scheme_name", "category", state.alias("state"))


def gap_counts(outside: DataFrame) -> DataFrame:
    return outside.agg(
        F.count(F.lit(1)).alias("n_outside"), F.count_if(F.col("state") == "ready").alias("n_ready"),
        F.count_if(F.col("state") != "ready").alias("n_blocked"), F.count_if(F.col("state") == "resolved").alias("n_resolved"),
        F.count_if(F.col("state").isin("listed", "todo")).alias("n_uncurated"), F.count_if(F.col("state") == "todo").alias("n_todo"))


def worklist(outside: DataFrame) -> DataFrame:
    """Blocked schemes without any curated row, in the shape of the override file."""
    blank = F.lit("").alias
    return outside.where(F.col("state") == "todo").select(
        F.col("fund_id").alias("amfi_code"), F.lit(K.SECTOR_KEYED).alias("category"), blank("sector"), blank("source_url"),
        F.col("scheme_name").alias("note"))


def fetch_candidates(outside: DataFrame) -> DataFrame:
    """Codes worth loading: outside the manifest and not blocked on a sector."""
    return outside.where(F.col("state").isin("ready", "resolved")).select("fund_id").dropDuplicates()


def missing_parameters(funds: DataFrame) -> DataFrame:
    """Array of the inputs a fund still lacks; needs category, bucket, benchmark, sector, holdings_available."""
    known = [r[0] for r in K.CATEGORY_RULES]
    tri = F.coalesce(F.col("benchmark"), F.lit("")).contains("TRI")
    missing = sorted_array(
        F.when(~F.col("category").isin(*known), F.concat(F.lit("category_not_in_registry:"), "category")),
        F.when(~F.col("holdings_available"), F.lit("holdings_unavailable")),
        F.when((F.col("bucket") == "Other (Index/ETF/FoF)") & ~tri, F.lit("tri_benchmark_name")),
        F.when(F.col("category").isin("Sectoral", "Thematic") & F.col("declared_sector").isNull(), F.lit("declared_sector_or_theme")),
        F.when(F.col("bucket") == "Debt", F.lit("portfolio_ytm_and_duration_feed")))
    return funds.withColumn("missing", missing)


