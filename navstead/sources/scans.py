"""Landed files to long tables: one scan function per feed, no schema inference on data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.carry import carry_forward
from ..functions.numeric import finite
from ..functions.text import blank_to_null

# --- Fixed values: shapes of the landed feeds ----------------------------------------
NAV_JSON = (
    "meta struct<fund_house:string,scheme_type:string,scheme_category:string,scheme_code:string,scheme_name:string,"
    "isin_growth:string,isin_div_reinvestment:string>, data array<struct<date:string,nav:string>>"
)
RECORD = r"^(\d{4,8});([^;]*);([^;]*);([^;]+);([0-9.]+|N\.A\.);([^;]+?)\s*$"
CATEGORY_HEADER = r"(?i)^.*Schemes?\s*\(.*\)\s*$"
MANIFEST = "amfi_code string, scheme_name string, amc string, category string, sector string, first_nav_date date, last_nav_date date, n_obs int"
AVAILABILITY = (
    "benchmark_name string, matched_sector_or_segment string, source string, return_type string, earliest_date date, "
    "latest_date date, n_obs int, covers_2013 string, notes string"
)
PREDICTION = (
    "schema_version int, run_id string, logged_at string, pipeline_sha string, model_id string, target string, fund_id string, "
    "anchor string, probability double, cohort_percentile double, cohort_key string, cohort_n int, universe_n int, "
    "cohort_codes array<string>, signal_context struct<holdout_auc:double,base_rate:double>, imputed_features array<string>, "
    "features map<string,double>, row_hash string"
)
REALIZATION = (
    "schema_version int, fund_id string, target string, anchor string, model_id string, realized_at string, status string, "
    "y_realized boolean, own_r_fwd double, n_peer_r_fwd int, probability double, cohort_percentile double"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can list the path, on whatever file system it lives."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException:
        return False


def nav_history(spark: SparkSession, path: str) -> DataFrame:
    """(fund_id, dt, nav, scheme_name, is_payout_plan) from one JSON document per scheme."""
    docs = spark.read.schema(NAV_JSON).option("multiLine", True).json(path)
    code = F.coalesce("meta.scheme_code", F.regexp_extract("_metadata.file_name", r"(\d+)", 1))
    return nav_rows_from_documents(docs.withColumn("meta", F.col("meta").withField("scheme_code", code)))


def nav_rows_from_documents(docs: DataFrame) -> DataFrame:
    """Price rows of parsed documents; unreadable dates and values, and values up to zero, drop."""
    name = F.upper(F.coalesce("meta.scheme_name", F.lit("")))
    rows = docs.select(
        F.col("meta.scheme_code").alias("fund_id"), F.col("meta.scheme_name").alias("scheme_name"),
        (name.contains("IDCW") | name.contains("DIVIDEND")).alias("is_payout_plan"), F.explode("data").alias("d"))
    return rows.select(
        "fund_id", F.try_to_date("d.date", "dd-MM-yyyy").alias("dt"), finite(F.expr("try_cast(d.nav AS double)")).alias("nav"),
        "scheme_name", "is_payout_plan").where(F.col("dt").isNotNull() & (F.col("nav") > 0))


def registry_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place: (source, segment, line_no, text).

    Files may be split over tasks.  The split offset orders the segments of a file and the row
    id orders lines inside a segment.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("segment"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))


def scheme_master(lines: DataFrame) -> DataFrame:
    """Registry text to records; category header and fund-house banner carry forward."""
    text = F.trim("text")
    rows = lines.withColumn("text", text).where((text != "") & ~text.startswith("Scheme Code"))
    record = F.col("text").rlike(RECORD)
    header = ~record & F.col("text").rlike(CATEGORY_HEADER)
    banner = ~record & ~header & ~F.col("text").contains(";")
    marked = rows.withColumn("category_raw", F.when(header, F.col("text"))).withColumn("amc", F.when(banner, F.col("text")))
    carried = carry_forward(marked, ["source"], "segment", "line_no", ["category_raw", "amc"])
    part = [F.regexp_extract("text", RECORD, i) for i in range(1, 7)]
    return carried.where(F.col("text").rlike(RECORD) & (part[4] != "N.A.")).select(
        "source", "segment", "line_no", part[0].alias("fund_id"), blank_to_null(part[1]).alias("isin"), F.trim(part[3]).alias("scheme_name"),
        "category_raw", "amc", F.expr(f"try_cast(regexp_extract(text, r'{RECORD}', 5) AS double)").alias("nav"), F.trim(part[5]).alias("date"))


def nav_from_registry(lines: DataFrame) -> DataFrame:
    """(fund_id, dt, nav) of the same text; only ``dd-MMM-yyyy`` dates count."""
    text = F.trim("text")
    strict = text.rlike(RECORD) & F.regexp_extract(text, RECORD, 6).rlike(r"^\d{2}-[A-Za-z]{3}-\d{4}$")
    rows = lines.where(strict & (F.regexp_extract(text, RECORD, 5) != "N.A."))
    return rows.select(
        F.regexp_extract(text, RECORD, 1).alias("fund_id"), F.try_to_date(F.initcap(F.regexp_extract(text, RECORD, 6)), "dd-MMM-yyyy").alias("dt"),
        F.regexp_extract(text, RECORD, 5).cast("double").alias("nav"))


def universe_index(master: DataFrame) -> DataFrame:
    return master.select("fund_id", "category_raw")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(path).withColumnRenamed("amfi_code", "fund_id")


def benchmark_availability(spark: SparkSession, path: str) -> DataFrame:
    """The availability sheet; an absent sheet is an empty one."""
    if not exists(spark, path):
        return spark.createDataFrame([], AVAILABILITY)
    return spark.read.schema(AVAILABILITY).option("header", True).csv(path)


def benchmark_meta(sheet: DataFrame) -> DataFrame:
    return sheet.select(F.col("benchmark_name").alias("name"), "source", "return_type")


def benchmark_series(spark: SparkSession, folder: str, meta: DataFrame) -> DataFrame:
    """(name, dt, level) of every named index that has a series; files, or ``slug=`` folders, carry the slug."""
    raw = spark.read.option("mergeSchema", True).parquet(folder)
    level = F.coalesce(*[F.col(c).cast("double") for c in ("close", "nav") if c in raw.columns])
    named = F.regexp_replace(F.regexp_replace("_metadata.file_name", r"%20", "_"), r"\.parquet$", "")
    slug = F.col("slug") if "slug" in raw.columns else named
    rows = raw.select(slug.alias("_slug"), F.col("date").cast("date").alias("dt"), finite(level).alias("level"))
    usable = meta.where(F.col("source") != "NONE").withColumn("_slug", F.replace(F.lower("name"), F.lit(" "), F.lit("_")))
    return rows.join(usable, "_slug").where(F.col("level").isNotNull()).select("name", "dt", "level")


DISCLOSURE_COLUMNS = 64  # fields of a line that are looked at


# A line that needs the parser: an escape or control character, or a quote that is not the first or last character of a field without commas and quotes.
_HARD_LINE = r'[\\\x00-\x1f]|(?:^|,)(?:[^",]+"|"[^",]*(?:,|$)|"[^",]*"[^,])'


def _fields(rows: DataFrame, line: Column, out: str) -> DataFrame:
    """The rows with the fields of one line of CSV as an array, quotes honoured.

    Lines whose quotes only enclose whole fields are cut at their commas; the others are parsed, which costs several times as much.
    The parsed line passes a generator: the optimizer pulls fields into the parser, and each would parse the line again.
    """
    names = [f"c{i}" for i in range(DISCLOSURE_COLUMNS)]
    hard = line.rlike(_HARD_LINE) | (line == "")
    parsed = rows.select("*", F.explode(F.array(F.when(hard, F.from_csv(line, ", ".join(f"{n} string" for n in names))))).alias("_csv"))
    cut = F.transform(F.slice(F.split(F.replace(line, F.lit('"'), F.lit("")), ","), 1, DISCLOSURE_COLUMNS), lambda f: F.when(f != "", f))
    return parsed.withColumn(out, F.when(F.col("_csv").isNull(), cut).otherwise(F.array(*[F.col("_csv")[n] for n in names]))).drop("_csv")


def disclosures(spark: SparkSession, path: str) -> DataFrame:
    """Portfolio lines of files (or folders of parts) named ``<code>_<yyyy-MM>.csv``; see ``disclosure_rows``."""
    return disclosure_rows(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")))


def bundled_disclosures(spark: SparkSession, path: str) -> DataFrame:
    """Portfolio lines of the same files landed many to a bundle: parquet with a row (file, body) for each.

    A folder of one file per fund and month costs a listing, an open and a commit each, which at thousands
    of funds takes longer than reading them.
    """
    return disclosure_rows(spark.read.schema("file string, body string").parquet(path))


def disclosure_rows(files: DataFrame) -> DataFrame:
    """Portfolio lines of whole files (file, body), each read under its own header.

    Accepted headers differ in name, order and case.  A file without a name or a weight column gives
    no rows, and the others are not touched by it.  A file holds one fund's month, so it is one row
    until its lines are dealt out; a quoted field may not hold a line break.
    """
    whole = files.select(F.col("file").alias("_file"), F.split("body", r"\r?\n").alias("_lines"))
    file = r"(\d+)_(\d{4}-\d{2})\.csv(?:/[^/]*)?$"
    named_files = _fields(whole.where(F.col("_file").rlike(file)), F.get("_lines", F.lit(0)), "_first")
    heads = named_files.select(
        "_file", F.transform("_first", lambda c: F.lower(F.trim(F.regexp_replace(c, "^\ufeff", "")))).alias("_head"), F.slice("_lines", F.lit(2), F.size("_lines")).alias("_lines"))

    def place(*names: str) -> Column:
        return (F.coalesce(*[F.nullif(F.array_position("_head", n), F.lit(0)) for n in names]) - 1).cast("int")

    # what a header says is worked out once a file, not once a line
    where = {"instrument": ("instrument", "name", "symbol"), "weight": ("weight",), "kind": ("asset_type", "type"), "sector": ("sector",), "cap_band": ("cap_band", "cap band", "capband")}
    known = F.arrays_overlap("_head", F.array(F.lit("asset_type"), F.lit("type")))
    named = F.arrays_overlap("_head", F.array(F.lit("instrument"), F.lit("name"), F.lit("symbol")))
    files_read = heads.where(named).select(
        F.regexp_extract("_file", file, 1).alias("fund_id"), F.to_date(F.concat(F.regexp_extract("_file", file, 2), F.lit("-01"))).alias("as_of"),
        known.alias("_known"), *[place(*names).alias(f"_at_{c}") for c, names in where.items()], "_lines")
    dealt = files_read.select("*", F.explode("_lines").alias("_line")).drop("_lines").where(F.trim("_line") != "")
    lines = _fields(dealt, F.col("_line"), "_row").drop("_line")

    def field(name: str) -> Column:
        return F.get("_row", F.col(f"_at_{name}"))

    kind = F.when(F.col("_known"), F.lower(F.trim(field("kind")))).otherwise("equity")
    out = lines.select(
        "fund_id", "as_of", F.trim(field("instrument")).alias("instrument"), finite(field("weight").try_cast("double")).alias("weight"),
        kind.alias("asset_type"), F.trim(field("sector")).alias("sector"), F.lower(F.trim(field("cap_band"))).alias("cap_band"))
    return out.where(F.col("weight").isNotNull())


def cap_list(raw: DataFrame) -> DataFrame:
    """Official cap list: NSE symbol else BSE symbol, a band word, and a usable company name."""

    def symbol(c: str) -> Column:
        t = F.trim(F.col(f"`{c}`").cast("string"))
        return F.when(~F.lower(t).isin("", "-", "nan", "none"), t)

    band_column = next(c for c in raw.columns if "categor" in c.lower())
    band = F.lower(F.regexp_extract(F.col(f"`{band_column}`").cast("string"), r"(?i)(large|mid|small)", 1))
    company = F.trim(F.col("`Company name`").cast("string"))
    out = raw.select(F.coalesce(symbol("NSE Symbol"), symbol("BSE Symbol")).alias("symbol"), company.alias("company"),
                     F.when(band != "", F.concat(F.initcap(band), F.lit(" Cap"))).alias("cap_band"))
    return out.where(~F.lower("company").isin("", "nan", "none") & F.col("cap_band").isNotNull())


def cap_lookup(raw: DataFrame, order: Column | None = None) -> DataFrame:
    """(lookup_key, cap_band): upper-cased symbol and company, the later row wins."""
    have = {c.lower().strip(): c for c in raw.columns if not c.startswith("_")}

    def first(*words: str) -> str | None:
        return next((have[c] for c in have if any(w in c for w in words)), None)

    band_col = first("cap", "categor", "class")
    empty = raw.sparkSession.createDataFrame([], "lookup_key string, cap_band string")
    if band_col is None:
        return empty
    band = F.nullif(F.regexp_extract(F.lower(F.col(f"`{band_col}`").cast("string")), r"(large|mid|small)", 1), F.lit(""))
    place = order if order is not None else F.monotonically_increasing_id()
    keys = []
    for which, bad in ((first("symbol", "ticker"), ("nan", "none", "")), (first("company", "name"), ("",))):
        if which:
            t = F.trim(F.col(f"`{which}`").cast("string"))
            keys.append(F.when(~F.lower(t).isin(*bad), F.upper(t)))
    rows = raw.select(band.alias("cap_band"), place.alias("_place"), F.posexplode(F.array(*keys)).alias("_i", "lookup_key"))
    rows = rows.where(F.col("cap_band").isNotNull() & F.col("lookup_key").isNotNull())
    return rows.groupBy("lookup_key").agg(F.max_by("cap_band", F.struct("_place", "_i")).alias("cap_band"))


def stock_prices(wide: DataFrame, date: str = "date") -> DataFrame:
    """Wide date x ticker table to (instrument, dt, px) rows without the gaps."""
    tickers = [c for c in wide.columns if c != date]
    long = wide.select(F.col(date).cast("date").alias("dt"), *[F.col(f"`{t}`").cast("double").alias(t) for t in tickers]).unpivot(
        ["dt"], tickers, "instrument", "px")
    return long.where(finite("px").isNotNull()).select("instrument", "dt", "px")


def curated_file(spark: SparkSession, path: str) -> DataFrame | None:
    """A hand-edited CSV as strings with ``row_no``; None when it does not exist."""
    if not exists(spark, path):
        return None
    raw = spark.read.option("header", True).csv(path)
    # a sheet that people edit: its rows are few, and their order in the file decides between them
    order = Window.orderBy("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())
    return raw.withColumn("row_no", F.row_number().over(order).cast("bigint") + 1)


def ledger(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame:
    """JSON lines; a line that does not parse is skipped wherever it stands."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json("value", f"{schema}, _corrupt string", options)
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parsed.alias("r"))
    return rows.where(F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")


def cohort_members(spark: SparkSession, path: str) -> DataFrame:
    """(cohort_id, fund_id) of a ledger that names cohorts by id; a file appended to may repeat them."""
    return ledger(spark, path, "cohort_id string, fund_id string").distinct()


def superseded_models(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, superseded_by, reason); an absent or malformed file retires nothing."""
    none = spark.createDataFrame([], "model_id string, superseded_by string, reason string")
    if not exists(spark, path):
        return none
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("model_id", "body"))
    return parsed.select("model_id", F.get_json_object("body", "$.superseded_by").alias("superseded_by"),
                         F.get_json_object("body", "$.reason").alias("reason"))


def model_artifact(spark: SparkSession, path: str, targets: tuple[str, ...] = ("cohort_q1", "cohort_top_half")) -> DataFrame:
    """One row per target: maps of coefficients, medians, means and deviations, and the calibration."""
    numbers = "map<string,double>"
    model = (
        f"struct<base_rate:double,signal_context:struct<holdout_auc:double,base_rate:double>,imputation_medians:{numbers},"
        f"standardize_mean:{numbers},standardize_std:{numbers},coefficients:{numbers},intercept:double,"
        "calibration:struct<kind:string,x:array<double>,y:array<double>,support:array<bigint>,coef:double,intercept:double>>"
    )
    body = ",".join(f"{t}:{model}" for t in targets)
    doc = spark.read.schema(f"version string, features array<string>, models struct<{body}>").option("multiLine", True).json(path)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"models.{t}").alias("m")) for t in targets])).alias("r")
    return doc.select("version", "features", rows).select(
        F.col("version").alias("model_id"), "features", "r.target", "r.m.*").where(F.col("coefficients").isNotNull())


def psi_reference(spark: SparkSession, path: str, features: tuple[str, ...] = K.DRIFT_FEATURES) -> DataFrame:
    """(model_id, feature, edges, bin_props, missing_rate); the outer edges are infinite."""
    body = ",".join(f"{f}:struct<edges:array<double>,bin_props:array<double>,missing_rate:double>" for f in features)
    doc = spark.read.schema(f"model_id string, features struct<{body}>").option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"features.{f}").alias("r")) for f in features])).alias("f")
    return doc.select("model_id", rows).select("model_id", "f.feature", "f.r.*").where(F.col("edges").isNotNull())


def training_table(spark: SparkSession, feature_path: str, label_path: str, start: str = K.MODEL_START, cohort_only: bool = False) -> DataFrame:
    return join_training(spark.read.parquet(feature_path), spark.read.parquet(label_path), start, cohort_only)


def join_training(features: DataFrame, labels: DataFrame, start: str = K.MODEL_START, cohort_only: bool = False) -> DataFrame:
    """Labels joined with features from the first modelling anchor on."""
    repeated = [c for c in features.columns if c in labels.columns and c not in ("fund_id", "anchor")]
    rows = labels.where(F.col("anchor") >= F.lit(start).cast("date")).join(features.drop(*repeated), ["fund_id", "anchor"])
    return rows.where(F.col("y_cohort_q1").isNotNull()) if cohort_only else rows
