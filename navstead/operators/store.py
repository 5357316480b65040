"""The ledger as parquet by anchor month: predictions, cohort members and realizations.

An append reads the keys of the batch's own months and nothing else; grading reads the months that
have matured.  Months are the partitions of all three tables, so both are partition filters.  Members
of a cohort are stored once under the id that they decide, and are written before the predictions
that name them: a batch that fails between the two is repeated without harm.  Compaction rewrites
given months alone, by dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut_lineage
from ..sources.scans import PREDICTION, REALIZATION, exists
from . import cohorts, ledger

MONTH = "anchor_month"
MEMBER = "cohort_id string, fund_id string"
#: The exchanged row with the cohort's id, and the scored fund where it is no member, in place of its list.
STORED = PREDICTION.replace("cohort_codes array<string>", "cohort_id string, cohort_added string")
FILES_A_MONTH = 4


def month_of(anchor: str = "anchor") -> Column:
    return F.coalesce(F.substring(F.col(anchor).cast("string"), 1, 7), F.lit("none"))


class LedgerStore:
    def __init__(self, spark: SparkSession, path: str, schema: str = STORED) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    # --- reading
    def _table(self, name: str, schema: str, months: Sequence[str] | None) -> DataFrame:
        shape = f"{schema}, {MONTH} string"
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(f"{self.path}/{name}")
        return rows if months is None else rows.where(F.col(MONTH).isin(list(months)))

    def predictions(self, months: Sequence[str] | None = None) -> DataFrame:
        return self._table("predictions", self.schema, months)

    def members(self, months: Sequence[str] | None = None) -> DataFrame:
        return self._table("members", MEMBER, months)

    def realizations(self, months: Sequence[str] | None = None) -> DataFrame:
        return self._table("realizations", REALIZATION, months)

    # --- writing
    def _write(self, rows: DataFrame, name: str, mode: str = "append") -> None:
        spread = F.pmod(F.xxhash64("fund_id"), F.lit(FILES_A_MONTH))
        out = rows.repartition(MONTH, spread).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        out.partitionBy(MONTH).parquet(f"{self.path}/{name}")

    def append(self, batch: DataFrame, members: DataFrame | None = None, order: Sequence[str] = ("logged_at",)) -> list[str]:
        """Add what the store does not hold; returns the months that the batch touches.

        A batch with ``cohort_codes`` brings its lists along; else ``members`` holds (cohort_id, fund_id).
        """
        rows = batch.withColumn(MONTH, month_of())
        if "cohort_codes" in batch.columns:
            rows = rows.withColumn("cohort_id", cohorts.id_of_codes("cohort_codes")).withColumn("cohort_added", F.lit(None).cast("string"))
        rows = cut_lineage(rows)
        months = sorted(r[0] for r in rows.select(MONTH).distinct().collect())  # bounded by the calendar
        named = rows.where(F.col("cohort_id").isNotNull()).groupBy(MONTH, "cohort_id")
        if "cohort_codes" in batch.columns:
            brought = named.agg(F.any_value("cohort_codes").alias("codes")).select(MONTH, "cohort_id", F.explode("codes").alias("fund_id"))
        elif members is not None:
            brought = named.agg(F.lit(1).alias("_one")).drop("_one").join(members.select("cohort_id", "fund_id").distinct(), "cohort_id")
        else:
            brought = self.spark.createDataFrame([], f"{MONTH} string, {MEMBER}")
        held = self.members(months).select(MONTH, "cohort_id").distinct()
        self._write(brought.join(held, [MONTH, "cohort_id"], "left_anti").select("cohort_id", "fund_id", MONTH), "members")
        fresh = ledger.new_predictions(rows, self.predictions(months).select(*ledger.KEY), order)
        self._write(fresh.select(*self._known(fresh, self.schema), MONTH), "predictions")
        return months

    def load(self, rows: DataFrame, members: DataFrame | None = None) -> None:
        """Take over exchanged rows as they are, copies and all; ``compact`` follows.

        Rows bring their lists as ``cohort_codes``, or name them by ``cohort_id`` with ``members`` (cohort_id, fund_id) beside them.
        """
        named = rows.withColumn(MONTH, month_of())
        named = cut_lineage(named if members is not None else named.withColumn("cohort_id", cohorts.id_of_codes("cohort_codes")))
        lists = named.where(F.col("cohort_id").isNotNull()).groupBy(MONTH, "cohort_id")
        if members is None:
            brought = lists.agg(F.any_value("cohort_codes").alias("codes")).select("cohort_id", F.explode("codes").alias("fund_id"), MONTH)
        else:
            brought = lists.agg(F.lit(1).alias("_one")).drop("_one").join(members.select("cohort_id", "fund_id").distinct(), "cohort_id").select("cohort_id", "fund_id", MONTH)
        self._write(brought, "members")
        self._write(named.select(*self._known(named, self.schema), MONTH), "predictions")

    def add_realizations(self, rows: DataFrame) -> None:
        self._write(rows.select(*self._known(rows, REALIZATION), month_of().alias(MONTH)), "realizations")

    def _known(self, rows: DataFrame, schema: str) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], schema).schema.fields if f.name in rows.columns]

    def compact(self, months: Sequence[str], order: Sequence[str] = ("logged_at",)) -> None:
        """Rewrite the given months: one row per key, one row per member, few files."""
        self._write(cut_lineage(ledger.dedupe(self.predictions(months), order)), "predictions", "overwrite")
        self._write(cut_lineage(self.members(months).distinct()), "members", "overwrite")

    def grade(self, nav: DataFrame, today: Column, superseded: DataFrame, horizon: int = 12 * K.FORWARD_YEARS) -> DataFrame:
        """Grade what has matured and is not graded yet, and keep the grades; reads matured months alone."""
        due = F.col(MONTH) <= F.date_format(F.add_months(today, -horizon), "yyyy-MM")
        done = self.realizations().where(due)
        open_rows = ledger.pending(self.predictions().where(due), done, superseded)
        matured = ledger.matured(open_rows, today, horizon).where("is_matured").drop("is_matured")
        graded = ledger.realize(matured, nav, self.members().where(due))
        rows = cut_lineage(graded.select("*", F.lit(1).alias("schema_version"), F.date_format(today, "yyyy-MM-dd").alias("realized_at")))
        self.add_realizations(rows)
        return rows
