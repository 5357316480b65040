"""Incremental use of the same operators: file-source prices and an idempotent ledger sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger
from ..sources import scans

NAV_SCHEMA = "fund_id string, dt date, nav double"


def nav_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Price rows of new files as they land.

    There is no watermark on the price date: a fund that joins late brings its whole history.
    """
    return spark.readStream.schema(NAV_SCHEMA).parquet(folder)


def append_prices(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to the price table, one row per (fund, date); the first to arrive stays.

    The table is partitioned by month and each batch meets the months that it touches alone.  Within a
    batch the lowest price of a date stays, so a replay adds nothing and changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        once = batch.where("fund_id IS NOT NULL AND dt IS NOT NULL").groupBy("fund_id", "dt").agg(F.min("nav").alias("nav"))
        once = once.withColumn("month", F.date_format("dt", "yyyy-MM"))
        if scans.exists(spark, path):
            months = [r.month for r in once.select("month").distinct().collect()]  # bounded by the calendar
            old = spark.read.schema(f"{NAV_SCHEMA}, month string").parquet(path).where(F.col("month").isin(months))
            once = once.join(old, ["fund_id", "dt"], "left_anti")
        once.select("fund_id", "dt", "nav", "month").write.mode("append").partitionBy("month").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_predictions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to the ledger store per micro-batch; a replayed batch adds nothing and reads its own months alone."""

    def write(batch: DataFrame, _: int) -> None:
        ledger.append(batch, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
