"""Writers: panels, ledgers, artifacts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite_fields(c: Column, kind: T.DataType) -> Column:
    """The value with NaN and infinities turned to NULL at any depth; booleans untouched."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, T.StructType):
        fields = F.struct(*[finite_fields(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: finite_fields(v, kind.valueType))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    return df.select(*[finite_fields(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_panel(df: DataFrame, path: str) -> None:
    """Feature or label panel, partitioned by anchor year so live scoring prunes to one year."""
    out = df.withColumn("anchor_year", F.year("anchor"))
    out.write.mode("overwrite").partitionBy("anchor_year").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("target", "model", "block").parquet(path)


def write_artifact(records: DataFrame, path: str) -> None:
    """Nested records as compressed JSON, NULL fields kept."""
    json_safe(records).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def write_document(row: DataFrame, path: str) -> None:
    """A one-row nested document (model, drift reference)."""
    row.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str, members: DataFrame | None = None, members_path: str | None = None) -> None:
    """Prediction rows as JSON lines; rows that name their cohort by id have its ``members`` (cohort_id, fund_id) written beside them."""
    if members is not None:
        members.write.mode("append").json(members_path)
    rows.write.mode("append").json(path)
