"""Purged validation folds as predicates on the anchor date; no row masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

Blocks = Sequence[tuple[str, str, str]]


def _date(v: Column | str) -> Column:
    return F.lit(v).cast("date") if isinstance(v, str) else v


def survives(anchor: Column, start: Column | str, end: Column | str, horizon: int = 36, embargo: int = K.EMBARGO_MONTHS) -> Column:
    """A training anchor whose label window does not touch [start, end] plus horizon and embargo."""
    closed = F.add_months(anchor, horizon) < _date(start)
    after = anchor > F.add_months(F.add_months(_date(end), horizon), embargo)
    return closed | after


def block_of(anchor: Column, blocks: Blocks = K.FOLD_BLOCKS) -> Column:
    out = F.lit(None).cast("string")
    for name, start, end in reversed(blocks):
        out = F.when(anchor.between(_date(start), _date(end)), name).otherwise(out)
    return out


def fold_roles(rows: DataFrame, blocks: Blocks = K.FOLD_BLOCKS, model_start: str = K.MODEL_START, horizon: int = 36) -> DataFrame:
    """Every (row, block) in which the row is used, with ``role`` train or test."""
    a = F.col("anchor")
    entries = []
    for name, start, end in blocks:
        test = a.between(_date(start), _date(end))
        role = F.when(test, "test").when(survives(a, start, end, horizon), "train")
        entries.append(F.struct(F.lit(name).alias("block"), role.alias("role")))
    used = rows.where(a >= _date(model_start)).select(*rows.columns, F.explode(F.array(*entries)).alias("_f"))
    return used.select(*rows.columns, "_f.block", "_f.role").where(F.col("role").isNotNull())


def train_where(block: tuple[str, str, str], model_start: str, horizon: int = 36) -> Column:
    a = F.col("anchor")
    _, start, end = block
    return (a >= _date(model_start)) & ~a.between(_date(start), _date(end)) & survives(a, start, end, horizon)


def test_where(block: tuple[str, str, str], model_start: str) -> Column:
    a = F.col("anchor")
    return (a >= _date(model_start)) & a.between(_date(block[1]), _date(block[2]))


def holdout_roles(rows: DataFrame, train_end: str = K.HOLDOUT_TRAIN_END, test: tuple[str, str] = K.HOLDOUT_TEST,
                  model_start: str = K.MODEL_START, horizon: int = 36) -> DataFrame:
    a = F.col("anchor")
    role = F.when(a.between(_date(test[0]), _date(test[1])), "test").when(
        (a <= _date(train_end)) & survives(a, test[0], test[1], horizon), "train")
    return rows.where(a >= _date(model_start)).withColumn("role", role).where(F.col("role").isNotNull())


def validation_roles(train: DataFrame, block: tuple[str, str, str], horizon: int = 36) -> DataFrame:
    """Training rows split again: one block validates, the rest is purged against it."""
    a = F.col("anchor")
    role = F.when(a.between(_date(block[1]), _date(block[2])), "val").when(survives(a, block[1], block[2], horizon), "train")
    return train.withColumn("val_role", role).where(F.col("val_role").isNotNull())


def calibration_cut(train: DataFrame, keys: Sequence[str] = (), share: float = K.CALIBRATION_SHARE) -> DataFrame:
    """First calibration anchor per group: the last ``share`` of the distinct anchors.

    The list of distinct anchors is a calendar of month-ends, whatever the number of rows.
    """
    groups = list(keys)
    months = train.select(*groups, "anchor").distinct().groupBy(*groups).agg(F.array_sort(F.collect_list("anchor")).alias("_a"))
    n = F.size("_a")
    position = F.ceil(n * F.lit(1 - share)).cast("int")
    cut = F.when(n > 4, F.get("_a", position)).otherwise(F.element_at("_a", -1))
    return months.select(*groups, cut.alias("calib_from"))


def calibration_roles(train: DataFrame, keys: Sequence[str], share: float = K.CALIBRATION_SHARE) -> DataFrame:
    cut = calibration_cut(train, keys, share)
    role = F.when(F.col("anchor") >= F.col("calib_from"), "calib").otherwise("fit")
    return train.join(cut, list(keys)).withColumn("fit_role", role).drop("calib_from")
