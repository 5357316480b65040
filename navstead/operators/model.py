"""Fitting: train-only preprocessing, elastic-net and boosted trees, calibration, fold runs.

Fits run in Spark ML.  Only small results reach the driver: one row of statistics per feature,
the coefficients, and the calibration blocks.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import random
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import finite, logit
from ..functions.ranking import group_quantiles
from ..session import cut_lineage
from ..sources import stamps
from . import batchfit, cv, evaluation
from .inference import interpolate, sigmoid
from .isotonic import isotonic_blocks


# --- preprocessing ---------------------------------------------------------------------
def feature_stats(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Median, then mean and deviation of the imputed values, per feature (and fold).

    Medians come from value cells over (feature, value), so no task holds a whole column.
    """
    keys = list(keys)
    long = rows.select(*keys, *[finite(f).alias(f) for f in features]).unpivot(keys, list(features), "feature", "value")
    sums = long.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("have"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"),
        F.countDistinct("value").alias("n_distinct"))
    medians = group_quantiles(long, [*keys, "feature"], "value", {"median": 0.5}).drop("n")
    joined = sums.join(medians, [*keys, "feature"], "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    gaps = F.col("n") - F.col("have")
    total = F.coalesce("s", F.lit(0.0)) + gaps * F.col("median")
    squares = F.coalesce("ss", F.lit(0.0)) + gaps * F.col("median") * F.col("median")
    var = (squares - total * total / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1)
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    return joined.select(*keys, "feature", "median", (total / F.col("n")).alias("mean"),
                         F.when(sd > 1e-9, sd).otherwise(1.0).alias("std"), "n_distinct")


@dataclass
class Preprocessor:
    features: list[str]
    stats: dict[str, tuple[float, float, float]]

    @staticmethod
    def fit(rows: DataFrame, features: Sequence[str]) -> Preprocessor:
        got = feature_stats(rows, features).select("feature", "median", "mean", "std").collect()
        return Preprocessor(list(features), {r["feature"]: (r["median"], r["mean"], r["std"]) for r in got})

    def columns(self, scaled: bool = True) -> list[Column]:
        out = []
        for f in self.features:
            median, mean, std = self.stats[f]
            filled = F.coalesce(finite(f), F.lit(median))
            out.append(((filled - mean) / std if scaled else filled).alias(f"_z_{f}"))
        return out

    def vectors(self, rows: DataFrame, keep: Sequence[str], scaled: bool = True) -> DataFrame:
        wide = rows.select(*keep, *self.columns(scaled))
        assembler = VectorAssembler(inputCols=[f"_z_{f}" for f in self.features], outputCol="x")
        return assembler.transform(wide).select(*keep, "x")


def class_weighted(rows: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """Rows with the balanced class weight n / (2 · n_class), and the two counts."""
    n, pos = rows.agg(F.count(F.lit(1)), F.count_if(label)).first()
    neg = n - pos
    weight = F.when(F.col(label), n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(neg, 1)))
    return rows.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double")), pos, neg


def fit_elastic_net(vectors: DataFrame, label: str, C: float, l1_ratio: float, weight: str | None = None):
    """Balanced logistic regression; the penalty 1/(C·n) matches a summed loss with strength C."""
    rows, pos, neg = class_weighted(vectors, label)
    if weight:
        rows = rows.withColumn("_w", F.col("_w") * F.col(weight))
    total = rows.agg(F.sum("_w")).first()[0]
    return LogisticRegression(
        featuresCol="x", labelCol="_y", weightCol="_w", elasticNetParam=l1_ratio, regParam=1.0 / (C * total), standardization=False,
        maxIter=300, tol=1e-6).fit(rows)


def fit_boosted_trees(vectors: DataFrame, label: str, step: float, max_leaves: int, iterations: int, min_leaf: int):
    rows, _, _ = class_weighted(vectors, label)
    depth = max(1, math.ceil(math.log2(max_leaves)))
    return GBTClassifier(featuresCol="x", labelCol="_y", weightCol="_w", stepSize=step, maxDepth=depth, maxIter=iterations,
                         minInstancesPerNode=min_leaf, seed=0).fit(rows)


def positive_share(model, vectors: DataFrame, out: str) -> DataFrame:
    scored = model.transform(vectors)
    extra = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*extra)


# --- calibration -----------------------------------------------------------------------
@dataclass
class Calibration:
    kind: str
    x: list[float] = field(default_factory=list)
    y: list[float] = field(default_factory=list)
    support: list[int] = field(default_factory=list)
    coef: float | None = None
    intercept: float | None = None

    def apply(self, p: Column) -> Column:
        if self.kind == "isotonic":
            return interpolate(p, F.array(*[F.lit(v) for v in self.x]), F.array(*[F.lit(v) for v in self.y]))
        return sigmoid(F.lit(self.coef) * logit(p) + F.lit(self.intercept))


class Block(NamedTuple):
    """Rows of one calibrated value: the highest score among them, their number, and the positives."""

    upper: float
    rows: int
    positives: int

    def joined(self, other: Block) -> Block:
        return Block(max(self.upper, other.upper), self.rows + other.rows, self.positives + other.positives)


def end_rate(rows: int, inner: float) -> float:
    """Rate of an end block in which nothing happened: three in its rows, at most a half, and below the inner block."""
    most = min(0.5, 3.0 / rows) if rows else 0.5
    return min(most, inner / 2) if inner > 0 else most


def merge_thin_blocks(blocks: Iterable[tuple[float, int, int]], least: int = K.CALIBRATION_MIN_BLOCK) -> list[tuple[float, float, int]]:
    """(upper score, rate, rows) of blocks with at least ``least`` rows each.

    While the thinnest block has fewer, it goes to whichever neighbour has fewer rows, the lower one if
    both have as many.  Blocks are the knots of the stored model; a heap keeps the thinnest at hand.
    """
    table: list[Block | None] = [Block(*b) for b in blocks]
    below, above = list(range(-1, len(table) - 1)), list(range(1, len(table) + 1))
    thinnest, left = [(b.rows, i) for i, b in enumerate(table)], len(table)
    heapq.heapify(thinnest)
    while left > 1 and thinnest[0][0] < least:
        rows, i = heapq.heappop(thinnest)
        if table[i] is None or table[i].rows != rows:
            continue  # merged meanwhile
        mate = min((j for j in (below[i], above[i]) if 0 <= j < len(table)), key=lambda j: table[j].rows)
        low, high = min(i, mate), max(i, mate)
        table[low], table[high], above[low], left = table[low].joined(table[high]), None, above[high], left - 1
        if above[high] < len(table):
            below[above[high]] = low
        heapq.heappush(thinnest, (table[low].rows, low))
    table = [b for b in table if b is not None]
    rate = [b.positives / b.rows for b in table]
    if len(table) > 1:
        if not table[0].positives:
            rate[0] = end_rate(table[0].rows, rate[1])
        if table[-1].positives == table[-1].rows:  # the same of what did not happen
            rate[-1] = 1.0 - end_rate(table[-1].rows, 1.0 - rate[-2])
    highest = itertools.accumulate((b.upper for b in table), max, initial=float("-inf"))
    return [(b.upper, r, b.rows) for b, r, before in zip(table, rate, highest) if b.upper > before]


def fit_calibration(scored: DataFrame, p: str, label: str) -> Calibration:
    """Isotonic with thin blocks merged when the slice is large enough, else logistic on log-odds."""
    n, pos = scored.agg(F.count(F.lit(1)), F.count_if(label)).first()
    if n >= K.ISOTONIC_MIN_ROWS and min(pos, n - pos) >= K.ISOTONIC_MIN_MINORITY:
        rows = isotonic_blocks(scored, p, label).orderBy("lower").collect()  # the model's own size
        knots = merge_thin_blocks([(r["upper"], r["n"], r["positives"]) for r in rows])
        return Calibration("isotonic", [k[0] for k in knots], [k[1] for k in knots], [k[2] for k in knots])
    odds = VectorAssembler(inputCols=["_l"], outputCol="x").transform(
        scored.select(logit(p).alias("_l"), F.col(label).cast("double").alias("_y")))
    fit = LogisticRegression(featuresCol="x", labelCol="_y", regParam=1.0 / (1e6 * max(n, 1)), standardization=False).fit(odds)
    return Calibration("platt", coef=float(fit.coefficients[0]), intercept=float(fit.intercept))


# --- fold runs -------------------------------------------------------------------------
@dataclass
class Fold:
    metrics: DataFrame
    predictions: DataFrame
    model: object
    preprocessor: Preprocessor
    calibration: Calibration


def run_fold(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, kind: str, config: dict,
             tags: dict[str, str] | None = None) -> Fold:
    """Fit on early anchors, calibrate on the last quarter of them, score the test rows."""
    labelled = train.where(F.col(target).isNotNull())
    roles = cut_lineage(cv.calibration_roles(labelled.withColumn("_all", F.lit(1)), ["_all"]).drop("_all"))
    fit_rows, calib_rows = roles.where("fit_role = 'fit'"), roles.where("fit_role = 'calib'")
    keep = list(features)
    if kind == "trees":
        usable = {r["feature"] for r in feature_stats(fit_rows, features).where(F.col("n_distinct") >= 2).select("feature").collect()}
        keep = [f for f in features if f in usable] or keep
    pre = Preprocessor.fit(fit_rows, keep)
    scaled = kind == "enet"
    fit_x = cut_lineage(pre.vectors(fit_rows, [target], scaled))
    if kind == "enet":
        model = fit_elastic_net(fit_x, target, **config)
    else:
        model = fit_boosted_trees(fit_x, target, **config)
    calib = positive_share(model, pre.vectors(calib_rows, [target], scaled), "p")
    calibration = fit_calibration(cut_lineage(calib.select(target, "p")), "p", target)
    carried = [c for c in ("cond_a", "cond_b", "cond_a_peer") if c in test.columns]
    out = positive_share(model, pre.vectors(test.where(F.col(target).isNotNull()), ["fund_id", "anchor", target, *carried], scaled), "p")
    preds = out.select("fund_id", "anchor", F.col(target).alias("y"), *carried, "p", calibration.apply(F.col("p")).alias("p_cal"))
    for name, value in (tags or {}).items():
        preds = preds.withColumn(name, F.lit(value))
    preds = cut_lineage(preds)
    group = list(tags or {})
    metrics = evaluation.block_metrics(preds if group else preds.withColumn("_g", F.lit(1)), group or ["_g"])
    return Fold(metrics, preds, model, pre, calibration)


def run_folds(rows: DataFrame, features: Sequence[str], runs: Sequence[tuple[str, str, str, dict]], blocks=K.FOLD_BLOCKS,
              model_start: str = K.MODEL_START, horizon: int = 36) -> DataFrame:
    """Out-of-sample predictions of every (target name, column, kind, config) run on every block."""
    out = None
    for name, column, kind, config in runs:
        for block in blocks:
            train = rows.where(cv.train_where(block, model_start, horizon))
            test = rows.where(cv.test_where(block, model_start))
            fold = run_fold(train, test, features, column, kind, config, {"target": name, "model": kind, "block": block[0]})
            out = fold.predictions if out is None else out.unionByName(fold.predictions, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs were given")
    return out


def sensitivity(rows: DataFrame, features: Sequence[str], target: str, blocks=K.FOLD_BLOCKS, model_start: str = K.MODEL_START,
                horizon: int = 36, grids: dict[str, Sequence[dict]] | None = None) -> DataFrame:
    """Mean fold AUCs of every setting of the grids; reported, never selected from."""
    out = None
    for kind, grid in (grids or {"enet": K.ELASTIC_NET_GRID, "trees": K.BOOSTED_TREES_GRID}).items():
        for config in grid:
            preds = run_folds(rows, features, [(target, target, kind, config)], blocks, model_start, horizon)
            name = F.lit(f"{kind}:{json.dumps(config, sort_keys=True)}")
            met = evaluation.block_metrics(preds, ["block"]).withColumn("setting", name)
            mean = met.groupBy("setting").agg(F.avg("pooled_auc").alias("mean_pooled_auc"), F.avg("rank_auc").alias("mean_rank_auc"))
            out = mean if out is None else out.unionByName(mean)
    if out is None:
        raise ValueError("the grids are empty")
    return out


def evaluate_once(spark, path: str, compute, force: bool = False, lease: float = stamps.LEASE_SECONDS) -> DataFrame:
    """A stamped result is reused by every driver; it is computed again, under a stamp of its own, only when forced.

    The holdout is looked at once: of drivers that race for it, one computes and the others read.
    """
    rounds = stamps.rounds(spark, path)
    return stamps.computed_once(spark, f"{path}/round-{rounds if force else max(rounds - 1, 0)}", compute, lease)


def coefficients(rows: DataFrame, features: Sequence[str], target: str, config: dict | None = None) -> DataFrame:
    """(feature, coefficient) of the standardised elastic net on all rows."""
    labelled = rows.where(F.col(target).isNotNull())
    pre = Preprocessor.fit(labelled, features)
    model = fit_elastic_net(cut_lineage(pre.vectors(labelled, [target])), target, **(config or K.ELASTIC_NET))
    pairs = [(f, float(c)) for f, c in zip(features, model.coefficients)]
    return rows.sparkSession.createDataFrame(pairs, "feature string, coefficient double")


def top_coefficients(coefs: DataFrame, k: int = 15) -> DataFrame:
    return coefs.orderBy(F.abs("coefficient").desc(), "feature").limit(k)


def half_year(anchor: str = "anchor") -> Column:
    return F.year(anchor) * 10 + (F.month(anchor) > 6).cast("int")


def bootstrap_draws(halves: Sequence[int], replicates: int, seed: int = 0) -> list[dict[int, int]]:
    """How often each half-year counts in each replicate: as many draws with replacement as there are half-years."""
    rng = random.Random(seed)
    return [dict(Counter(rng.choice(halves) for _ in halves)) for _ in range(replicates)]


def bootstrap_fits(rows: DataFrame, target: str, replicates: int = K.BOOTSTRAP_REPLICATES, config: dict | None = None, seed: int = 0) -> list[batchfit.Fit]:
    """One fit per replicate: a half-year drawn k times counts k times, in preprocessing and fit alike."""
    months = {r["month"]: r["half"] for r in rows.where(F.col(target).isNotNull()).select(F.col("anchor").cast("string").alias("month"), half_year().alias("half")).distinct().collect()}
    draws = bootstrap_draws(sorted(set(months.values())), replicates, seed)
    return [batchfit.Fit(f"r{i}", target, {m: d[h] for m, h in months.items() if h in d}, **(config or K.ELASTIC_NET)) for i, d in enumerate(draws)]


def bootstrap_signs(rows: DataFrame, features: Sequence[str], target: str, replicates: int = K.BOOTSTRAP_REPLICATES,
                    config: dict | None = None, seed: int = 0) -> DataFrame:
    """(feature, stability): share of the dominant coefficient sign over resampled half-years; all replicates share each scan."""
    fitted = batchfit.fit_all(rows, features, bootstrap_fits(rows, target, replicates, config, seed))
    signs = np.sign([f.coefficients for f in fitted])
    pairs = [(f, float(max((signs[:, i] > 0).sum(), (signs[:, i] < 0).sum()) / max(replicates, 1))) for i, f in enumerate(features)]
    return rows.sparkSession.createDataFrame(pairs, "feature string, stability double")


def fold_fits(rows: DataFrame, targets: dict[str, str], settings: Sequence[dict], blocks=K.FOLD_BLOCKS, model_start: str = K.MODEL_START,
              horizon: int = 36) -> tuple[list[batchfit.Fit], list[dict[str, int]]]:
    """A fit per (target, setting, block) on the block's early training months, and the months that it is tested on."""
    calendar = cut_lineage(cv.fold_roles(rows.select("anchor").distinct(), blocks, model_start, horizon))
    early = cv.calibration_roles(calendar.where("role = 'train'"), ["block"]).where("fit_role = 'fit'")
    months: dict[tuple[str, str], dict[str, int]] = {}
    for r in early.select("block", "role", "anchor").union(calendar.where("role = 'test'").select("block", "role", "anchor")).collect():  # months x blocks
        months.setdefault((r["block"], r["role"]), {})[str(r["anchor"])] = 1
    fits, tests = [], []
    for name, column in targets.items():
        for i, setting in enumerate(settings):
            for block, _, _ in blocks:
                fits.append(batchfit.Fit(f"{name}|{i}|{block}", column, months.get((block, "train"), {}), **setting))
                tests.append(months.get((block, "test"), {}))
    return fits, tests


def shared_folds(rows: DataFrame, features: Sequence[str], targets: dict[str, str], settings: Sequence[dict], blocks=K.FOLD_BLOCKS,
                 model_start: str = K.MODEL_START, horizon: int = 36) -> DataFrame:
    """Out-of-sample scores (fund_id, anchor, target, setting, block, y, p) of all folds, targets and settings from shared scans."""
    fits, tests = fold_fits(rows, targets, settings, blocks, model_start, horizon)
    scored = batchfit.scores(rows, features, batchfit.fit_all(rows, features, fits), tests, ["fund_id", "anchor", *targets.values()])
    part = F.split("fit", "\\|")
    own = F.coalesce(*[F.when(part[0] == name, F.col(column).cast("boolean")) for name, column in targets.items()])
    named = scored.select("fund_id", "anchor", part[0].alias("target"), part[1].cast("int").alias("setting"), part[2].alias("block"), own.alias("y"), "p")
    return named.where(F.col("y").isNotNull())


def model_artifact(rows: DataFrame, features: Sequence[str], targets: dict[str, str], model_id: str,
                   holdout_auc: dict[str, float] | None = None) -> DataFrame:
    """The stored model: one row per target with coefficients, statistics and calibration."""
    spark = rows.sparkSession
    numbers = "map<string,double>"
    shape = (
        f"model_id string, features array<string>, target string, base_rate double, signal_context struct<holdout_auc:double,base_rate:double>, "
        f"imputation_medians {numbers}, standardize_mean {numbers}, standardize_std {numbers}, coefficients {numbers}, intercept double, "
        "calibration struct<kind:string,x:array<double>,y:array<double>,support:array<bigint>,coef:double,intercept:double>")
    out = []
    for name, column in targets.items():
        labelled = rows.where(F.col(column).isNotNull())
        roles = cut_lineage(cv.calibration_roles(labelled.withColumn("_all", F.lit(1)), ["_all"]).drop("_all"))
        fit_rows, calib_rows = roles.where("fit_role = 'fit'"), roles.where("fit_role = 'calib'")
        pre = Preprocessor.fit(fit_rows, features)
        fit = fit_elastic_net(cut_lineage(pre.vectors(fit_rows, [column])), column, **K.ELASTIC_NET)
        cal = fit_calibration(cut_lineage(positive_share(fit, pre.vectors(calib_rows, [column]), "p").select(column, "p")), "p", column)
        base = labelled.agg(F.avg(F.col(column).cast("double"))).first()[0]
        stats = [{f: pre.stats[f][i] for f in features} for i in range(3)]
        out.append((
            model_id, list(features), name, base, ((holdout_auc or {}).get(name), base), stats[0], stats[1], stats[2],
            {f: float(c) for f, c in zip(features, fit.coefficients)}, float(fit.intercept),
            (cal.kind, cal.x or None, cal.y or None, cal.support or None, cal.coef, cal.intercept)))
    return spark.createDataFrame(out, shape)
