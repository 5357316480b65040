"""Many penalised fits in shared scans, against Spark ML one by one."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from navstead import constants as K
from navstead.operators import batchfit, model

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 1200
    x = rng.normal(size=(n, 4)) * (1, 30, 0.01, 1) + (0, 500, 0, 0)
    x[rng.random((n, 4)) < 0.1] = np.nan
    x[:, 3] = 2.0  # without spread
    p = 1 / (1 + np.exp(-(1.2 * np.nan_to_num(x[:, 0]) - 0.03 * (np.nan_to_num(x[:, 1], nan=500) - 500) - 0.7)))
    y = rng.random(n) < p
    months = [dt.date(2015 + k // 12, k % 12 + 1, 28) for k in rng.integers(0, 18, n)]
    data = [(str(i), months[i], *[None if np.isnan(v) else float(v) for v in x[i]], None if i % 17 == 0 else bool(y[i]), bool(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(data, "fund_id string, anchor date, a double, b double, c double, d double, y boolean, z boolean").persist()


def months_of(rows):
    return sorted(str(r.anchor) for r in rows.select("anchor").distinct().collect())


def one_by_one(rows, fit):
    """Rows written out as often as they count, then Spark's own fit."""
    times = F.lit(0)
    for m, k in fit.months.items():
        times = F.when(F.col("anchor").cast("string") == m, k).otherwise(times)
    sample = rows.where(F.col(fit.target).isNotNull()).withColumn("_k", times).where("_k > 0").withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    pre = model.Preprocessor.fit(sample, FEATURES)
    return pre, model.fit_elastic_net(pre.vectors(sample, [fit.target]), fit.target, fit.C, fit.l1_ratio)


def test_fits_match_spark_ml_whatever_the_partitions(spark, rows):
    months = months_of(rows)
    fits = [batchfit.Fit("all", "y", {m: 1 for m in months}, 0.1, 0.5), batchfit.Fit("drawn", "y", {m: i % 3 for i, m in enumerate(months)}, 0.03, 0.2),
            batchfit.Fit("other", "z", {m: 1 for m in months[6:]}, 1.0, 0.8), batchfit.Fit("nothing", "y", {}, 0.1, 0.5), batchfit.Fit("absent", "y", {"1999-01-31": 2}, 0.1, 0.5)]
    got = batchfit.fit_all(rows, FEATURES, fits)
    for fit, g in zip(fits[:3], got):
        pre, want = one_by_one(rows, fit)
        assert g.violation <= batchfit.TOLERANCE
        assert np.allclose(g.coefficients, want.coefficients.toArray(), atol=2e-5) and abs(g.intercept - want.intercept) < 2e-5
        stats = np.array([pre.stats[f] for f in FEATURES]).T
        assert np.allclose([g.medians, g.means, g.deviations], stats)
    for g in got[3:]:
        assert g.n == 0 and not g.coefficients.any() and g.violation == float("inf")
    again = batchfit.fit_all(rows.repartition(11, "fund_id"), FEATURES, fits)
    assert all(np.allclose(g.coefficients, h.coefficients, atol=1e-9) and (g.n, g.positives) == (h.n, h.positives) for g, h in zip(got, again))


def test_a_scan_serves_all_fits(spark, rows, monkeypatch):
    passes = []
    inner = batchfit._pass
    monkeypatch.setattr(batchfit, "_pass", lambda *a: passes.append(len(a[2])) or inner(*a))
    months = months_of(rows)
    batchfit.fit_all(rows, FEATURES, [batchfit.Fit(f"f{i}", "y", {m: 1 for j, m in enumerate(months) if j % 9 != i}, 0.1, 0.5) for i in range(9)])
    assert passes[0] == 9 and len(passes) <= 12


def test_bootstrap_counts_half_years(spark, rows):
    fits = model.bootstrap_fits(rows, "y", 3)
    halves = {str(r.anchor): r.h for r in rows.select("anchor", model.half_year().alias("h")).distinct().collect()}
    for f in fits:
        assert sum({halves[m]: k for m, k in f.months.items()}.values()) == len(set(halves.values()))
    signs = {r.feature: r.stability for r in model.bootstrap_signs(rows, FEATURES, "y", 4).collect()}
    want = [np.sign(one_by_one(rows, f)[1].coefficients.toArray()) for f in model.bootstrap_fits(rows, "y", 4)]
    for i, f in enumerate(FEATURES):
        column = np.array([w[i] for w in want])
        assert signs[f] == max((column > 0).sum(), (column < 0).sum()) / 4


def test_shared_folds_purge_and_score(spark, rows):
    blocks = (("A", "2015-01-01", "2015-06-30"), ("B", "2016-01-01", "2016-06-30"))
    fits, tests = model.fold_fits(rows, {"t": "y"}, [K.ELASTIC_NET], blocks, "2015-01-01", 2)
    for f, asked, (name, start, end) in zip(fits, tests, blocks):
        assert f.name == f"t|0|{name}" and asked and all(start <= m <= end for m in asked)
        assert f.months and not set(f.months) & set(asked)
    # labels look two months ahead, and one month of embargo follows: nothing from half a year before B's first price is touched after it
    assert all(m < "2015-11-01" or m > "2016-09-30" for m in fits[1].months)
    preds = model.shared_folds(rows, FEATURES, {"t": "y", "u": "z"}, [K.ELASTIC_NET], blocks, "2015-01-01", 2)
    got = {(r.target, r.block): r.n for r in preds.groupBy("target", "block").agg(F.count("*").alias("n")).collect()}
    for target, column in (("t", "y"), ("u", "z")):
        for name, start, end in blocks:
            assert got[target, name] == rows.where(F.col("anchor").between(start, end) & F.col(column).isNotNull()).count()
    fitted = batchfit.fit_all(rows, FEATURES, fits)
    pre_rows = rows.where(F.col("anchor").between("2015-01-01", "2015-06-30") & F.col("y").isNotNull())
    z = F.lit(fitted[0].intercept)
    for i, f in enumerate(FEATURES):
        z = z + float(fitted[0].coefficients[i]) * (F.coalesce(F.col(f), F.lit(float(fitted[0].medians[i]))) - float(fitted[0].means[i])) / float(fitted[0].deviations[i])
    by_hand = {(r.fund_id): r.p for r in pre_rows.select("fund_id", (1 / (1 + F.exp(-z))).alias("p")).collect()}
    shared = {r.fund_id: r.p for r in preds.where("target = 't' AND block = 'A'").collect()}
    assert by_hand.keys() == shared.keys() and all(abs(by_hand[k] - shared[k]) < 1e-9 for k in shared)


def test_settings_of_the_same_months_share_their_medians():
    """The table of value counts is as wide as there are samples, however many settings are fitted on them."""
    months = [{"2015-01-31": 1, "2015-02-28": 1}, {"2015-02-28": 1, "2015-01-31": 1, "2015-03-31": 0}, {"2015-01-31": 2}]
    fits = [batchfit.Fit(f"{t}{i}{c}", t, m, c, 0.5) for t in ("y", "z") for i, m in enumerate(months) for c in (0.1, 1.0)]
    place, samples = batchfit._samples(fits)
    assert place == [0, 0, 0, 0, 1, 1, 2, 2, 2, 2, 3, 3] and [(f.target, f.months) for f in samples] == [(t, m) for t in ("y", "z") for m in (months[0], months[2])]
