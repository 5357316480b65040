"""What one scan of many fits gives, and what it costs."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from navstead.operators import batchfit

MONTHS = ["2015-01-31", "2015-02-28", "2015-03-31"]


def table_of(spark, n=900):
    rng = np.random.default_rng(3)
    odd = np.array([0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, -1.0])
    x = np.column_stack([rng.choice(odd, n), rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n), np.ones(n), 1 + rng.integers(0, 9, n) * 2**-52])
    gone = rng.random((n, 4)) < 0.2
    y, z = rng.random(n) < 0.4, rng.random(n) < 0.3
    data = [(dt.date.fromisoformat(MONTHS[i % 3]), *[None if gone[i, j] else float(x[i, j]) for j in range(4)], None if i % 7 == 0 else bool(y[i]), None if i % 5 == 0 else bool(z[i]), str(i)) for i in range(n)]
    return spark.createDataFrame(data, "anchor date, a double, b double, c double, d double, y boolean, z boolean, fund_id string"), data


def test_medians_of_all_samples_are_exact_to_the_last_digit(spark, monkeypatch):
    """Both middle values are found among values that differ in their last digit alone, by few digits at a time."""
    monkeypatch.setattr(batchfit, "FEW", 0)
    rows, data = table_of(spark)
    fits = [batchfit.Fit(f"{t}{i}", t, dict(zip(MONTHS, w)), 0.1, 0.5) for t in "yz" for i, w in enumerate([(1, 1, 1), (0, 2, 1), (3, 0, 0), (0, 0, 2)])]
    monkeypatch.setattr(batchfit, "MOST_PASSES", 0)
    monkeypatch.setattr(batchfit, "_first_curvature", lambda *a: [np.eye(9)] * len(a[2]))
    got = batchfit.fit_all(rows, list("abcd"), fits)
    for g in got:
        own = [r for r in data for _ in range(g.fit.months[str(r[0])]) if r[5 + "yz".index(g.fit.target)] is not None]
        assert g.n == len(own) and g.positives == sum(r[5 + "yz".index(g.fit.target)] for r in own)
        assert list(g.medians) == [float(np.median([r[1 + j] for r in own if r[1 + j] is not None])) for j in range(4)]


def test_scores_of_many_fits_are_one_step_of_the_plan(spark):
    """The plan does not grow with the fits; each row has a score per fit that asks for its month."""
    rows, data = table_of(spark)
    fits = [batchfit.Fit(f"f{i}", "y", {}, 0.1, 0.5) for i in range(400)]
    fitted = [batchfit.Fitted(f, 1, 1, np.ones(4), np.zeros(4), np.ones(4), np.array([0.0, 0.0, 0.1, i / 400]), 0.5, 0.0 if i else float("inf")) for i, f in enumerate(fits)]
    asked = [{MONTHS[i % 3]: 1} for i in range(400)]
    got = batchfit.scores(rows, list("abcd"), fitted, asked, ["fund_id"])
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    want = {(r[7], f"f{i}"): 1 / (1 + np.exp(-(0.5 + 0.1 * (1.0 if r[3] is None else r[3]) + i / 400 * (1.0 if r[4] is None else r[4])))) for r in data[:60] for i in range(1, 400) if str(r[0]) in asked[i]}
    have = {(r.fund_id, r.fit): r.p for r in got.where(F.col("fund_id").cast("int") < 60).collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in want)


def test_a_pass_sends_no_curvature(spark, monkeypatch):
    """Passes add up loss and gradient; curvature is taken once for all fits and learned after that."""
    rows, _ = table_of(spark)
    sizes, scans, inner, curve = [], [], batchfit._pass, batchfit._curvature

    def counted(*a):
        out = inner(*a)
        sizes.append({len(s) for s in out.values()})
        return out

    monkeypatch.setattr(batchfit, "_pass", counted)
    monkeypatch.setattr(batchfit, "_curvature", lambda *a: scans.append(len(a[4])) or curve(*a))
    fits = [batchfit.Fit(f"r{i}", "y", dict(zip(MONTHS, w)), 0.1, 0.5) for i, w in enumerate([(1, 1, 1), (2, 1, 0), (0, 1, 2), (3, 0, 0), (0, 0, 3)] * 8)]
    got = batchfit.fit_all(rows.withColumn("a", F.col("a") / 1e308), list("abcd"), fits)
    assert all(g.violation <= batchfit.TOLERANCE for g in got)
    assert set().union(*sizes) == {2 * 4 + 2} and scans[0] <= 3 * 2 and len(scans) <= 2


def test_quadratics_of_columns_that_are_copies_end_at_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    x[:, 3], x[:, 4] = x[:, 0], -x[:, 1] + 1e-7 * x[:, 2]
    wide = np.column_stack([x, np.ones(60)])
    curve, slope, start = wide.T @ wide, wide.T @ rng.normal(size=60) * 5, rng.normal(size=7)
    out = batchfit._descend(slope[None], curve[None], start[None], np.array([0.5]), np.array([2.0]))[0]
    pull = slope + curve @ (out - start)
    assert batchfit._violation(pull, out[:-1], 0.5, 2.0) < 1e-8
