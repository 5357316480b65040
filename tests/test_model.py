import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from navstead import constants as K
from navstead.operators import cv, evaluation, inference, isotonic, model
from navstead.sources import scans, stamps


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.8 * x[:, 1] - 0.9)))
    y = rng.random(n) < p
    months = np.array([np.datetime64("2015-01-31") for _ in range(n)]) + rng.integers(0, 30, n) * np.timedelta64(31, "D")
    rows = [(str(i), months[i].item(), *map(float, x[i]), bool(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "fund_id string, anchor date, a double, b double, c double, y boolean").persist(), x, y


def test_elastic_net_reaches_the_reference_objective(data):
    rows, x, y = data
    pre = model.Preprocessor.fit(rows, ["a", "b", "c"])
    fit = model.fit_elastic_net(pre.vectors(rows, ["y"]), "y", **K.ELASTIC_NET)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    s = np.where(y, 1.0, -1.0)
    beta, b0, lr = np.zeros(3), 0.0, 1e-3
    C, ratio = K.ELASTIC_NET["C"], K.ELASTIC_NET["l1_ratio"]
    for _ in range(20000):   # proximal gradient on C·Σ w·loss + ratio·|β| + (1-ratio)/2·β²
        g = -C * w * s / (1 + np.exp(s * (z @ beta + b0)))
        step = beta - lr * (z.T @ g + (1 - ratio) * beta)
        beta, b0 = np.sign(step) * np.maximum(np.abs(step) - lr * ratio, 0), b0 - lr * g.sum()
    assert np.allclose(fit.coefficients.toArray(), beta, atol=2e-3) and abs(fit.intercept - b0) < 2e-3


def test_preprocessor_uses_median_then_moments(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (9.0, None)], "a double, b double")
    got = model.Preprocessor.fit(df, ["a", "b"]).stats
    filled = np.array([1, 2, 2, 9.0])
    assert np.allclose(got["a"], (2.0, filled.mean(), filled.std(ddof=1))) and got["b"] == (0.0, 0.0, 1.0)


def test_merge_thin_blocks():
    merged = model.merge_thin_blocks([(0.1, 6, 0), (0.2, 40, 4), (0.5, 10, 5), (0.9, 60, 60)])
    assert [m[2] for m in merged] == [56, 60] and merged[0][0] == 0.5 and merged[1][0] == 0.9 and merged[0][1] == 9 / 56
    ends = model.merge_thin_blocks([(0.1, 50, 0), (0.5, 50, 20), (0.9, 60, 60)])
    assert 0 < ends[0][1] <= 0.06 and 0.9 < ends[-1][1] < 1.0
    ys = [m[1] for m in ends]
    assert ys == sorted(ys)


def thin_by_scan(blocks, least):
    """The rule as it is said: scan for the thinnest, join it to the thinner neighbour, again."""
    rows = [list(b) for b in blocks]
    while len(rows) > 1 and min(r[1] for r in rows) < least:
        i = min(range(len(rows)), key=lambda i: rows[i][1])
        j = min((j for j in (i - 1, i + 1) if 0 <= j < len(rows)), key=lambda j: rows[j][1])
        a, b = min(i, j), max(i, j)
        rows[a:b + 1] = [[rows[b][0], rows[a][1] + rows[b][1], rows[a][2] + rows[b][2]]]
    return [(r[0], r[1]) for r in rows]


def test_thin_blocks_merge_as_the_rule_says():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 60, int(rng.integers(1, 40)))
        blocks = [(float(i), int(n), int(n) // 2) for i, n in enumerate(sizes)]
        assert [(m[0], m[2]) for m in model.merge_thin_blocks(blocks)] == thin_by_scan(blocks, K.CALIBRATION_MIN_BLOCK)


def pav(values):
    """Plain pool-adjacent-violators over (score, outcome) pairs."""
    blocks = []
    for p in sorted({p for p, _ in values}):
        own = [y for q, y in values if q == p]
        blocks.append([p, p, len(own), sum(own)])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [tuple(b) for b in blocks]


@pytest.mark.parametrize("kind", ["noisy", "falling", "one score", "no rows", "hot score"])
def test_isotonic_blocks_do_not_depend_on_the_partitions(spark, kind):
    rng = np.random.default_rng(6)
    p = {"one score": np.full(500, 0.5), "no rows": np.array([])}.get(kind, np.round(rng.random(900), 3))
    if kind == "hot score":
        p[:600] = 0.4
    y = rng.random(len(p)) < (1 - p if kind == "falling" else p)
    rows = [(float(a), bool(b)) for a, b in zip(p, y)] + [(None, True), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y boolean").repartition(5)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "8", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append([tuple(r) for r in isotonic.isotonic_blocks(df, "p", "y").orderBy("lower").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2] == pav([(float(a), int(b)) for a, b in zip(p, y)])


def test_calibration_falls_back_when_thin(spark):
    df = spark.createDataFrame([(i / 100.0, i % 3 == 0) for i in range(1, 60)], "p double, y boolean")
    cal = model.fit_calibration(df, "p", "y")
    assert cal.kind == "platt" and cal.coef is not None
    out = df.select(cal.apply(F.col("p"))).first()[0]
    assert 0 < out < 1


def test_isotonic_calibration_is_monotone_and_supported(spark):
    rng = np.random.default_rng(2)
    p = rng.random(1500)
    df = spark.createDataFrame([(float(v), bool(rng.random() < v)) for v in p], "p double, y boolean")
    cal = model.fit_calibration(df, "p", "y")
    assert cal.kind == "isotonic" and min(cal.support) >= K.CALIBRATION_MIN_BLOCK and sum(cal.support) == 1500
    assert cal.x == sorted(cal.x) and cal.y == sorted(cal.y)


def test_interpolation_matches_numpy(spark):
    xs, ys = [0.2, 0.4, 0.7], [0.1, 0.3, 0.9]
    points = [0.0, 0.2, 0.25, 0.4, 0.69, 0.7, 1.0]
    df = spark.createDataFrame([(v,) for v in points], "p double")
    got = [r[0] for r in df.select(inference.interpolate(F.col("p"), F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys)))).collect()]
    assert np.allclose(got, np.interp(points, xs, ys))


def test_purge_boundaries(spark):
    days = ["2012-12-31", "2013-01-31", "2019-01-31", "2019-02-28"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("a"))
    got = [r[0] for r in df.select(cv.survives(F.col("a"), "2016-01-31", "2016-01-31")).collect()]
    assert got == [True, False, False, False]
    late = spark.sql("select date'2019-03-01' a").select(cv.survives(F.col("a"), "2016-01-31", "2016-01-31")).first()[0]
    assert late


def test_calibration_cut_of_few_anchors(spark):
    df = spark.sql("select explode(sequence(date'2020-01-31', date'2020-04-30', interval 1 month)) anchor")
    assert str(cv.calibration_cut(df).first().calib_from) == "2020-04-30"


def test_fold_run_and_stamp(spark, data, tmp_path):
    rows, _, _ = data
    train, test = rows.where("anchor < '2017-01-01'"), rows.where("anchor >= '2017-01-01'")
    fold = model.run_fold(train, test, ["a", "b", "c"], "y", "enet", K.ELASTIC_NET, {"target": "t", "model": "enet", "block": "B"})
    got = fold.metrics.first()
    assert got.pooled_auc > 0.7 and got.n == test.count() and 0 <= got.brier <= 0.3
    calls = []

    def compute():
        calls.append(1)
        return fold.metrics

    for _ in range(2):
        model.evaluate_once(spark, str(tmp_path / "stamp"), compute)
    assert len(calls) == 1
    model.evaluate_once(spark, str(tmp_path / "stamp"), compute, force=True)
    assert len(calls) == 2


def test_racing_sessions_compute_once(spark, tmp_path):
    """Four sessions ask at the same moment: one computes, all read its stamp."""
    calls, got, gate = [], [], threading.Barrier(4)

    def driver(i):
        own = spark.newSession()

        def compute():
            calls.append(i)
            time.sleep(1.0)
            return own.range(3).withColumn("by", F.lit(i))

        gate.wait()
        got.append({(r.by, r.stamp_owner, r.stamp_claim) for r in model.evaluate_once(own, str(tmp_path / "race"), compute).collect()})

    threads = [threading.Thread(target=driver, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(calls) == 1 and len(got) == 4 and all(g == got[0] and len(g) == 1 for g in got)


def test_a_lost_driver_gives_way_after_its_lease(spark, tmp_path):
    path = str(tmp_path / "lost")
    assert stamps.Stamp(spark, f"{path}/round-0").claim(0)  # and never publishes
    row = model.evaluate_once(spark, path, lambda: spark.range(1), lease=0.5).first()
    assert row.stamp_claim == 1
    with pytest.raises(ZeroDivisionError):
        model.evaluate_once(spark, path, lambda: 1 / 0, force=True)
    assert model.evaluate_once(spark, path, lambda: spark.range(2), force=True).count() == 2  # a failed claim is released
    assert model.evaluate_once(spark, path, lambda: 1 / 0).count() == 2


def test_sensitivity_grid_reports_each_setting(data):
    rows, _, _ = data
    grids = {"enet": K.ELASTIC_NET_GRID[:2], "trees": ({**K.BOOSTED_TREES, "iterations": 3},)}
    got = model.sensitivity(rows, ["a", "b"], "y", (("B", "2017-01-01", "2017-12-31"),), "2015-01-01", 1, grids).collect()
    assert len(got) == 3 and all(r.mean_pooled_auc > 0.6 for r in got)


def test_bootstrap_sign_stability(data):
    rows, _, _ = data
    got = {r.feature: r.stability for r in model.bootstrap_signs(rows, ["a", "b"], "y", replicates=2).collect()}
    assert got == {"a": 1.0, "b": 1.0}


def test_leakage_demo(spark):
    """A memorised fund effect scores well only when train and test overlap in time."""
    assert evaluation.challenger_verdict(
        spark.createDataFrame([("t", "enet", 0.55), ("t", "trees", 0.60)], "target string, model string, mean_pooled_auc double"),
        spark.createDataFrame([("t", "enet", 0.55), ("t", "trees", 0.50)], "target string, model string, pooled_auc double")).first().adopt is False


def test_stored_model_round_trip(spark, data, tmp_path):
    rows, _, _ = data
    art = model.model_artifact(rows, ["a", "b", "c"], {"cohort_q1": "y"}, "v1", {"cohort_q1": 0.6})
    m = art.first()
    doc = {"version": "v1", "features": list(m.features), "models": {"cohort_q1": {
        "base_rate": m.base_rate, "signal_context": {"holdout_auc": 0.6, "base_rate": m.base_rate}, "imputation_medians": m.imputation_medians,
        "standardize_mean": m.standardize_mean, "standardize_std": m.standardize_std, "coefficients": m.coefficients, "intercept": m.intercept,
        "calibration": {k: v for k, v in m.calibration.asDict().items() if v is not None}}}}
    import json
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    back = scans.model_artifact(spark, str(tmp_path / "m.json"))
    assert back.count() == 1
    feats = ["a", "b", "c"]
    a = inference.score(rows, art, feats).select("fund_id", F.col("probability").alias("p"))
    b = inference.score(rows, back, feats).select("fund_id", F.col("probability").alias("q"))
    assert a.join(b, "fund_id").where(F.abs(F.col("p") - F.col("q")) > 1e-9).count() == 0


def test_scoring_does_not_deal_rows_by_target(spark, data):
    """One target's rows stay in their tasks: a join by target would put all of them into one."""
    rows, _, _ = data
    numbers = "map<string,double>"
    calibration = "struct<kind:string,x:array<double>,y:array<double>,coef:double,intercept:double>"
    shape = (f"model_id string, target string, signal_context struct<holdout_auc:double,base_rate:double>, imputation_medians {numbers}, standardize_mean {numbers}, "
             f"standardize_std {numbers}, coefficients {numbers}, intercept double, calibration {calibration}")
    one = {"a": 1.0}
    stored = spark.createDataFrame([("m", t, (0.5, 0.5), one, one, one, one, 0.0, ("platt", None, None, 1.0, 0.0)) for t in ("q1", "top", None)], shape)
    scored = inference.score(rows, stored, ["a"])
    assert "hashpartitioning(target" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {r.target: r["count"] for r in scored.groupBy("target").count().collect()} == {"q1": 900, "top": 900}
