import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from navstead.functions.carry import carry_forward
from navstead.operators import cleaning, metrics, series


def frame(spark, values, start=dt.date(2020, 1, 1), fund="1", step=1):
    rows = [(fund, start + dt.timedelta(days=step * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "fund_id string, dt date, nav double")


def test_asof_tolerance_is_inclusive(spark):
    nav = frame(spark, [10, 11])
    probes = spark.createDataFrame([("1", dt.date(2020, 1, d)) for d in (1, 2, 12, 13)] + [("1", dt.date(2019, 12, 31))], "fund_id string, t date")
    got = {r.t: r.hit for r in series.asof(nav, probes, "fund_id", ["nav"], "t").collect()}
    assert got[dt.date(2020, 1, 1)].nav == 10 and got[dt.date(2020, 1, 12)].nav == 11
    assert got[dt.date(2020, 1, 13)] is None and got[dt.date(2019, 12, 31)] is None


def test_window_drawdown_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2014-01-01", "2020-12-31")
    keep = days[rng.random(len(days)) < 0.6]
    levels = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(keep)))), index=keep)
    nav = spark.createDataFrame([("1", d.date(), float(v)) for d, v in levels.items()], "fund_id string, dt date, nav double")
    anchors = list(pd.date_range("2017-01-31", "2020-12-31", freq="ME")) + [pd.Timestamp("2019-02-13"), pd.Timestamp("2019-02-28")]
    pairs = spark.createDataFrame([("1", a.date()) for a in sorted(set(anchors))], "fund_id string, anchor date")
    got = {r.anchor: (r.max_dd, r.current_dd) for r in series.window_drawdown(nav, pairs, 36).collect()}
    assert len(got) == len(set(anchors))
    for a in set(anchors):
        start = levels.index[levels.index <= a - pd.DateOffset(years=3)][-1]
        win = levels.loc[start:a]
        dd = win / win.cummax() - 1
        assert abs(got[a.date()][0] - dd.min()) < 1e-12 and abs(got[a.date()][1] - dd.iloc[-1]) < 1e-12


def test_window_drawdown_of_many_pieces_and_gaps(spark):
    """Funds with few prices, windows with none, equal edges; every pair against a walk over its prices."""
    rng = np.random.default_rng(8)
    rows, asked, want = [], [], {}
    for fund in range(12):
        days = pd.date_range("2018-01-01", periods=500, freq="D")
        days = days[rng.random(500) < (0.9, 0.5, 0.08, 0.02)[fund % 4]]
        levels = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.03, len(days)))), index=days)
        rows += [(str(fund), d.date(), float(v)) for d, v in levels.items()]
        for a in pd.date_range("2018-03-01", periods=int(rng.integers(1, 90)), freq="5D"):
            asked.append((str(fund), a.date()))
            since = a - pd.DateOffset(months=2)
            before = levels.index[levels.index <= since]
            if len(before) and (since - before[-1]).days <= 10:
                win = levels.loc[before[-1]:a]
                dd = win / win.cummax() - 1
                want[(str(fund), a.date())] = (dd.min(), dd.iloc[-1])
    nav = spark.createDataFrame(rows, "fund_id string, dt date, nav double")
    pairs = spark.createDataFrame(asked, "fund_id string, anchor date")
    got = {(r.fund_id, r.anchor): (r.max_dd, r.current_dd) for r in series.window_drawdown(nav, pairs, 2).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][i] - want[k][i]) < 1e-12 for k in want for i in (0, 1))


def test_business_calendar_carries_five_rows_only(spark):
    nav = frame(spark, [1, None, None, None, None, None, None, None, None, None, None, 2], start=dt.date(2020, 1, 6)).where("nav is not null")
    got = {r.dt: r.nav for r in series.business_calendar(nav).collect()}
    assert got[dt.date(2020, 1, 13)] == 1 and got[dt.date(2020, 1, 14)] is None
    assert dt.date(2020, 1, 11) not in got


@pytest.mark.parametrize("values,gone", [
    ([100, 101, 113, 101.5, 102, 103], {2}),           # a print that reverts
    ([100, 101, 113, 114, 115, 116], set()),            # a real jump stays
    ([100, 113, 100, 100], set()),                      # too short to judge
])
def test_spikes(spark, values, gone):
    kept = cleaning.remove_spikes(frame(spark, values)).orderBy("dt").collect()
    assert [r.nav for r in kept] == [float(v) for i, v in enumerate(values) if i not in gone]


def test_payout_is_put_back_unless_the_market_fell(spark):
    nav = frame(spark, [100, 100, 94, 94, 94, 90]).withColumn("is_payout_plan", F.lit(True))
    bench = frame(spark, [50, 50, 50, 50, 50, 48]).select("fund_id", "dt", F.col("nav").alias("bench"))
    got = cleaning.reconstruct_payouts(nav, bench).orderBy("dt").collect()
    assert [r.payout for r in got] == [False, False, True, False, False, False]
    assert got[5].market_move and abs(got[2].nav - 100) < 1e-9 and abs(got[5].nav - 90 / 0.94) < 1e-9
    growth = cleaning.reconstruct_payouts(nav.withColumn("is_payout_plan", F.lit(False)), bench).orderBy("dt").collect()
    assert [r.nav for r in growth] == [100, 100, 94, 94, 94, 90]


def test_sortino_ignores_the_first_row(spark):
    nav = frame(spark, [100, 101, 99, 102, 98])
    row = metrics.return_metrics(nav).first()
    r = pd.Series([100, 101, 99, 102, 98.0]).pct_change().dropna() - ((1.0675) ** (1 / 252) - 1)
    want = r.mean() / np.sqrt(np.mean(np.minimum(r, 0) ** 2)) * np.sqrt(252)
    assert abs(row.sortino - want) < 1e-9


def test_carry_forward_crosses_segments(spark):
    rows = spark.createDataFrame([("f", 0, 1, "A"), ("f", 0, 2, None), ("f", 1, 3, None), ("f", 2, 4, None), ("f", 2, 5, "B"), ("f", 3, 6, None), ("g", 0, 1, None)],
                                 "src string, seg int, n int, v string")
    got = {(r.src, r.n): r.v for r in carry_forward(rows, ["src"], "seg", "n", ["v"]).collect()}
    assert [got[("f", i)] for i in range(1, 7)] == ["A", "A", "A", "A", "B", "B"] and got[("g", 1)] is None
