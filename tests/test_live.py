"""Candidates are measured against reference peers and never change them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from navstead import constants as K
from navstead.operators import cohorts, live
from navstead.plans import model_queries as M
from navstead.session import cut_lineage


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    days = pd.bdate_range("2018-01-01", "2021-06-30")
    common = rng.normal(0.0003, 0.006, len(days))
    nav = []
    for i in range(12):
        s = 100 * np.exp(np.cumsum(common + rng.normal(0, 0.004, len(days))))
        first = 0 if i != 5 else len(days) - 100
        last = len(days) if i != 4 else len(days) - 60
        nav += [(str(i), d.date(), float(v)) for d, v in list(zip(days, s))[first:last]]
    nav = cut_lineage(spark.createDataFrame(nav, "fund_id string, dt date, nav double"))
    manifest = spark.createDataFrame(
        [(str(i), "Large Cap", None) for i in range(6)] + [(str(i), K.SECTOR_KEYED, "PSU") for i in (6, 7, 8)], "fund_id string, category string, sector string")
    raw = {"9": "Equity Scheme - Large Cap Fund", "10": "Equity Scheme - Sectoral/ Thematic", "11": "Debt Scheme - Gilt Fund", "12": "Equity Scheme - Large Cap Fund"}
    master = spark.createDataFrame([(k, f"Open Ended Schemes({v})") for k, v in raw.items()], "fund_id string, category_raw string")
    overrides = spark.createDataFrame([("10", "PSU")], "amfi_code string, sector string")
    return nav, manifest, master, overrides


def run(spark, world, codes):
    nav, manifest, master, overrides = world
    asked = spark.createDataFrame([(c,) for c in codes], "fund_id string")
    out = live.score_live(asked, manifest, nav, master, overrides, M.small_model(spark), list(M.COEF), F.lit("2021-06-30").cast("date"))
    assert out.rows.where("status = 'OK'").count() == out.rows.where("cohort_id IS NOT NULL").count()
    return {r.fund_id: r for r in cohorts.with_codes(out.rows, out.members).collect()}


def test_gates_and_isolation(spark, world):
    alone = run(spark, world, [str(i) for i in range(9)])
    both = run(spark, world, [str(i) for i in range(13)])
    status = {k: v.status for k, v in both.items()}
    assert status["4"] == "STALE_NAV" and status["5"] == "INSUFFICIENT_HISTORY" and status["6"] == "THIN_COHORT"
    assert status["11"] == "OUT_OF_TRAINING_UNIVERSE" and status["12"] == "NOT_IN_UNIVERSE"
    assert status["9"] == "OK" and status["0"] == "OK" and status["10"] == "OK"
    for code in "01236":
        assert (alone[code].probability, alone[code].cohort_percentile, alone[code].cohort_codes) == (both[code].probability, both[code].cohort_percentile, both[code].cohort_codes)
    only = run(spark, world, ["9"])["9"]
    assert abs(only.probability - both["9"].probability) < 1e-12 and only.cohort_percentile == both["9"].cohort_percentile
    assert both["9"].cohort_codes == ["0", "1", "2", "3", "9"] and both["9"].cohort_n == 5 and both["0"].cohort_n == 4
    assert both["4"].probability is None and both["5"].imputed_features and both["6"].imputed_features is None


def test_an_uncurated_sector_refuses(spark, world):
    nav, manifest, master, overrides = world
    got = run(spark, (nav, manifest, master, overrides.where("sector = 'none'")), ["10"])
    assert got["10"].status == "SECTOR_UNRESOLVED" and got["10"].cohort_n == 0
