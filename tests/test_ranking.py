import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from navstead.functions import ranking as R


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 600
    # One group holds most rows; values repeat; some are missing.
    df = pd.DataFrame({
        "id": range(n), "g": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)),
        "x": np.round(rng.normal(0, 0.3, n), 2), "y": rng.random(n) < 0.3})
    df.loc[rng.random(n) < 0.1, "x"] = np.nan
    return df


@pytest.fixture(scope="module")
def rows(spark, sample):
    data = [(int(r.id), r.g, None if pd.isna(r.x) else float(r.x), bool(r.y)) for r in sample.itertuples()]
    return spark.createDataFrame(data, "id int, g string, x double, y boolean").persist()


@pytest.mark.parametrize("ascending", [True, False])
def test_percentile_rank_matches_average_ties(rows, sample, ascending):
    got = R.with_percentile_rank(rows, ["g"], "x", "p", ascending=ascending, digits=1).toPandas().set_index("id")["p"]
    want = sample.groupby("g")["x"].rank(pct=True, ascending=ascending)
    for i, w in zip(sample["id"], want):
        assert (np.isnan(w) and pd.isna(got[i])) or abs(got[i] - w) < 1e-12


def test_quantiles_match_linear_interpolation(rows, sample):
    got = R.group_quantiles(rows, ["g"], "x", {"q": 0.75, "m": 0.5, "lo": 0.0, "hi": 1.0}, digits=1).toPandas().set_index("g")
    for g, part in sample.dropna(subset=["x"]).groupby("g"):
        for name, p in (("q", 0.75), ("m", 0.5), ("lo", 0.0), ("hi", 1.0)):
            assert abs(got.loc[g, name] - np.quantile(part["x"], p)) < 1e-12


def test_loo_median_matches_brute_force(rows, sample):
    got = R.loo_median(rows, ["g"], "x", "m", digits=1)
    joined = rows.join(got, ["g", "x"]).toPandas().set_index("id")
    clean = sample.dropna(subset=["x"])
    for r in clean.itertuples():
        others = clean[(clean.g == r.g) & (clean.id != r.id)]["x"]
        assert abs(joined.loc[r.id, "m"] - np.median(others)) < 1e-12


def test_loo_median_needs_two_peers(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 5.0)], "g string, x double")
    got = {(r.g, r.x): r.m for r in R.loo_median(df, ["g"], "x", "m").collect()}
    assert got[("a", 1.0)] is None and got[("b", 1.0)] == 3.5 and got[("b", 5.0)] == 1.5


def test_auc_with_ties(rows, sample):
    got = {r.g: r.auc for r in R.auc(rows, ["g"], "x", "y", digits=1).collect()}
    clean = sample.dropna(subset=["x"])
    for g, part in clean.groupby("g"):
        pos, neg = part[part.y]["x"].to_numpy(), part[~part.y]["x"].to_numpy()
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert abs(got[g] - wins / (len(pos) * len(neg))) < 1e-12


def test_auc_is_null_with_one_class(spark):
    df = spark.createDataFrame([("a", 0.1, True), ("a", 0.2, True)], "g string, x double, y boolean")
    assert R.auc(df, ["g"], "x", "y").first().auc is None


def test_position_orders_across_cells(rows, sample):
    got = R.with_position(rows.where("x is not null"), ["g"], "x", "id", "pos", "size", digits=1).toPandas()
    for _, part in got.groupby("g"):
        ordered = part.sort_values(["x", "id"], ascending=[False, True])
        assert list(ordered["pos"]) == list(range(1, len(part) + 1))
        assert set(part["size"]) == {len(part)}


def test_spearman(rows, sample):
    both = rows.withColumn("z", F.col("x") * 2 + F.col("id") / 500.0)
    got = R.spearman(both, "x", "z").first()
    pdf = both.dropna(subset=["x"]).toPandas()
    assert abs(got.spearman - pdf["x"].rank().corr(pdf["z"].rank())) < 1e-12


SPREADS = [10.0 + 1e-6, 11.0, -3.5, 0.0, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), 2.0, 1.9999999999999998, 2.0000000000000004, -2.0, -1.9999999999999998, 1024.0, 1023.9999999999999]


def test_cells_never_fall_as_values_rise(spark):
    rng = np.random.default_rng(5)
    values = [*SPREADS, *rng.normal(0, 1, 2000).tolist(), *np.exp(rng.uniform(-700, 700, 2000)).tolist(), *(2.0 ** np.arange(-1020, 1020, 7)).tolist()]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select("v", R.cell_of(F.col("v")).alias("c")).orderBy("v").collect()
    cells = [r.c for r in got]
    assert cells == sorted(cells)
    assert df.where("v = 0").select(R.cell_of(F.col("v"))).first()[0] == 0


def test_a_feature_far_from_zero_spreads_over_many_cells(spark):
    """Values of ten and above: no cell holds a large share, whatever the magnitude."""
    df = spark.range(20_000).select((10 + F.col("id") / 20_000.0).alias("x"), F.lit(1).alias("g"))
    sizes = [r["count"] for r in df.groupBy(R.cell_of(F.col("x"))).count().collect()]
    assert len(sizes) > 400 and max(sizes) < 20_000 / 100
    got = R.group_quantiles(df, ["g"], "x", {"m": 0.5, "q": 0.25}).first()
    x = 10 + np.arange(20_000) / 20_000.0
    assert abs(got.m - np.quantile(x, 0.5)) < 1e-12 and abs(got.q - np.quantile(x, 0.25)) < 1e-12
    again = R.group_quantiles(df.repartition(13, "x"), ["g"], "x", {"m": 0.5, "q": 0.25}).first()
    assert got == again


@pytest.mark.parametrize("code", ["F.format_string('INF%09d', F.col('id') * 37)", "F.col('id').cast('string')", "F.concat(F.lit('é'), F.hex(F.xxhash64('id')))"])
def test_equal_scores_spread_over_many_tasks(spark, code):
    """One anchor, one score: positions follow the tie key, and no cell of it holds more than its share."""
    n = 30_000
    df = spark.range(n).select(F.lit("a").alias("g"), F.lit(0.25).alias("x"), eval(code).alias("k")).repartition(7)
    sizes = [r["count"] for r in df.groupBy(R.tie_cell_of(df, "k")).count().collect()]
    assert max(sizes) < n / 8
    placed = R.with_position(df, ["g"], "x", "k", "pos", "size").orderBy("pos").select("k", "pos", "size").collect()
    assert [r.pos for r in placed] == list(range(1, n + 1)) and {r["size"] for r in placed} == {n}
    assert [r.k.encode() for r in placed] == sorted(r.k.encode() for r in placed)


def test_positions_with_missing_values_and_ties(spark):
    rows = [("a", v, f"k{i:02d}") for i, v in enumerate([None, 2.0, 2.0, None, 5.0, -1.0, 2.0])] + [("b", None, "z"), ("b", None, "")]
    df = spark.createDataFrame(rows, "g string, x double, k string")
    got = [(r.g, r.x, r.k) for r in R.with_position(df, ["g"], "x", "k", "pos", "size").orderBy("g", "pos").collect()]
    want = sorted(rows, key=lambda r: (r[0], -(r[1] if r[1] is not None else float("-inf")), r[2]))
    assert got == want
