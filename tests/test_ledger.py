import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from navstead.operators import cohorts, ledger, monitoring, store
from navstead.sources import scans, sinks
from navstead.streaming import ingest

SHAPE = "fund_id string, target string, anchor string, model_id string, run_id string, logged_at string, probability double, cohort_percentile double, cohort_codes array<string>"


def rows(spark, data):
    return spark.createDataFrame([(f, "q1", a, m, r, at, p, 0.5, ["1", "2", "3", "4"]) for f, a, m, r, at, p in data], SHAPE)


def test_append_is_idempotent_and_keeps_unkeyed_rows(spark, tmp_path):
    book = store.LedgerStore(spark, str(tmp_path / "ledger"))
    batch = rows(spark, [("1", "2020-01-31", "m1", "r1", "b", 0.2), ("1", "2020-01-31", "m1", "r1", "a", 0.1), ("1", "2020-01-31", "m2", "r1", "a", 0.3),
                         ("2", "2020-01-31", None, "r1", "a", 0.4), ("2", "2020-01-31", None, "r1", "a", 0.4), ("3", None, "m1", "r1", "a", 0.5)])
    assert book.append(batch) == ["2020-01", "none"]
    first = book.predictions()
    assert first.count() == 5
    assert first.where("model_id = 'm1' AND anchor IS NOT NULL").first().probability == 0.1
    book.append(batch)
    again = book.predictions()
    keyed = "model_id IS NOT NULL AND anchor IS NOT NULL"
    assert again.where(keyed).count() == 2 and again.where(f"NOT ({keyed})").count() == 6
    assert ledger.dedupe(again).count() == 8
    assert sorted((r.anchor_month, r.fund_id) for r in book.members().collect()) == sorted((m, c) for m in ("2020-01", "none") for c in "1234")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_append_reads_keys_of_its_own_months_only(spark, tmp_path, monkeypatch):
    book = store.LedgerStore(spark, str(tmp_path / "ledger"))
    book.append(rows(spark, [(str(i), f"20{y}-0{m}-28", "m", "r", "a", 0.1) for i in range(5) for y in (18, 19, 20) for m in (1, 2, 3)]))
    seen = []
    inner = ledger.new_predictions
    monkeypatch.setattr(ledger, "new_predictions", lambda batch, existing, order: seen.append(existing) or inner(batch, existing, order))
    book.append(rows(spark, [("1", "2020-02-28", "m", "r2", "b", 0.9), ("9", "2020-03-28", "m", "r2", "b", 0.9)]))
    plan = plan_of(seen[0])
    assert "PartitionFilters: [" in plan and "2020-02" in plan and "2020-03" in plan and "2018" not in plan
    assert "probability" not in plan and "PushedFilters: []" in plan  # keys alone
    assert book.predictions().count() == 46 and book.predictions(["2020-03"]).count() == 6
    assert {r.probability for r in book.predictions().where("fund_id = '1'").collect()} == {0.1}


def test_equal_stamps_keep_one_copy_whatever_the_partitions(spark, tmp_path):
    copies = [("1", "2020-01-31", "m", f"r{i}", "2020-02-01T00:00:00", i / 10.0) for i in (3, 1, 2, 5)]
    got = set()
    for parts in (1, 4):
        book = store.LedgerStore(spark, str(tmp_path / f"l{parts}"))
        book.append(rows(spark, copies).repartition(parts))
        got.add(tuple((r.run_id, r.probability) for r in book.predictions().collect()))
    assert got == {(("r1", 0.1),)}


def test_compaction_rewrites_the_given_months_alone(spark, tmp_path):
    book = store.LedgerStore(spark, str(tmp_path / "ledger"))
    data = [("1", f"2020-0{m}-28", "m", f"r{i}", "a", 0.1) for m in (1, 2) for i in range(3)]
    book.load(rows(spark, data))
    book.load(rows(spark, data))
    book.compact(["2020-01"])
    assert book.predictions(["2020-01"]).count() == 1 and book.predictions(["2020-02"]).count() == 6
    assert book.members(["2020-01"]).count() == 4 and book.members(["2020-02"]).count() == 8


def test_cohort_id_follows_from_the_members_alone(spark):
    members = spark.createDataFrame([("a", c) for c in "4132"] + [("b", c) for c in "1234"] + [("c", c) for c in "123"] + [("d", "é")], "k string, fund_id string")
    got = {r.k: r.cohort_id for r in cohorts.cohort_ids(members.repartition(3), ["k"]).collect()}
    assert got["a"] == got["b"] != got["c"]
    lists = spark.createDataFrame([("a", list("1243")), ("c", list("321")), ("d", ["é"]), ("e", None), ("f", [])], "k string, codes array<string>")
    listed = {r.k: r.i for r in lists.select("k", cohorts.id_of_codes("codes").alias("i")).collect()}
    assert [listed[k] for k in "acd"] == [got[k] for k in "acd"] and listed["e"] is None and listed["f"] is not None


def test_an_added_fund_is_graded_like_a_member(spark):
    """The cohort with one fund more, from order statistics, against the list written out."""
    rng = random.Random(7)
    nav, due, lists = [], [], []
    for c in range(14):
        size = rng.randint(1, 9)
        codes = [f"{c}-{i}" for i in range(size)]
        for f in [*codes, f"{c}-new"]:
            nav.append((f, dt.date(2018, 1, 31), 100.0))
            if rng.random() < 0.9:
                nav.append((f, dt.date(2021, 1, 29), rng.choice([90.0, 100.0, 110.0, 120.0, 131.5])))
        due.append((f"{c}-new", "q1", "2018-01-31", "m", "r", "a", 0.5, 0.5, sorted([*codes, f"{c}-new"]), f"k{c}", f"{c}-new"))
        lists += [(f"k{c}", f) for f in codes]
    nav = spark.createDataFrame(nav, "fund_id string, dt date, nav double")
    rows_of = spark.createDataFrame(due, f"{SHAPE}, cohort_id string, cohort_added string")
    written = ledger.realize(rows_of.drop("cohort_id", "cohort_added"), nav)
    by_id = ledger.realize(rows_of.drop("cohort_codes"), nav, spark.createDataFrame(lists, "cohort_id string, fund_id string"))
    assert sorted(map(tuple, by_id.collect())) == sorted(map(tuple, written.collect()))
    shown = cohorts.with_codes(rows_of.drop("cohort_codes"), spark.createDataFrame(lists, "cohort_id string, fund_id string"))
    assert {r.fund_id: r.cohort_codes for r in shown.collect()} == {d[0]: d[8] for d in due}


def test_grading_twice_adds_nothing(spark, tmp_path):
    book = store.LedgerStore(spark, str(tmp_path / "ledger"))
    nav = spark.createDataFrame([(c, d, v) for i, c in enumerate("12345") for d, v in ((dt.date(2018, 1, 31), 100.0), (dt.date(2021, 1, 29), 100.0 + i))], "fund_id string, dt date, nav double")
    book.append(rows(spark, [(c, a, "m", "r", "a", 0.5) for c in "15" for a in ("2018-01-31", "2019-06-30")]))
    none, today = spark.createDataFrame([], "model_id string"), F.lit("2021-02-15").cast("date")
    first = book.grade(nav, today, none).collect()
    assert sorted((r.fund_id, r.anchor, r.status) for r in first) == [("1", "2018-01-31", "REALIZED"), ("5", "2018-01-31", "REALIZED")]
    assert book.grade(nav, today, none).count() == 0 and book.realizations().count() == 2
    due = F.col("anchor_month") <= F.date_format(F.add_months(today, -36), "yyyy-MM")
    assert "2018-02" in plan_of(book.predictions().where(due)).split("PartitionFilters")[1]


def test_corrupt_lines_are_skipped_anywhere(spark, tmp_path):
    good = {"fund_id": "1", "target": "q1", "anchor": "2020-01-31", "model_id": "m"}
    (tmp_path / "p.jsonl").write_text(json.dumps(good) + "\n{\"fund_id\": \"2\", \n" + json.dumps({**good, "fund_id": "3"}) + "\n")
    got = scans.ledger(spark, str(tmp_path / "p.jsonl"), SHAPE)
    assert sorted(r.fund_id for r in got.collect()) == ["1", "3"]
    assert scans.ledger(spark, str(tmp_path / "absent"), SHAPE).count() == 0


def test_retired_models(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"old": {"superseded_by": "new", "reason": "retrained"}}))
    assert scans.superseded_models(spark, str(tmp_path / "s.json")).first().model_id == "old"
    (tmp_path / "bad.json").write_text("not json")
    assert scans.superseded_models(spark, str(tmp_path / "bad.json")).count() == 0
    assert scans.superseded_models(spark, str(tmp_path / "none.json")).count() == 0


def test_realization_statuses(spark):
    nav = []
    for fund, end in (("1", 150.0), ("2", 120.0), ("3", 110.0), ("4", 105.0), ("5", 90.0)):
        nav += [(fund, dt.date(2018, 1, 31), 100.0), (fund, dt.date(2021, 1, 29), end)]
    nav += [("dead", dt.date(2018, 1, 31), 100.0)]
    nav = spark.createDataFrame(nav, "fund_id string, dt date, nav double")
    cohort = ["1", "2", "3", "4", "5", "dead"]
    data = [("1", cohort), ("5", cohort), ("dead", cohort), ("2", ["1", "2", "3", "gone"])]
    due = spark.createDataFrame([(f, "q1", "2018-01-31", "m", "r", "a", 0.5, 0.5, c) for f, c in data], SHAPE)
    got = {r.fund_id: (r.status, r.y_realized, r.n_peer_r_fwd) for r in ledger.realize(due, nav).collect()}
    assert got == {"1": ("REALIZED", True, 5), "5": ("REALIZED", False, 5), "dead": ("DEAD_OR_GAP", None, 5), "2": ("THIN_AT_REALIZATION", None, 3)}


def test_pending_honours_both_keys(spark):
    preds = rows(spark, [(f, "2018-01-31", m, "r", "a", 0.1) for f in "123" for m in ("m1", "m2")])
    done = spark.createDataFrame([("1", "q1", "2018-01-31", "m1"), ("2", "q1", "2018-01-31", None)], "fund_id string, target string, anchor string, model_id string")
    retired = spark.createDataFrame([("gone",)], "model_id string")
    left = sorted((r.fund_id, r.model_id) for r in ledger.pending(preds, done, retired).collect())
    assert left == [("1", "m2"), ("3", "m1"), ("3", "m2")]


def test_first_run_and_thin_overlap(spark):
    now = rows(spark, [("1", "2020-01-31", "m", "r2", "a", 0.1)])
    assert ledger.rank_stability(now, ledger.previous_run(now, "r2")).first().status == "FIRST_RUN"
    old = rows(spark, [("1", "2019-12-31", "m", "r1", "a", 0.2)])
    assert ledger.rank_stability(now, old).first().status == "INSUFFICIENT_OVERLAP"


def test_drift_null_and_shock(spark):
    base = spark.range(400).select((F.col("id") / 400.0).alias("a"), F.sin("id").alias("b"))
    ref = monitoring.psi_reference(base, ("a", "b"))
    same = monitoring.psi_live(base, ref, "m", "m", ("a", "b")).first()
    assert same.status == "OK" and same.psi_max < 0.02
    moved = monitoring.psi_live(base.withColumn("a", F.col("a") + 0.5), ref, "m", "m", ("a", "b")).first()
    assert moved.status == "SIGNIFICANT_SHIFT" and moved.worst[0] == "a"
    assert monitoring.psi_live(base.limit(40), ref, "m", "m", ("a", "b")).first().status == "INSUFFICIENT_DATA"
    assert monitoring.psi_live(base, ref, None, "m").first().status == "REFERENCE_MISSING"
    assert monitoring.psi_live(base, ref, "old", "m").first().status == "REFERENCE_STALE"


@pytest.mark.parametrize("grades,worst", [(("GREEN", "PENDING"), "GREEN"), (("PENDING", "UNAVAILABLE"), "PENDING"), (("AMBER", "RED"), "RED")])
def test_unmeasured_grades_never_worsen(spark, grades, worst):
    assert spark.range(1).select(monitoring.worst_grade(*[F.lit(g) for g in grades])).first()[0] == worst


def test_gates_fire(spark):
    df = spark.createDataFrame([("a", 0, 0, None), ("b", 10, 2, "2020-01-01"), ("c", 10, 1, "2020-01-25")], "b string, n_total int, n_errors int, last_anchor string")
    got = {(r.b, r.gate): r.passed for r in monitoring.batch_gates(df, 0.1, 10, F.lit("2020-01-31").cast("date")).collect()}
    assert not got[("a", "not_empty")] and not got[("b", "error_rate")] and not got[("b", "ledger_moving")]
    assert got[("c", "error_rate")] and got[("c", "ledger_moving")] and got[("a", "ledger_moving")]


def test_streams(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "ledger")
    data = [("1", dt.date(2020, 1, 1), 10.0), ("1", dt.date(2020, 1, 1), 10.0), ("1", dt.date(2020, 1, 2), 11.0)]
    spark.createDataFrame(data, ingest.NAV_SCHEMA).write.parquet(land)
    prices = str(tmp_path / "prices")
    for i in range(2):  # the second time with a checkpoint of its own: everything is replayed
        ingest.append_prices(ingest.nav_stream(spark, land), prices, str(tmp_path / f"p{i}")).awaitTermination(120)
        assert spark.read.parquet(prices).count() == 2
    late = [("2", dt.date(2015, 3, 2), 5.0), ("2", dt.date(2020, 1, 2), 6.0), ("1", dt.date(2020, 1, 2), 99.0)]
    spark.createDataFrame(late, ingest.NAV_SCHEMA).write.mode("append").parquet(land)
    for i in range(3):
        ingest.append_prices(ingest.nav_stream(spark, land), prices, str(tmp_path / f"p{i}")).awaitTermination(120)
        got = sorted((r.fund_id, str(r.dt), r.nav) for r in spark.read.parquet(prices).collect())
        assert got == [("1", "2020-01-01", 10.0), ("1", "2020-01-02", 11.0), ("2", "2015-03-02", 5.0), ("2", "2020-01-02", 6.0)]
    source = str(tmp_path / "preds")
    rows(spark, [("1", "2020-01-31", "m", "r", "a", 0.1), ("1", "2020-01-31", "m", "r", "b", 0.1)]).write.parquet(source)
    for i in range(2):
        stream = spark.readStream.schema(SHAPE).parquet(source)
        ingest.append_predictions(stream, out, str(tmp_path / f"cp{i}")).awaitTermination(120)
    assert store.LedgerStore(spark, out).predictions().count() == 1


def test_store_takes_over_rows_that_name_their_cohort_by_id(spark, tmp_path):
    lists = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "3"), ("unused", "4")], "cohort_id string, fund_id string")
    rows = spark.createDataFrame([("1", "t", "2020-01-31", "c"), ("2", "t", "2020-02-29", "c"), ("9", "t", "2020-02-29", None)], "fund_id string, target string, anchor string, cohort_id string")
    for _ in range(2):
        sinks.append_ledger(rows, f"{tmp_path}/rows", lists, f"{tmp_path}/members")
    book = store.LedgerStore(spark, f"{tmp_path}/book")
    book.load(scans.ledger(spark, f"{tmp_path}/rows", store.STORED), scans.cohort_members(spark, f"{tmp_path}/members"))
    assert book.predictions().count() == 6
    assert {(r.anchor_month, r.cohort_id, r.fund_id) for r in book.members().collect()} == {(m, "c", f) for m in ("2020-01", "2020-02") for f in "123"}
    assert book.members().count() == 6


def test_derived_predictions_hold_no_lists(spark, sf):
    """A list of the whole cohort in each row grows with the square of the funds."""
    from navstead.plans import ledger_queries

    rows, members = ledger_queries.predictions(spark, sf), ledger_queries.cohort_members(spark, sf)
    assert not [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map")]
    assert members.count() == members.select("fund_id").distinct().count()
    assert rows.join(members, ["cohort_id", "fund_id"], "left_anti").isEmpty()


def test_the_sum_of_no_inner_edges_is_missing(spark):
    values = spark.createDataFrame([(float(i % 2), float(i)) for i in range(40)], "few double, many double")
    edges = monitoring.bin_edges(values.unionByName(values.select(F.lit(1.0).alias("few"), "many")), ["few", "many"])
    got = {r.feature: (len(r.edges), r.total) for r in edges.select("feature", "edges", monitoring.inner_sum("edges").alias("total")).collect()}
    assert got["few"] == (2, None) and got["many"][0] == 11 and abs(got["many"][1] - 9 * 19.5) < 1e-9
