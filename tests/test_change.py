"""Change detection, sampling and activity: one fixture per branch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitspark import params
from pitspark.operators import change

D = dt.date
Q, T = D(2024, 9, 30), D(2024, 10, 20)


def pad_cells(spark, *rows):
    return spark.createDataFrame([(p, 1, Q, T, c) for p, c in rows], "pad_id long, firm int, fpe date, t date, completion_date date")


def obs(spark, *rows):
    return spark.createDataFrame([(p, d, v) for p, d, v in rows], "pad_id long, acq date, vv_db double")


def test_rise_branches(spark):
    base, cur, recent = D(2024, 1, 15), D(2024, 8, 1), D(2023, 6, 1)
    rows = [(2, cur, -8.0), (3, cur, -8.0), (9, base, -10.0)]
    for pad, delta in ((4, 1.5), (5, 1.49), (6, 0.5), (7, 0.49), (8, 1.5)):
        rows += [(pad, base, -10.0), (pad, cur, -10.0 + delta)]
    cells = pad_cells(spark, (1, recent), (2, recent), (3, None), (4, None), (5, None), (6, recent), (7, recent), (8, recent), (9, recent))
    got = {r.pad_id: r.state for r in change.classify_rise(obs(spark, *rows), cells).collect()}
    assert got == {1: "idle", 2: "continuously_active", 3: "idle", 4: "newly_active", 5: "idle", 6: "continuously_active", 7: "idle", 8: "continuously_active", 9: "idle"}


def test_rise_ignores_observations_after_t(spark):
    cells = spark.createDataFrame([(1, 1, Q, D(2024, 8, 1), None)], "pad_id long, firm int, fpe date, t date, completion_date date")
    seen = [(1, D(2024, 1, 1), -10.0), (1, D(2024, 7, 20), -10.0)]
    later = seen + [(1, D(2024, 8, 2), 50.0)]
    assert change.classify_rise(obs(spark, *seen), cells).collect() == change.classify_rise(obs(spark, *later), cells).collect()


@pytest.mark.parametrize("current,state", [(-13.0, "newly_active"), (-11.5, "continuously_active"), (-10.1, "idle"), (-13.5, "newly_active")])
def test_drop_thresholds(spark, current, state):
    rows = [(1, D(2024, 4, 10), -10.0), (1, D(2024, 7, 10), current)]
    df = spark.createDataFrame(rows, "pad_id long, published date, vv_db double")
    got = change.classify_drop(df, pad_cells(spark, (1, None))).first()
    assert (got.state, round(got.change_db, 9), got.n_obs, got.notes) == (state, round(current + 10, 9), 1, "")


def test_drop_uses_upper_median_and_reports_gaps(spark):
    rows = [(1, D(2024, 4, 10), 0.0)] + [(1, D(2024, 7, 1 + i), v) for i, v in enumerate([4.0, 1.0, 3.0, 2.0])] + [(2, D(2024, 7, 5), 1.0)]
    df = spark.createDataFrame(rows, "pad_id long, published date, vv_db double")
    got = {r.pad_id: r for r in change.classify_drop(df, pad_cells(spark, (1, None), (2, None))).collect()}
    assert got[1].change_db == 3.0
    assert (got[2].state, got[2].change_db, got[2].n_obs, got[2].notes) == ("idle", 0.0, 1, "insufficient observations")


@pytest.mark.parametrize("q,spud,done,state", [
    (D(2024, 3, 31), D(2024, 2, 15), None, "newly_active"),
    (D(2024, 9, 30), None, D(2019, 6, 30), "idle"),
    (D(2024, 9, 30), D(2023, 8, 1), D(2024, 1, 15), "continuously_active"),
    (D(2024, 9, 30), None, D(2022, 9, 1), "continuously_active"),
    (D(2024, 9, 30), None, D(2022, 8, 31), "idle"),
    (D(2024, 9, 30), None, D(2024, 7, 1), "idle"),
])
def test_truth_state(spark, q, spud, done, state):
    df = spark.createDataFrame([(q, spud, done)], "fpe date, spud_date date, completion_date date")
    assert change.truth_state(df).first().truth == state


def test_round_robin_deals_in_turn(spark):
    recent = [(f"r{i}", 1, D(2022, 1, 1), None, D(2024, 1, 1)) for i in range(1, 6)]
    active = [("a1", 1, D(2024, 8, 1), None, None)]
    p = spark.createDataFrame(active + recent, "pad_id string, firm int, permit_date date, spud_date date, completion_date date")
    cells = spark.createDataFrame([(1, Q, T)], "firm int, fpe date, t date")
    assert [r.pad_id for r in change.sample_pads(p, cells, 5).orderBy("deal").collect()] == ["a1", "r1", "r2", "r3", "r4"]


def test_history_fallback(spark):
    act = spark.createDataFrame([(1, Q, T, 3, 5)], "firm int, fpe date, t date, absolute_active long, total_monitored long")
    row = change.relative_activity(change.trailing_from_history(act)).first()
    assert (row.trailing_avg, row.relative_delta, row.signal) == (1.5, 1.5, 1.0)


def test_label_noise_recall_and_stability(spark):
    df = spark.range(6000).select(F.col("id").alias("pad_id"), F.lit(1).alias("firm"), F.lit(Q).alias("fpe"), F.when(F.col("id") % 10 < 2, "newly_active").when(F.col("id") % 10 < 5, "continuously_active").otherwise("idle").alias("truth"))
    one = change.apply_confusion(df)
    report = {r.truth: r for r in change.confusion_report(one).collect()}
    assert abs(report["newly_active"].recall - 0.78) < 0.05
    for state, rates in params.CONFUSION["target"].items():
        got = report[state]
        expected = [got.n * p for p in rates]
        chi2 = sum((o - e) ** 2 / e for o, e in zip((got.newly_active, got.continuously_active, got.idle), expected))
        assert chi2 < 13.8, (state, chi2)
    again = change.apply_confusion(df.repartition(7, "truth"))
    assert sorted(one.select("pad_id", "observed").collect()) == sorted(again.select("pad_id", "observed").collect())


def test_rollup_of_a_firm_without_pads(spark):
    cells = spark.createDataFrame([(1, Q, T), (2, Q, T)], "firm int, fpe date, t date")
    pads = spark.createDataFrame([(1, Q, T, "newly_active"), (1, Q, T, "idle")], "firm int, fpe date, t date, state string")
    got = {r.firm: (r.n_new, r.n_idle, r.absolute_active, r.share_active, r.total_monitored) for r in change.rollup_firm_quarter(pads, cells).collect()}
    assert got == {1: (1, 1, 1, 0.5, 2), 2: (0, 0, 0, 0.0, 0)}


def test_match_events_keeps_first_in_source_order(spark):
    pred = spark.createDataFrame([(1, Q, "newly_active"), (2, Q, "newly_active"), (3, Q, "idle"), (4, Q, "idle")], "pad_id long, fpe date, state string")
    truth = spark.createDataFrame([(1, D(2024, 10, 30), 0), (1, D(2024, 7, 1), 1), (2, D(2024, 10, 31), 2), (3, D(2024, 6, 30), 3)], "pad_id long, event_date date, row_id long")
    m = change.match_events(pred, truth)
    assert {r.pad_id: (r.event_date, r.matched) for r in m.collect()} == {1: (D(2024, 10, 30), True), 2: (None, False), 3: (D(2024, 6, 30), False), 4: (None, True)}
    s = change.validation_summary(m).first()
    assert (s.tp, s.fp, s.fn, s.precision, s.recall, s.passes) == (1, 1, 1, 0.5, 0.5, False)
