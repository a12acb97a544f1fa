"""Point-in-time operators: one fixture row per branch."""

import datetime as dt

from pyspark.sql import functions as F

from pitspark.operators import pit

D = dt.date


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), "firm int, fpe date, t date")


CELL = (1, D(2024, 3, 31), D(2024, 4, 20))
EST = "row_id long, firm int, fpe date, analyst string, anndats date, revdats date, value double"


def est(row_id, analyst, ann, rev, value, fpe=CELL[1], firm=1):
    return (row_id, firm, fpe, analyst, ann, rev, value)


def test_fundamentals_stop_at_first_row_not_yet_known(spark):
    base = D(2024, 1, 1)
    rows = [(1, D(2023, 3, 31), base + dt.timedelta(40), 1.0), (1, D(2023, 6, 30), base + dt.timedelta(90), 2.0), (1, D(2023, 9, 30), base + dt.timedelta(60), 3.0)]
    fundq = spark.createDataFrame(rows, "firm int, datadate date, rdq date, saleq double")
    for days, want in ((30, None), (70, 1.0), (90, 3.0)):
        got = pit.asof_fundamentals(cells(spark, (1, CELL[1], base + dt.timedelta(days))), fundq, ["saleq"]).collect()
        assert [r.saleq for r in got] == [want]


def test_fundamentals_without_announcement_use_period_end(spark):
    fundq = spark.createDataFrame([(1, D(2024, 3, 31), None, 5.0)], "firm int, datadate date, rdq date, saleq double")
    assert pit.asof_fundamentals(cells(spark, CELL), fundq, ["saleq"]).first().saleq == 5.0


def test_estimate_branches(spark):
    t = CELL[2]
    early, late = D(2024, 3, 1), t + dt.timedelta(1)
    rows = [
        est(1, "same", early, early, 1.0), est(2, "gone", early, t, 2.0), est(3, "later", early, late, 3.0), est(4, "never", early, None, 4.0), est(5, "future", late, None, 5.0),
        est(7, "two", early, None, 7.0), est(6, "two", early, None, 6.0), est(8, "", early, None, 8.0), est(9, None, D(2024, 3, 2), None, 9.0), est(10, "other", early, None, 1.0, fpe=D(2024, 6, 30)),
    ]
    active = pit.active_estimates(spark.createDataFrame(rows, EST), cells(spark, CELL))
    assert sorted(r.row_id for r in active.collect()) == [1, 3, 4, 6, 7, 8, 9]
    latest = {r.analyst: r.value for r in pit.latest_per_analyst(active).collect()}
    assert latest == {"same": 1.0, "later": 3.0, "never": 4.0, "two": 6.0, "": 9.0}


def test_consensus_of_none_one_and_two(spark):
    e = spark.createDataFrame([est(1, "a", D(2024, 3, 1), None, 10.0), est(2, "a", D(2024, 3, 1), None, 10.0, firm=2), est(3, "b", D(2024, 3, 1), None, 20.0, firm=2)], EST)
    got = {r.firm: r for r in pit.consensus_at(e, cells(spark, CELL, (2, *CELL[1:]), (3, *CELL[1:]))).collect()}
    assert (got[3].n_analysts, got[3].median_value, got[3].dispersion) == (0, None, None)
    assert (got[1].n_analysts, got[1].median_value, got[1].dispersion) == (1, 10.0, 0.0)
    assert (got[2].n_analysts, got[2].median_value, got[2].mean_value) == (2, 15.0, 15.0)
    assert abs(got[2].dispersion - 50 ** 0.5) < 1e-12


def test_rows_after_t_change_nothing(spark):
    known = [est(1, "a", D(2024, 3, 1), None, 10.0), est(2, "b", D(2024, 3, 5), D(2024, 5, 1), 30.0)]
    future = [est(90 + i, f"x{i}", CELL[2] + dt.timedelta(1 + i), None, 1e6) for i in range(20)]
    one, both = (pit.consensus_at(spark.createDataFrame(r, EST), cells(spark, CELL)).collect() for r in (known, known + future))
    assert one == both


def test_previous_event(spark):
    e = spark.createDataFrame([(1, D(2024, 3, 31), D(2024, 5, 1)), (1, D(2024, 6, 30), D(2024, 8, 1))], "firm int, fpe date, ed date")
    assert {r.fpe: r.prev_ed for r in pit.previous_event(e).collect()} == {D(2024, 3, 31): D(2024, 2, 1), D(2024, 6, 30): D(2024, 5, 1)}


def test_window_average(spark):
    s = spark.createDataFrame([(D(2024, 4, 1), 10.0), (D(2024, 4, 20), 20.0), (D(2024, 4, 21), 999.0)], "d date, v double")
    c = cells(spark, CELL, (2, CELL[1], D(2020, 1, 1)))
    got = pit.window_average(c, s, F.date_sub("t", 19), F.col("t"), "v", "avg", 70.0)
    assert {r.firm: r.avg for r in got.collect()} == {1: 15.0, 2: 70.0}


def test_masking_hides_later_filings(spark):
    p = spark.createDataFrame([(1, 1, D(2024, 1, 1), D(2024, 4, 20), D(2024, 4, 21)), (2, 1, D(2024, 4, 21), None, None)], "pad_id long, firm int, permit_date date, spud_date date, completion_date date")
    got = pit.mask_permits(p, cells(spark, CELL)).collect()
    assert [(r.pad_id, r.spud_date, r.completion_date) for r in got] == [(1, D(2024, 4, 20), None)]


def test_market_cap_of_an_unparseable_last_row_is_null(spark):
    p = spark.createDataFrame([(1, D(2024, 4, 1), 10.0, 5.0), (1, D(2024, 4, 10), None, 5.0)], "firm int, d date, close double, shrout double")
    assert pit.market_cap_asof(cells(spark, CELL), p).first().market_cap is None
    assert pit.market_cap_asof(cells(spark, (1, CELL[1], D(2024, 4, 5))), p).first().market_cap == 50_000.0


def test_first_actual_date(spark):
    e = spark.createDataFrame([(1, CELL[1], "2024-05-10"), (1, CELL[1], " 2024-05-02 "), (1, CELL[1], ""), (2, CELL[1], "soon")], "firm int, fpe date, anndats_act string")
    assert [(r.firm, r.ed, r.t) for r in pit.first_actual_date(e).collect()] == [(1, D(2024, 5, 2), D(2024, 4, 18))]
