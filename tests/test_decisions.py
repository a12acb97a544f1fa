"""Forecast, divergence, gate, sizing, verdicts and signals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import scoring
from pitspark.operators import forecast, quality, signals

D = dt.date
Q, T = D(2024, 3, 31), D(2024, 4, 20)


def inputs(spark, **change):
    row = {"ticker": "FANG", "n_analysts": 3, "median_value": 100.0, "dispersion": 1.0, "signal": 2.0, "n_new": 1, "n_cont": 1, "oil_avg": 80.0} | change
    return spark.createDataFrame([row], "ticker string, n_analysts long, median_value double, dispersion double, signal double, n_new long, n_cont long, oil_avg double")


def test_anchored_forecast_clips_the_signal(spark):
    r = forecast.forecast(inputs(spark), 0.10).first()
    assert (r.mode, round(r.forecast, 3)) == ("consensus_anchored", 110e6)
    assert abs(r.production - 110e6 / (91 * 80.0 * 0.93)) < 1e-6
    assert forecast.forecast(inputs(spark, signal=-5.0), 0.10).first().forecast == pytest.approx(90e6)
    assert forecast.forecast(inputs(spark, oil_avg=0.0), 0.10).first().production == 0.0


def test_structural_forecast_without_coverage(spark):
    r = forecast.forecast(inputs(spark, n_analysts=0, median_value=None, ticker="EOG")).first()
    production = 1_000_000 * 0.92 + 2 * 5.5 * 800
    assert (r.mode, r.production) == ("structural", production)
    assert r.forecast == pytest.approx(production * 91 * 80.0 * 0.95 / 0.45)


@pytest.mark.parametrize("pct,cls", [(15.0, "modest_beat"), (15.01, "strong_beat"), (5.0, "in_line"), (5.004, "modest_beat"), (-5.0, "in_line"), (-5.01, "modest_miss"), (-15.0, "modest_miss"), (-15.01, "strong_miss"), (None, "in_line")])
def test_divergence_class(spark, pct, cls):
    assert spark.range(1).select(scoring.divergence_class(F.lit(pct).cast("double")).alias("c")).first().c == cls


def test_confidence(spark):
    rows = [(10, 2.9, 100.0, "high"), (10, 3.0, 100.0, "medium"), (9, 0.1, 100.0, "medium"), (5, 0.0, 100.0, "medium"), (4, 0.0, 100.0, "low"), (12, 0.0, -1.0, "medium")]
    df = spark.createDataFrame(rows, "n long, s double, c double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", scoring.confidence_tier(F.col("n"), F.col("s"), F.col("c"))).collect())


def test_alpha_zero_never_trades(spark):
    scored = forecast.divergence(forecast.forecast(inputs(spark), 0.0))
    passing, stopped = forecast.gate(scored)
    assert passing.count() == 0
    assert stopped.select("decision", "size", "reason").collect() == [("no_trade", 0.0, "short_circuit_in_line")]


def test_class_from_unrounded_percentage_passes_the_check(spark):
    df = spark.createDataFrame([(1, 5.0, "modest_beat"), (2, 5.0, "in_line"), (3, 5.1, "in_line"), (4, None, None)], "id int, divergence_pct double, divergence_class string")
    assert sorted(r.id for r in quality.divergence_violations(df, ["id"]).collect()) == [3, 4]


def test_verdicts(spark):
    rows = [(" Long ", "STRONG", 1.5, ["a", "b", "c", "d"], "x" * 4000), ("buy", "med", -1.0, None, None), ("sell", "high", None, [], "r"), (None, None, 0.5, ["a"], "r"), ("long", "odd", 0.5, ["a"], "r")]
    df = spark.createDataFrame(rows, "decision string, conviction_tier string, weight double, evidence array<string>, reasoning string")
    got = forecast.size_position(forecast.normalize_verdicts(df)).collect()
    assert [(r.decision, r.conviction_tier, r.size, r.weight) for r in got] == [("long", "high", 0.15, 1.0), ("long", "medium", 0.10, 0.0), ("no_trade", "none", 0.0, 0.0), ("no_trade", "none", 0.0, 0.5), ("no_trade", "none", 0.0, 0.5)]
    assert got[0].evidence == ["a", "b", "c"] and len(got[0].reasoning) == 3000 and got[1].evidence == [] and got[1].reasoning == "(no reasoning returned)"


@pytest.mark.parametrize("decision,tier,size,bad", [("long", "high", 0.15, []), ("long", "high", 0.07, ["long_matches_tier", "size_locked"]), ("long", "high", 0.05, ["long_matches_tier"]), ("no_trade", "high", 0.05, ["no_trade_is_flat"]), ("no_trade", "high", 0.0, [])])
def test_size_lock(spark, decision, tier, size, bad):
    df = spark.createDataFrame([(1, decision, tier, size)], "id int, decision string, conviction_tier string, size double")
    assert sorted(r.rule for r in quality.size_violations(df, ["id"]).collect()) == bad


def test_activity_rules(spark):
    rows = [(1, 4, 18, 8, 22, 22 / 30), (2, 4, 18, 8, 99, 22 / 30), (3, 0, 0, 0, 0, 0.0), (4, -1, 1, 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "id int, n_new long, n_cont long, n_idle long, absolute_active long, share_active double")
    pads = spark.createDataFrame([(1, s) for s, n in (("newly_active", 4), ("continuously_active", 18), ("idle", 8)) for _ in range(n)], "id int, state string")
    got = quality.activity_violations(df, ["id"], pads).collect()
    assert sorted((r.id, r.rule) for r in got) == [(2, "active_is_sum"), (4, "counts_non_negative")]


def test_downgrade_and_cap(spark):
    assert [spark.range(1).select(scoring.downgraded(F.lit(t)).alias("x")).first().x for t in params.TIER_SIZE] == ["medium", "low", "none", "none"]
    df = spark.createDataFrame([(i, Q, "long", "low" if i < 9 else "high", float(i)) for i in range(10)], "firm int, fpe date, decision string, conviction_tier string, divergence_pct double")
    assert [r.firm for r in forecast.cap_concurrent(df).orderBy("slot").collect()] == [9, 8, 7, 6, 5, 4, 3, 2]


def test_zscore_of_one_firm_and_without_spread(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 3.0), (3, 1.0), (3, 3.0)], "t int, x double")
    assert sorted((r.t, r.z_x) for r in signals.zscore_by(df, ["t"], ["x"]).collect()) == [(1, 0.0), (2, 0.0), (2, 0.0), (3, -1.0), (3, 1.0)]


def fundamentals(spark, *rows):
    cols = ["oibdpq", "niq", "oancfy", "capxy", "ceqq", "dlttq", "dlcq", "cheq", "saleq"]
    data = [(f, D(2023, 12, 31), D(2024, 2, 1), *[r.get(c) for c in cols]) for f, r in rows]
    return spark.createDataFrame(data, "firm int, datadate date, rdq date, " + ", ".join(f"{c} double" for c in cols))


def test_value_needs_two_firms_and_positive_inputs(spark):
    full = {"oibdpq": 10.0, "niq": 1.0, "ceqq": 100.0, "saleq": 50.0}
    f = fundamentals(spark, (1, full), (2, full | {"ceqq": -5.0}), (3, full | {"oibdpq": 0.0}))
    prices = spark.createDataFrame([(i, D(2024, 4, 1), 20.0) for i in (1, 2, 3, 4)], "firm int, d date, px double")
    panel = spark.createDataFrame([(i, i, 100.0, T) for i in (1, 2, 3, 4)], "firm int, idx int, shares double, t date")
    one = signals.value_inputs(panel, f, prices)
    assert [r.firm for r in one.collect()] == [1]
    assert signals.composite(one, signals.VALUE_COLS, "s").count() == 0
    row = one.first()
    assert (row.neg_pb, row.fcf_yield) == (-20.0, 0.0) and row.neg_ev_ebitda == pytest.approx(-2e9 / 40e6)
    assert sorted(r.firm for r in signals.quality_inputs(panel, f).collect()) == [1, 3]


def test_ties_keep_universe_order(spark):
    df = spark.createDataFrame([(i, i, T, 1.0 if i >= 2 else 2.0) for i in range(8)], "firm int, idx int, t date, s double")
    assert sorted(r.firm for r in signals.top_n_by(df, ["t"], "s", 4).collect()) == [0, 1, 2, 3]


def test_buy_hold_falls_back_to_first_and_last(spark):
    s = spark.createDataFrame([(D(2021, 3, 1), 10.0), (D(2021, 6, 1), 12.0)], "d date, px double")
    r = signals.buy_hold(s, F.to_date(F.lit("2021-01-04")), F.to_date(F.lit("2025-12-31"))).first()
    assert (round(r.gross_return, 9), round(r.net_return, 9)) == (0.2, 0.197)
