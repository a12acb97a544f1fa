"""Ledger, equity, resampling, tests and constraints."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import audit, ledger, quality, resample

D = dt.date


@pytest.mark.parametrize("entry,exit_,size,net", [(100.0, 105.0, 0.10, 4700.0), (100.0, 105.0, 0.0, 0.0), (100.0, 98.0, 0.15, -3450.0)])
def test_trade_pnl(spark, entry, exit_, size, net):
    r = ledger.trade_pnl(spark.createDataFrame([(entry, exit_, size)], "entry_price double, exit_price double, size double")).first()
    assert r.net_pnl == pytest.approx(net)
    assert r.cost == pytest.approx(1e6 * size * 0.003)


def ledger_rows(n=400, seed=5):
    r = random.Random(seed)
    return [("s", r.randint(0, 30), D(2020, 3, 31), D(2020, 1, 1) + dt.timedelta(r.randint(0, 60)), r.gauss(0.01, 0.2), i) for i in range(n)]


def trades(spark, rows):
    return spark.createDataFrame(rows, "strategy string, firm int, fpe date, entry_date date, net_return double, id int")


def test_equity_starts_its_peak_at_the_first_point(spark):
    rows = [("s", 1, D(2020, 3, 31), D(2020, 1, 1), -0.10, 0), ("s", 1, D(2020, 6, 30), D(2020, 4, 1), 0.10, 1)]
    got = ledger.equity_curve(trades(spark, rows)).orderBy("entry_date").collect()
    assert [round(r.growth, 9) for r in got] == [0.90, 0.99]
    assert ledger.strategy_metrics(trades(spark, rows)).first().max_drawdown == 0.0


def test_equity_matches_cumulative_product_with_total_losses(spark):
    rows = [r for r in {(x[1], x[3]): x for x in ledger_rows()}.values()]
    rows[10] = (*rows[10][:4], -1.5, rows[10][5])
    for zero_at in (None, 40):
        data = [(*x[:4], -1.0, x[5]) if zero_at is not None and i == zero_at else x for i, x in enumerate(rows)]
        order = sorted(data, key=lambda x: (x[3], x[1]))
        growth = np.cumprod([1 + x[4] for x in order])
        peak = np.maximum.accumulate(growth)
        got = {r.id: r for r in ledger.equity_curve(trades(spark, data).repartition(5)).collect()}
        assert np.allclose([got[x[5]].growth for x in order], growth)
        assert np.allclose([got[x[5]].running_max for x in order], peak)


def test_metrics_of_one_trade(spark):
    m = ledger.strategy_metrics(trades(spark, ledger_rows(1))).first()
    assert m.n_trades == 1 and m.sharpe is None


def test_step_equity_counts_exits_up_to_the_day(spark):
    t = spark.createDataFrame([("s", D(2020, 1, 5), 10.0), ("s", D(2020, 1, 5), 5.0), ("s", D(2020, 1, 7), -3.0)], "strategy string, exit_date date, net_pnl double")
    grid = spark.createDataFrame([("s", D(2020, 1, d)) for d in (4, 5, 6, 7)], "strategy string, d date")
    assert [r.value for r in ledger.step_equity(t, grid, ["strategy"], 100.0).orderBy("d").collect()] == [100.0, 115.0, 115.0, 112.0]


def test_bootstrap_draws_whole_clusters(spark):
    t = trades(spark, ledger_rows())
    reps = resample.replicate_stats(t, "firm", 300, 7).collect()
    assert len(reps) == 300
    obs = np.mean([r[4] > 0 for r in ledger_rows()])
    rates = [r.hit_rate for r in reps]
    assert abs(np.mean(rates) - obs) < 0.02 and 0.005 < np.std(rates) < 0.1
    again = resample.replicate_stats(t.repartition(11, "entry_date"), "firm", 300, 7).collect()
    assert sorted((r.rep, round(r.hit_rate, 12)) for r in reps) == sorted((r.rep, round(r.hit_rate, 12)) for r in again)


def test_bootstrap_replicate_by_hand(spark):
    """Rebuild each replicate in plain Python from the same draws."""
    import hashlib

    rows = ledger_rows(60)
    firms = sorted({r[1] for r in rows}, key=lambda f: (hashlib.md5(str(f).encode()).hexdigest()[:2], f))
    got = {r.rep: r for r in resample.replicate_stats(trades(spark, rows), "firm", 20, 0).collect()}
    for rep in range(20):
        picks = [firms[int(hashlib.md5(f"0|{rep}|{s}".encode()).hexdigest()[:15], 16) % len(firms)] for s in range(len(firms))]
        sample = np.array([x[4] for f in picks for x in rows if x[1] == f])
        assert got[rep].hit_rate == pytest.approx((sample > 0).mean())
        assert got[rep].mean_return == pytest.approx(sample.mean())
        assert got[rep].sharpe == pytest.approx(sample.mean() / sample.std(ddof=1))


def test_primary_test_rejects_only_a_clear_edge(spark):
    rows = [(*r[:4], 0.1 if r[5] % 10 < 9 else -0.1, r[5]) for r in ledger_rows()]
    assert resample.primary_test(trades(spark, rows), "firm", 200).first().reject
    rows = [(*r[:4], 0.1 if r[5] % 2 else -0.1, r[5]) for r in ledger_rows()]
    p = resample.primary_test(trades(spark, rows), "firm", 200).first()
    assert not p.reject and p.p_value > 0.2


def test_block_diff_skips_replicates_with_an_empty_side(spark):
    rows = ledger_rows(40)
    a = trades(spark, [(*r[:2], D(2020, 3, 31) if i % 2 else D(2020, 6, 30), *r[3:]) for i, r in enumerate(rows)])
    b = trades(spark, [(*r[:2], D(2020, 9, 30), *r[3:]) for r in rows])
    got = resample.block_diff_test(a, b, n_iter=300).first()
    assert 0 < got.n_iter < 300


@pytest.mark.parametrize("k,n", [(5, 10), (0, 10), (10, 10), (11, 20), (5001, 9000)])
def test_binomial_tail(spark, k, n):
    exact = sum(math.comb(n, i) for i in range(k, n + 1)) / 2 ** n
    got = resample.binomial_tail(spark.createDataFrame([(1, k, n)], "id int, k long, n long"), ["id"], "k", "n").first().p_exact
    assert got == pytest.approx(exact, rel=1e-9)


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "family string, test int, p double")
    got = {r.test: round(r.p_adjusted, 9) for r in resample.holm_bonferroni(df, ["family"]).collect()}
    assert got == {3: 0.02, 0: 0.03, 2: 0.06, 1: 0.06}


def test_shuffle_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").alias("pad_id"), (F.col("id") * 2.0).alias("lat"))
    got = resample.placebo_shuffle(df, "pad_id", ["lat"]).collect()
    assert sorted(r.lat for r in got) == [i * 2.0 for i in range(500)]
    assert all(r.lat == r.donor * 2.0 for r in got) and sum(r.donor == r.pad_id for r in got) < 10


@pytest.mark.parametrize("width", [2, 3])
def test_residual_alpha_matches_numpy(spark, width):
    rng = np.random.default_rng(0)
    n, lags = 40, 4
    x = rng.normal(size=(n, width))
    y = 0.3 + x @ np.arange(1, width + 1) + rng.normal(size=n) * 0.5
    xs = [f"x{i}" for i in range(width)]
    df = spark.createDataFrame([(1, i, float(y[i]), *map(float, x[i])) for i in range(n)], "g int, o int, y double, " + ", ".join(f"{c} double" for c in xs))
    got = resample.residual_alpha(df, ["g"], "o", "y", xs).first()
    full = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(full.T @ full)
    beta = inv @ full.T @ y
    score = full * (y - full @ beta)[:, None]
    meat = score.T @ score
    for lag in range(1, lags + 1):
        g = score[lag:].T @ score[:-lag]
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    se = np.sqrt((inv @ meat @ inv)[0, 0])
    assert np.allclose([got.alpha, got.t_stat, got.beta_x0], [beta[0], beta[0] / se, beta[1]])


def test_field_agreement(spark):
    rows = [(1, "long", ["a", "b"]), (1, "long", ["b", "a"]), (2, "long", ["a"]), (2, None, ["a"]), (3, None, ["a"]), (3, None, ["b"])]
    got = {r.k: (r.d_match, r.e_match, r.passed) for r in resample.field_agreement(spark.createDataFrame(rows, "k int, d string, e array<string>"), ["k"], ["d", "e"]).collect()}
    assert got == {1: (True, True, True), 2: (False, True, False), 3: (True, False, False)}


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"))
    one = quality.table_fingerprint(df, "t").collect()
    assert one == quality.table_fingerprint(df.repartition(13, "s"), "t").collect()
    assert one != quality.table_fingerprint(df.withColumn("s", F.when(F.col("id") == 5, "x").otherwise(F.col("s"))), "t").collect()


def test_completeness(spark):
    cells = spark.createDataFrame([(i,) for i in range(5)], "firm int")
    out = [(f, s, not (f == 1 and s == 2), "boom" if f == 2 and s == 0 else "") for f in range(4) for s in range(5) if not (f == 3 and s == 4)]
    got = quality.completeness(cells, spark.createDataFrame(out, "firm int, stage int, valid boolean, error string"), cells, ["firm"])
    assert {r.firm: r.complete for r in got.collect()} == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_eligibility_reasons_in_order(spark):
    cells = spark.createDataFrame([(1, D(2024, 3, 31), D(2024, 4, 20)), (2, D(2024, 3, 31), D(2024, 4, 20))], "firm int, fpe date, t date")
    prices = spark.createDataFrame([(1, D(2024, 1, 1), 100.0, 10_000.0)], "firm int, d date, close double, shrout double")
    fraction = spark.createDataFrame([(1, 2023, 0.3)], "firm int, fiscal_year int, fraction double")
    coverage = spark.createDataFrame([(1, D(2024, 3, 31), 3)], "firm int, fpe date, n_analysts long")
    got = {r.firm: (r.eligible, r.drop_reason) for r in audit.eligibility_panel(cells, prices, fraction, coverage).collect()}
    assert got == {1: (True, None), 2: (False, "not_listed;low_market_cap;low_permian_fraction;thin_coverage")}
