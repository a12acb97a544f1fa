"""Scans in range blocks: a third of all rows on one key and day stay spread, and results are those of one sort."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import core, ledger, resample

D = dt.date


@pytest.fixture
def many_blocks(spark):
    """Small inputs in as many blocks as a large one would have."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_trades(n=6_000):
    """A third of all trades belong to one strategy and day."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        day = D(2020, 3, 2) if hot else D(2020, 1, 1) + dt.timedelta(days=rng.randrange(300))
        rows.append((1 if hot else rng.randrange(4), f"firm{i:05d}", D(2020, 3, 31), day, day, rng.uniform(-0.05, 0.05), 1.0))
    return rows


SCHEMA = "strategy int, firm string, fpe date, entry_date date, exit_date date, net_return double, net_pnl double"


def test_crowded_day_is_spread_over_blocks(spark, many_blocks):
    trades = spark.createDataFrame(hot_trades(), SCHEMA).repartition(8)
    blocks = core.range_blocks(trades, ["strategy", "entry_date", "firm", "fpe"])
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 6_000 and max(sizes) < 2.5 * 6_000 / 16
    hot = blocks.where("strategy = 1 AND entry_date = DATE '2020-03-02'").select("_block").distinct().count()
    assert hot >= 5


def test_equity_curve_over_blocks_matches_one_sort(spark, many_blocks):
    rows = hot_trades(3_000)
    got = {(r.strategy, r.firm): (r.growth, r.running_max, r.drawdown) for r in ledger.equity_curve(spark.createDataFrame(rows, SCHEMA)).collect()}
    for s in range(4):
        growth, peak = 1.0, -math.inf
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1], r[2])):
            growth *= 1 + r[5]
            peak = max(peak, growth)
            assert got[s, r[1]] == pytest.approx((growth, peak, (growth - peak) / peak), rel=1e-9, abs=1e-12)


def test_holm_with_equal_and_missing_values(spark, many_blocks):
    rng = random.Random(6)
    rows = [("f", i, 0.99 if i % 3 == 0 else None if i % 50 == 1 else rng.random() ** 4) for i in range(900)] + [("g", 1, None), ("h", 1, 0.2)]
    got = {(r.family, r.test): r.p_adjusted for r in resample.holm_bonferroni(spark.createDataFrame(rows, "family string, test int, p double"), ["family"]).collect()}
    for family in "fgh":
        own = sorted((p, t) for f, t, p in rows if f == family and p is not None)
        high = 0.0
        for k, (p, t) in enumerate(own):
            rank = next(j for j, (q, _) in enumerate(own) if q == p)
            high = max(high, min(1.0, (len(own) - rank) * p))
            assert got[family, t] == pytest.approx(high)
        assert all(got[f, t] is None for f, t, p in rows if f == family and p is None)


def test_numbering_is_dense_and_in_order(spark, many_blocks):
    df = spark.range(3_000).select((F.col("id") % 3 == 0).alias("g"), F.col("id").alias("item"))
    rows = core.dense_index(df, ["g"], "item").collect()
    for g in (True, False):
        assert sorted(r.idx for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))


def test_residual_alpha_with_large_means_and_without_solution(spark):
    rng = np.random.default_rng(1)
    n = 60
    x = np.column_stack((1000 + 0.005 * rng.normal(size=n), rng.normal(size=n)))
    y = 2.0 + 30 * (x[:, 0] - 1000) - x[:, 1] + 0.01 * rng.normal(size=n)
    rows = [(1, i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)] + [(2, i, float(i), 1.0 * i, 2.0 * i) for i in range(9)] + [(3, 0, 1.0, 1.0, 1.0)]
    got = {r.g: r for r in resample.residual_alpha(spark.createDataFrame(rows, "g int, o int, y double, a double, b double"), ["g"], "o", "y", ["a", "b"]).collect()}
    centred = np.linalg.lstsq(np.column_stack((np.ones(n), x - x.mean(0))), y, rcond=None)[0]
    assert np.allclose([got[1].beta_a, got[1].beta_b], centred[1:], rtol=1e-6) and got[1].n == n and got[1].t_stat is not None
    assert (got[2].n, got[2].alpha, got[2].t_stat) == (9, None, None) and (got[3].n, got[3].alpha) == (1, None)


def test_curves_cover_the_ledger_window(spark):
    trades = spark.createDataFrame([(1, "a", D(2020, 3, 31), D(2020, 1, 10), D(2020, 1, 20), 0.1, 100.0), (1, "b", D(2020, 3, 31), D(2020, 1, 15), D(2020, 2, 5), 0.1, -30.0), (2, "a", D(2020, 3, 31), D(2020, 1, 12), D(2020, 1, 13), 0.1, 5.0)], SCHEMA)
    series = spark.createDataFrame([("x", D(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i) for i in range(60)], "symbol string, d date, px double")
    got = {(r.symbol, r.d): r.value for r in ledger.curves_over_ledger(series, trades, capital=1_000.0).collect()}
    days = sorted({d for _, d in got})
    assert (days[0], days[-1]) == (D(2020, 1, 10), D(2020, 2, 5)) and {s for s, _ in got} == {"x", "system_1", "system_2"}
    assert got["x", D(2020, 1, 10)] == 1_000.0 and got["x", D(2020, 1, 20)] == pytest.approx(1_000 * 119 / 109)
    assert [got["system_1", d] for d in (D(2020, 1, 19), D(2020, 1, 20), D(2020, 2, 5))] == [1_000.0, 1_100.0, 1_070.0]
    metrics = {r.symbol: r for r in ledger.curve_metrics(ledger.curves_over_ledger(series, trades, capital=1_000.0)).collect()}
    assert metrics["system_1"].end_value == 1_070.0 and metrics["system_1"].max_drawdown == pytest.approx(-30 / 1_100)
    assert ledger.curves_over_ledger(series, trades.limit(0)).count() == 0
