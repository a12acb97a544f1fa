"""Building blocks against brute force, with one key holding most rows and small thresholds, so that
the paths for large groups really run."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from pitspark.operators import core

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def skewed(n=3000, seed=1):
    """Rows (k, id, d, v); key 0 holds two thirds of them, values repeat."""
    r = random.Random(seed)
    return [(0 if r.random() < 0.67 else r.randint(1, 5), i, day(r.randint(0, 400)), round(r.gauss(0, 50), 1)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, id long, d date, v double")


def test_asof_join_fixture(spark):
    right = spark.createDataFrame([(1, day(1), 10.0), (1, day(3), 5.0), (1, day(3), 7.0), (1, day(7), 1.0)], "k int, d date, v double")
    left = spark.createDataFrame([(1, i, day(t)) for i, t in enumerate([0, 3, 5, 9])] + [(2, 9, day(5)), (1, 10, None)], "k int, id int, t date")
    want = {0: None, 1: 7.0, 2: 7.0, 3: 1.0, 9: None, 10: None}
    for panel in (False, True):
        got = core.asof_join(left, right, ["k"], "t", "d", ["v"], panel=panel)
        assert {r.id: r.v for r in got.collect()} == want


def test_asof_join_keeps_a_row_together(spark):
    right = spark.createDataFrame([(1, day(1), 10.0, "a"), (1, day(2), None, "b")], "k int, d date, v double, w string")
    got = core.asof_join(spark.createDataFrame([(1, day(5))], "k int, t date"), right, ["k"], "t", "d", ["v", "w"]).collect()
    assert [(r.v, r.w) for r in got] == [(None, "b")]


def test_asof_join_brute_force(spark):
    rows, probes = skewed(), skewed(2000, 2)
    got = core.asof_join(frame(spark, probes).withColumnRenamed("d", "t").drop("v"), frame(spark, rows), ["k"], "t", "d", ["v"]).collect()
    best = {}
    for k, _, d, v in rows:
        best[(k, d)] = max(best.get((k, d), -1e9), v)
    def look(k, t):
        hits = [d for (kk, d) in best if kk == k and d <= t]
        return best[(k, max(hits))] if hits else None
    assert len(got) == len(probes)
    assert {r.id: r.v for r in got} == {i: look(k, t) for k, i, t, _ in probes}


def test_nth_row_after(spark):
    prices = spark.createDataFrame([(1, day(i), float(i)) for i in (2, 4, 6)], "k int, d date, px double")
    events = spark.createDataFrame([(1, i, day(i)) for i in (0, 2, 3, 4, 9)], "k int, id int, e date")
    got = core.nth_row_after(events, prices, ["k"], "e", "d", "px", 2, "x")
    assert {r.id: r.x for r in got.collect()} == {0: 4.0, 2: 6.0, 3: 6.0, 4: None, 9: None}


def test_window_join_counts_both_bounds(spark):
    rows = frame(spark, skewed())
    windows = spark.createDataFrame([(k, i, day(30 * i), day(30 * i + 45)) for k in range(6) for i in range(10)] + [(0, 99, day(5), day(4))], "k int, w int, a date, z date")
    got = core.window_join(windows, rows, ["k"], "a", "z", "d").groupBy("k", "w").agg(F.count("*").alias("n"))
    data = skewed()
    want = {(k, i): sum(kk == k and day(30 * i) <= d <= day(30 * i + 45) for kk, _, d, _ in data) for k in range(6) for i in range(10)}
    assert {(r.k, r.w): r.n for r in got.collect()} == {x: n for x, n in want.items() if n}


def test_group_summary_large_and_small_paths_agree_with_numpy(spark):
    rows = skewed()
    want = {}
    for k in range(6):
        v = np.array([x for kk, _, _, x in rows if kk == k])
        want[k] = (len(v), np.median(v), np.percentile(v, 90), np.sort(v)[len(v) // 2], v.std(ddof=1))
    for small in (10**6, 700, 10):
        got = core.group_summary(frame(spark, rows), ["k"], "v", {"med": 0.5, "p90": 0.9}, upper_median="up", small=small).collect()
        assert len(got) == 6
        for r in got:
            assert np.allclose([r.n, r.med, r.p90, r.up, r.sd], want[r.k], rtol=1e-12)


def test_group_summary_of_equal_and_single_values(spark):
    df = spark.createDataFrame([(1, 5.0)] * 9 + [(2, -3.0), (3, None)], "k int, v double")
    for small in (100, 0):
        got = {r.k: (r.n, r.med, r.up) for r in core.group_summary(df, ["k"], "v", {"med": 0.5}, upper_median="up", small=small).collect()}
        assert got == {1: (9, 5.0, 5.0), 2: (1, -3.0, -3.0)}


def test_block_scan_matches_one_window(spark):
    rows = sorted(skewed(), key=lambda r: (r[0], r[2], r[1]))
    got = core.block_scan(frame(spark, rows), ["k"], ["d"], ["d", "id"], sums={"s": F.col("v")}, maxes={"m": F.col("v")}).collect()
    s, m, want = {}, {}, {}
    for k, i, _, v in rows:
        s[k], m[k] = s.get(k, 0.0) + v, max(m.get(k, -1e9), v)
        want[i] = (s[k], m[k])
    assert all(abs(r.s - want[r.id][0]) < 1e-6 and r.m == want[r.id][1] for r in got) and len(got) == len(rows)


def test_ranked_matches_sort(spark):
    rows = skewed() + [(0, 99999, DAY, None)]
    got = core.ranked(frame(spark, rows), ["k"], "v", ["id"], "r").collect()
    want = {99999: None}
    for k in range(6):
        for pos, (_, i, _, _) in enumerate(sorted([r for r in rows if r[0] == k and r[3] is not None], key=lambda r: (-r[3], r[1]))):
            want[i] = pos + 1
    assert {r.id: r.r for r in got} == want


def test_dense_index_numbers_without_gaps(spark):
    items = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    got = core.dense_index(items, ["k"], "id").collect()
    for k in (0, 1):
        assert sorted(r.idx for r in got if r.k == k) == list(range(500))


def test_value_bin_never_falls(spark):
    v = sorted([-1e12, -5.0, -1e-9, 0.0, 1e-9, 0.3, 0.30000001, 2.0, 1e3, 1e15] + [random.Random(3).gauss(0, 1e4) for _ in range(500)])
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(v)], "v double, i int")
    bins = [r.b for r in df.select("i", core.value_bin(F.col("v"), F.lit(v[0]), F.lit(v[-1])).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins) and bins[0] == 0 and bins[-1] == core.VALUE_BINS - 1


def test_top_n_keeps_few_rows_before_the_shuffle(spark):
    plan = core.first_n(frame(spark, skewed()), ["k"], [F.col("v").desc(), "id"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
