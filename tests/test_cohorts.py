"""Cohort sampling and active quarters against plain loops over every quarter and pad."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitspark.operators import change
from pitspark.operators.core import salted_join

D = dt.date


def some(seed):
    rng = random.Random(seed)
    day = lambda: D(2016, 1, 1) + dt.timedelta(days=rng.randrange(2_600))
    permits = []
    for pad in range(160):
        first = day()
        spud = first + dt.timedelta(days=rng.randrange(200)) if rng.random() < 0.8 else None
        done = first + dt.timedelta(days=rng.randrange(400)) if rng.random() < 0.8 else None
        permits.append((pad, "a" if pad % 3 else "b", first, spud, done))
    permits += [(1_000 + i, "a", D(2017, 5, 5), D(2017, 6, 6), D(2017, 7, 7)) for i in range(40)]  # one crowded day
    cells = [(f, q, q + dt.timedelta(days=rng.randrange(60))) for f in "abc" for q in (D(y, m, d) for y in range(2016, 2024) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31)))]
    cells += [("a", D(2021, 5, 17), D(2021, 6, 1)), ("b", D(2019, 2, 1), D(2019, 2, 20))]  # quarters that end inside a calendar quarter
    return permits, cells


def frames(spark, permits, cells):
    return spark.createDataFrame(permits, "pad_id int, firm string, permit_date date, spud_date date, completion_date date"), spark.createDataFrame(cells, "firm string, fpe date, t date")


def brute_sample(permits, cells, n):
    out = set()
    days = lambda k: dt.timedelta(days=k)
    for firm, q, t in cells:
        cohorts = [[], [], []]
        for pad, f, first, _, done in sorted(permits):
            if f != firm:
                continue
            if q - days(180) <= first <= q and (done is None or done > q):
                cohorts[0].append(pad)
            elif done and q - days(730) <= done <= q:
                cohorts[1].append(pad)
            elif done and done < q - days(730):
                cohorts[2].append(pad)
        dealt = sorted((i, c, pad) for c, pads in enumerate(cohorts) for i, pad in enumerate(pads[:n], 1))[:n]
        out |= {(firm, q, t, pad, c, i, k) for k, (i, c, pad) in enumerate(dealt, 1)}
    return out


@pytest.mark.parametrize("seed, n", [(1, 5), (2, 3), (3, 12)])
def test_sample_is_that_of_a_loop(spark, seed, n):
    permits, cells = some(seed)
    got = change.sample_pads(*frames(spark, permits, cells), n).select("firm", "fpe", "t", "pad_id", "cohort", "in_cohort", "deal")
    assert {tuple(r) for r in got.collect()} == brute_sample(permits, cells, n)


@pytest.mark.parametrize("seed", [1, 2])
def test_active_quarters_are_those_of_the_rule(spark, seed):
    """Every quarter of every pad through the rule, against the few quarters that are derived."""
    permits, cells = some(seed)
    p, c = frames(spark, permits, cells)
    quarters = c.where(F.col("fpe") == F.last_day("fpe")).where(F.month("fpe").isin(3, 6, 9, 12)).select("fpe").distinct().crossJoin(p.select("firm").distinct())
    every = change.truth_state(salted_join(quarters, p, ["firm"], "pad_id")).where("truth != 'idle'")
    want = {(r.pad_id, r.fpe, r.truth) for r in every.collect()}
    inside = {r.fpe for r in quarters.select("fpe").distinct().collect()}
    got = {(r.pad_id, r.quarter, r.state) for r in change.active_quarters(p).collect() if r.quarter in inside}
    assert got == want and len(want) > 300
