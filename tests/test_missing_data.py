"""Branches that the supplied tables don't reach: masked pixels, missing values, NULL keys, repeated keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitspark import params
from pitspark.operators import change, core, identity, pit, quality, resample, signals
from pitspark.sources import readers, sinks


def test_masked_pixels_stay_out_of_the_mean(spark):
    nan = float("nan")
    px = spark.createDataFrame([(1, 31.0, -104.0, 0.5, nan), (1, 31.0, -104.0, nan, nan), (1, 31.0, -104.0, 0.7, nan), (2, 31.0, -104.0, nan, 0.1)], "scene_id int, lat double, lon double, vv double, vh double")
    pads = spark.createDataFrame([(7, 31.0, -104.0)], "pad_id int, lat double, lon double")
    rows = change.zonal_mean(px, pads).collect()
    assert [(r.scene_id, round(r.vv, 9), r.vh, r.n_pixels) for r in rows] == [(1, 0.6, None, 3)]


def test_estimates_without_value_hide_nothing(spark):
    day = dt.date(2020, 1, 1)
    est = spark.createDataFrame(
        [(1, day, "a", day, None, 5.0, 1), (1, day, "a", day + dt.timedelta(2), None, None, 2), (1, day, "b", day, None, 7.0, None)],
        "firm int, fpe date, analyst string, anndats date, revdats date, value double, row_id long",
    )
    cells = spark.createDataFrame([(1, day, day + dt.timedelta(9))], "firm int, fpe date, t date")
    got = pit.consensus_at(est, cells).first()
    assert (got.n_analysts, got.median_value) == (2, 6.0)


def test_benchmark_symbols_survive_the_default_universe(spark):
    df = spark.createDataFrame([(s,) for s in [*params.BENCHMARK_SYMBOLS, "NOPE"]], "ticker string")
    assert sorted(r.ticker for r in identity.remap_entities(df, "ticker").collect()) == sorted(params.BENCHMARK_SYMBOLS)


def test_binomial_tail_of_missing_counts_is_unknown(spark):
    df = spark.createDataFrame([("x", 1, None), ("y", 5, 4), (None, 1, 1), ("z", 0, 3)], "g string, k long, n long")
    got = {r.g: r.p_exact for r in resample.binomial_tail(df, ["g"], "k", "n").collect()}
    assert got["x"] is None and got["y"] == 0.0 and got[None] == pytest.approx(0.5) and got["z"] == pytest.approx(1.0)


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0)], "g int, x double")
    assert {(r.g, r.z_x) for r in signals.zscore_by(df, ["g"], ["x"]).collect()} == {(None, -1.0), (None, 1.0), (1, 0.0)}
    ranked = core.ranked(df, ["g"], "x", ["x"], "pos").collect()
    assert {(r.g, r.x, r.pos) for r in ranked} == {(None, 3.0, 1), (None, 1.0, 2), (1, 2.0, 1)}
    scanned = core.block_scan(df, ["g"], ["x"], ["x"], sums={"s": F.col("x")}).collect()
    assert {(r.g, r.x, r.s) for r in scanned} == {(None, 1.0, 1.0), (None, 3.0, 4.0), (1, 2.0, 2.0)}


def test_fingerprints_of_look_alikes_differ(spark):
    def prints(rows):
        return quality.table_fingerprint(spark.createDataFrame(rows, "a string, b string"), "t").first().content_hash

    alike = [[(None, "a")], [("a", None)], [("a|b", "c")], [("a", "b|c")], [("", "a")], [("null", "a")]]
    assert len({prints(r) for r in alike}) == len(alike)
    assert prints([("x", "y"), ("p", "q")]) == prints([("p", "q"), ("x", "y")])


def test_last_new_row_of_a_key_wins(spark):
    old = spark.createDataFrame([(1, 1, "o"), (None, 1, "o")], "k int, at int, v string")
    new = spark.createDataFrame([(None, 2, "n"), (2, 1, "a"), (2, 3, "c"), (2, 2, "b")], "k int, at int, v string")
    assert {tuple(r) for r in sinks.upsert_by_key(old, new, ["k"], ["at"]).select("k", "at", "v").collect()} == {(1, 1, "o"), (None, 2, "n"), (2, 3, "c")}


def test_dates_without_leading_zeros(spark):
    got = spark.createDataFrame([("2024-1-5",), ("2024-01-05",), ("x",)], "d string").select(readers.iso_date("d").alias("d")).collect()
    assert [r.d for r in got] == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None]


def test_quarterly_flow_is_unknown_across_a_gap(spark):
    ends = [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 12, 31), dt.date(2021, 6, 30)]
    fundq = spark.createDataFrame([(1, e, v, v, 1.0, 1.0) for e, v in zip(ends, (10.0, 25.0, 70.0, 8.0), strict=True)], "firm int, datadate date, oancfy double, capxy double, niq double, ceqq double")
    got = {r.datadate: r.ocf_q for r in signals.spec_fundamentals(fundq).collect()}
    assert [got[e] for e in ends] == [10.0, 15.0, None, None]


def test_pad_years_without_observations_and_malformed_files(spark):
    obs = spark.createDataFrame([(1, dt.date(2020, 1, d)) for d in range(1, 5)] + [(1, dt.date(2021, 1, 1))], "pad_id int, acq date")
    pads = spark.createDataFrame([(1,), (2,)], "pad_id int")
    assert {tuple(r) for r in change.thin_coverage(obs, pads, 3).collect()} == {(1, 2021, 1), (2, 2020, 0), (2, 2021, 0)}
    files = spark.createDataFrame([(1, "[]"), (1, "not json"), (2, None)], "pad_id int, body string")
    assert {tuple(r) for r in change.malformed_files(files, "pad_id", "body").collect()} == {(1, 1, 2), (2, 1, 1)}


def test_mirrored_csv_refuses_large_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="one CSV file"):
        sinks.write_mirrored(spark.range(5), str(tmp_path), "t", max_rows=4)
