"""Inputs on which queries gave wrong results or did far more work than their result needs."""

import json
from datetime import date, datetime

import __spark_entry__ as entry
import compare


def test_upsert_keeps_the_new_row_of_order_zero(spark, tmp_path):
    """-0 is 0: the new row of a pending order 0 must not replace the order itself."""
    rows = [(k, 7, "POF"[k % 3], 10.0 + k, datetime(1995, 1, 1 + k), "5-LOW") for k in range(9)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "orders.parquet"))
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = entry.queries()["l1_upsert_buckets"](spark, str(tmp_path))
    assert compare.differences(got, con, entry.oracle_sql()["l1_upsert_buckets"]) == []


def test_observation_files_are_kept_in_packs(spark, tmp_path, monkeypatch):
    """One file in the folder per pad and year would grow with the pads; packs grow with the bytes."""
    from pitspark.plans import activity

    monkeypatch.setattr(activity, "shared_folder", lambda spark: str(tmp_path))
    n = activity.cached_files(spark, "/root/testdata/sf0.001").count()
    kept = [p for p in tmp_path.rglob("part-*") if p.is_file()]
    assert n == 70 and len(kept) <= 8


def test_packed_files_read_like_loose_ones(spark, tmp_path):
    from pitspark.sources import files

    def record(scene, day, **other):
        return {"pad_id": "7", "lat": 31.0, "lon": -104.0, "scene_id": scene, "acquisition_date": day, "vv_mean_linear": 0.1, "vv_mean_db": -10.0, **other}

    good = [record("a", "2020-01-05"), record("b", "2020-02-05")]
    texts = {2016: "null", 2017: "", 2018: "[", 2019: "[]", 2020: json.dumps(good, indent=1), 2021: json.dumps({"o": good}), 2022: json.dumps([*good, {"pad_id": "7"}]), 2023: json.dumps([record("a", "2020-01-05"), 5]), 2024: json.dumps([record("a", "no day")])}
    named = spark.createDataFrame([(f"7_31.0000_-104.0000_{y}-01-01_{y}-12-31", t) for y, t in texts.items()], "name string, text string")
    files.write_texts(named, str(tmp_path / "loose"))
    files.pack_texts(named, str(tmp_path / "packs"))
    loose = files.read_texts(spark, str(tmp_path / "loose"))
    packed = files.read_packed(spark, str(tmp_path / "packs"))
    want = {2016: ("no_list", 0, 0, False), 2017: ("no_json", 0, 0, False), 2018: ("no_json", 0, 0, False), 2019: ("too_few", 0, 0, True), 2020: ("fine", 2, 0, True), 2021: ("no_list", 0, 0, False), 2022: ("fine", 3, 1, False), 2023: ("fine", 2, 1, False), 2024: ("too_few", 1, 1, False)}
    for source in (loose, packed):
        assert {r.year: (r.status, r.n_obs, r.n_incomplete, r.readable) for r in files.audit_observation_files(source, 2).collect()} == want
        assert sorted(r.scene_id for r in files.read_observations(source).collect()) == ["a", "b"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_drop_windows_meet_their_observations_once(spark):
    """The summary of the windows reads its rows several times; the join behind them must not run as often."""
    from pitspark.operators import change

    obs = spark.createDataFrame([(1, i, date(2020, 1 + i % 6, 5), -10.0 - i) for i in range(24)], "pad_id int, scene_id int, published date, vv_db double")
    pads = spark.createDataFrame([(1, date(2020, 6, 30)), (2, date(2020, 6, 30))], "pad_id int, fpe date")
    got = change.classify_drop(obs, pads)
    assert "published" not in plan_of(got)
    # Current: March to June, values -12 - i; the upper median of 16 is the ninth from below. Prior: December to February.
    current, prior = (sorted(-10.0 - i for i in range(24) if i % 6 in months) for months in ((2, 3, 4, 5), (0, 1)))
    change_db = current[8] - prior[4]
    assert {tuple(r) for r in got.select("pad_id", "change_db", "n_obs", "state").collect()} == {(1, change_db, 16, "idle" if change_db > -1 else "continuously_active" if change_db > -2.5 else "newly_active"), (2, 0.0, 0, "idle")}


def test_rows_are_not_shuffled_to_meet_the_list_of_large_groups(spark):
    from pitspark.operators.core import group_summary

    rows = spark.createDataFrame([(k, float(i)) for k, n in ((1, 9), (2, 3)) for i in range(n)], "k int, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = group_summary(rows, ["k"], "x", {"q": 0.25}, upper_median="m", small=5)
        physical = got._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [k" in physical and not any("SortMergeJoin" in line and "LeftAnti" in line for line in physical.splitlines())
        assert {(r.k, r.n, r.q, r.m) for r in got.collect()} == {(1, 9, 2.0, 4.0), (2, 3, 0.5, 1.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_evidence_pack_writes_each_shared_table_once(spark, monkeypatch):
    """The ledger and the ablations read the same tables, estimates among them."""
    from pitspark.plans import bindings

    names, write = [], bindings.materialize
    monkeypatch.setattr(bindings, "materialize", lambda df, name="table": names.append(name) or write(df, name))
    entry.queries()["i14_evidence_pack"](spark, "/root/testdata/sf0.001")
    assert {"estimates", "cells", "permits", "prices", "macro"} <= set(names) and len(names) == len(set(names))
