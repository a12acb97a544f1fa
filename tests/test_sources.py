"""Readers, text helpers and sinks, on real files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from pitspark import params, schemas
from pitspark.functions import dates, hashing, text
from pitspark.operators import identity
from pitspark.sources import readers, sinks

D = dt.date


def strings(spark, schema, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def test_missing_path_gives_an_empty_typed_frame(spark, tmp_path):
    for fmt in ("csv", "parquet", "json"):
        df = readers.read_table(spark, str(tmp_path / "none"), schemas.RAW_PRICES, fmt)
        assert df.schema == schemas.RAW_PRICES and df.count() == 0


def test_csv_and_json_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,value\n2024-01-01,1.9\nbad,2\n2024-01-08,x\n2024-01-15,-3.7\n")
    raw = readers.read_table(spark, str(tmp_path / "p.csv"), schemas.RAW_MACRO, "csv")
    assert [(r.d, r.value) for r in readers.parse_macro(raw, whole=True).orderBy("d").collect()] == [(D(2024, 1, 1), 1), (D(2024, 1, 15), -3)]
    obs = {"pad_id": "p", "lat": 1.0, "lon": 2.0, "scene_id": "s1", "acquisition_date": "2024-01-01", "vv_mean_linear": 0.1, "vv_mean_db": -10.0}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps([obs, obs | {"scene_id": "s2"}]))
    (tmp_path / "j" / "b.json").write_text(json.dumps([obs]))
    (tmp_path / "j" / "c.json").write_text('[{"pad_id": "p", "la')
    texts = spark.read.text(str(tmp_path / "j"), wholetext=True)
    assert sorted(r.scene_id for r in readers.parse_sar_files(texts, "value").collect()) == ["s1", "s2"]


def test_price_rules(spark):
    base = {"TICKER": "A", "COMNAM": "x", "date": "2024-01-02", "PRC": "-20", "CFACPR": "2", "RET": "0.1"}
    rows = [base, base | {"CFACPR": ""}, base | {"CFACPR": "0"}, base | {"RET": "C"}, base | {"RET": ""}, base | {"RET": "B"}, base | {"PRC": ""}, base | {"date": "x"}, base | {"CFACPR": "x"}]
    got = [(r.adj_close, r.ret) for r in readers.parse_prices(strings(spark, schemas.RAW_PRICES, *rows)).collect()]
    assert got == [(10.0, 0.1), (20.0, 0.1), (20.0, 0.1), (10.0, None), (10.0, None)]


def test_fraction_columns_and_default(spark, tmp_path):
    (tmp_path / "f.csv").write_text("ticker,fiscal_year,permian_production_fraction_ttm,permian_fraction_ttm\nA,2020,,0.5\nA,2021,0.7,0.1\nA,2021,0.8,\nB,2020, ,0.9\nC,2020,x,\n")
    got = {(r.ticker, r.fiscal_year): r.fraction for r in readers.read_fraction(spark, str(tmp_path / "f.csv")).collect()}
    assert got[("A", 2020)] == 0.5 and got[("A", 2021)] == 0.8 and ("C", 2020) not in got
    default = readers.read_fraction(spark, str(tmp_path / "none.csv"))
    assert default.count() == len(params.UNIVERSE) * 6
    assert {r.fraction for r in default.where("ticker = 'FANG'").collect()} == {1.0}


def test_share_sentence(spark):
    cases = [
        ("The Permian accounted for 62.5% of our total production", 0.625), ("permian basin: 3% of output; the Permian gave 40 % of barrels", 0.40),
        ("Permian assets. 55% of production", None), ("Permian 400% of output", None), ("Delaware 50% of production", None),
    ]
    df = spark.createDataFrame(cases, "body string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", text.extract_share(F.col("body"))).collect())


def test_json_object_in_noise(spark):
    cases = [
        ('<think>maybe {"ok": false}</think>\n{"ok": true}', '{"ok": true}'), ('```json\n{"a": {"b": 1}}\n```', '{"a": {"b": 1}}'), ('  ```\n{"a": 1}\n``` tail {x}', '{"a": 1}'),
        ('Sure: {"a": 1} done', '{"a": 1}'), ("no object", None), ("<think>{</think>", None),
    ]
    df = spark.createDataFrame(cases, "body string, want string")
    for r in df.withColumn("got", text.json_object_text(F.col("body"))).collect():
        assert r.got == r.want, r


def test_html_white_space(spark):
    df = spark.createDataFrame([("<p>a b</p>\n\n<b x='1'>c</b> d",)], "h string")
    assert df.select(text.strip_html(F.col("h")).alias("x")).first().x == " a b c d"


def test_key_changes_with_any_input(spark):
    df = spark.createDataFrame([("p", 1, None), ("p", 1, ""), ("p", 2, None), ("q", 1, None), ("p", 1, None)], "a string, b int, c string")
    keys = [r.k for r in df.select(hashing.canonical_key("b", "a", "c").alias("k")).collect()]
    assert keys[0] == keys[4] and len(set(keys)) == 4


def test_dates(spark):
    df = spark.createDataFrame([(D(2024, 2, 29), D(2024, 3, 31)), (D(2023, 10, 1), D(2023, 12, 31))], "d date, q date")
    got = df.select(dates.quarter_end("d").alias("e"), dates.prior_quarter_end("q", 1).alias("p1"), dates.prior_quarter_end("q", 5).alias("p5"), dates.latest_fiscal_year("d").alias("fy")).collect()
    assert [tuple(r) for r in got] == [(D(2024, 3, 31), D(2023, 12, 31), D(2022, 12, 31), 2022), (D(2023, 12, 31), D(2023, 9, 30), D(2022, 9, 30), 2022)]
    labels = spark.createDataFrame([("2024Q3",), ("2024Q5",), ("x",)], "l string").select(dates.parse_quarter_label("l").alias("q")).collect()
    assert [r.q for r in labels] == [D(2024, 9, 30), None, None]
    assert spark.range(1).select(F.size(dates.quarter_spine(F.to_date(F.lit("2023-12-31")), F.to_date(F.lit("2024-12-31")))).alias("n")).first().n == 5


def test_identity_with_the_registry(spark):
    df = spark.createDataFrame([("COG",), ("AMR",), ("XYZ",), ("EOG",)], "t string")
    assert sorted(r.t for r in identity.remap_entities(df, "t").collect()) == ["CTRA", "EOG"]
    names = spark.createDataFrame([("Cimarex Energy Co",), ("Oxy USA Inc",), ("St. Mary Land",), ("Nobody",), (None,)], "n string")
    assert [r.op for r in identity.normalize_operator(names, "n", "op").collect()] == ["CTRA", "OXY", "SM", None, None]
    firms = spark.createDataFrame([("CTRA", "COTERRA ENERGY INC"), ("CTRA", "CONTURA ENERGY"), ("EOG", "Coterra Energy")], "t string, n string")
    assert identity.filter_name_prefix(firms, "t", "n").count() == 1
    assert identity.drop_contaminated(firms, "t", "n").count() == 2


def test_supplement_only_fills_later_missing_days(spark):
    schema = "k int, d date, px double"
    primary = spark.createDataFrame([(1, D(2024, 12, 30), 1.0), (1, D(2025, 1, 2), 2.0)], schema)
    extra = spark.createDataFrame([(1, D(2024, 12, 31), 9.0), (1, D(2025, 1, 2), 9.0), (1, D(2025, 1, 3), 3.0)], schema)
    got = identity.union_price_sources(primary, extra, ["k"], "d", F.to_date(F.lit("2024-12-31")))
    assert sorted(r.px for r in got.collect()) == [1.0, 2.0, 3.0]


def test_latest_run_prefers_suffix_and_full(spark):
    rows = [("d-s1-target", 1, "w", "full"), ("d-s1-target-b", 1, "w", "summary"), ("d-s1-target-b", 1, "w", "full"), ("d-s3-target-b", 3, "w", "full"), ("d-s3-target", 3, "w", "summary")]
    df = spark.createDataFrame(rows, "run_name string, strategy int, window string, kind string")
    assert sorted((r.run_name, r.kind) for r in readers.latest_run(df).collect()) == [("d-s1-target-b", "full"), ("d-s3-target", "summary")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_mirrored(df, str(tmp_path), "t")
    assert sorted(spark.read.parquet(str(tmp_path / "t.parquet")).collect()) == sorted(df.collect())
    assert spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count() == 2
    sinks.write_json_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "s.json"))
    assert spark.read.json(str(tmp_path / "s.json")).first().n == 2
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_log(sinks.quality_log(df.withColumns({"low": F.lit(True), "why": F.lit("a, b\nc")}), ["k"], "low", "why"), log)
    rows = spark.read.option("header", True).csv(log).collect()
    assert len(rows) == 4 and {r.reason for r in rows} == {"a; b c"}
    sinks.write_partitioned(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 2").count() == 1


def test_upsert_table_versions(spark, tmp_path):
    path = str(tmp_path / "cells")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.upsert_table(spark, path, first, ["k"])
    sinks.upsert_table(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    now = spark.read.parquet(sinks.current_version(spark, path).folder)
    assert sorted(map(tuple, now.collect())) == [(1, "a"), (2, "c"), (3, "d")]
