"""Resume after a crash between staging and publishing; recorded inputs and their drift."""

import pytest
from pyspark.sql import functions as F

from pitspark.sources.runs import AlreadyPublished, InputManifest, RunLog

CELLS = "firm string, q int"


def evaluate(cells):
    return cells.withColumns({"direction": F.lit("long"), "size": F.lit(0.1)})


def results(log):
    return sorted((tuple(r) for r in log.results().select("firm", "q", "direction", "error").collect()), key=str)


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([(f, q) for f in ("a", "b", None) for q in range(4)], CELLS)


def test_crash_between_staging_and_publishing(spark, cells, tmp_path, monkeypatch):
    log = RunLog(spark, str(tmp_path / "r"), ["firm", "q"])
    assert log.results() is None and log.pending(cells).count() == 12
    boom = F.when((F.col("firm") == "b") & (F.col("q") == 1), "x" * 300)
    log.run(cells.where("q < 2"), evaluate, boom)
    assert log.pending(cells).count() == 7 and log.pending(cells, retry_errors=False).count() == 6
    before = results(log)

    with monkeypatch.context() as m:
        m.setattr(type(log.log), "add", lambda self, number, entry: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            log.run(cells, evaluate)
    assert results(log) == before and log.pending(cells).count() == 7

    log.run(cells, evaluate, F.lit(None).cast("string"))
    got = results(log)
    assert len(got) == 12 and got == sorted([(f, q, "long", "") for f in ("a", "b", None) for q in range(4)], key=str)
    assert log.pending(cells).count() == 0
    log.run(cells, evaluate)
    assert results(log) == got


def test_errors_are_rows_and_cut(spark, cells, tmp_path):
    log = RunLog(spark, str(tmp_path / "r"), ["firm", "q"])
    log.run(cells, evaluate, F.when(F.col("firm") == "a", F.repeat(F.lit("x"), 300)))
    rows = {(r.firm, r.q): r for r in log.results().collect()}
    assert len(rows) == 12 and rows["a", 0].error == "x" * 200 and (rows["a", 0].direction, rows["a", 0].size) == ("no_trade", 0.0)


def test_of_two_runs_at_once_one_is_refused(spark, cells, tmp_path):
    log = RunLog(spark, str(tmp_path / "r"), ["firm", "q"])

    def slow(pending):
        RunLog(spark, log.path, log.keys).run(cells, evaluate)
        return evaluate(pending)

    with pytest.raises(AlreadyPublished):
        log.run(cells, slow)
    assert log.results().count() == 12


def test_drift_between_recorded_runs(spark, tmp_path):
    orders, other = str(tmp_path / "orders"), str(tmp_path / "x" / "other")
    spark.range(100).withColumn("v", F.col("id") % 7).repartition(4).write.parquet(orders)
    spark.range(10).coalesce(1).write.parquet(other)
    manifest, tables = InputManifest(spark, str(tmp_path / "m")), {"orders": orders, "other": other}
    assert manifest.record("one", tables)["files_read"] == 5
    assert manifest.record("same", tables)["files_read"] == 0
    assert {r.table_name: r.same for r in manifest.drift("one", "same").collect()} == {"orders": True, "other": True}

    spark.range(3).withColumn("v", F.lit(None).cast("long")).coalesce(1).write.mode("append").parquet(orders)
    assert manifest.record("more", tables)["files_read"] == 1
    got = {r.table_name: tuple(r)[1:] for r in manifest.drift("one", "more").collect()}
    assert got == {"orders": (100, 103, 1, 0, 0, False), "other": (10, 10, 0, 0, 0, True)}

    kept = spark.createDataFrame(spark.read.parquet(orders).collect(), "id long, v long")
    kept.repartition(3).write.mode("overwrite").parquet(orders)
    assert manifest.record("rewritten", tables)["files_read"] == 3
    drift = {r.table_name: r for r in manifest.drift("more", "rewritten").collect()}["orders"]
    assert drift.same and (drift.files_added, drift.files_removed) == (3, 5)
    assert {r.table_name: (r.n_files, r.n_rows) for r in manifest.tables("rewritten").collect()} == {"orders": (3, 103), "other": (1, 10)}
