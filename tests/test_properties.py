"""Whole plans: later data never changes an answer, and neither partitioning nor row order does."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitspark.operators import change, ledger, pit, signals
from pitspark.plans import bindings as b

SF = "/root/testdata/sf0.001"
CUT = dt.date(1998, 1, 1)


def early_cells(spark):
    return b.cells(spark, SF).where(F.col("t") < F.lit(CUT))


PLANS = {
    "consensus": lambda s, est, px, pm: pit.consensus_at(est, early_cells(s)).withColumns({c: F.round(c, 4) for c in ("mean_value", "dispersion")}),
    "revision": lambda s, est, px, pm: signals.revision(early_cells(s), est),
    "entry price": lambda s, est, px, pm: pit.price_asof(early_cells(s), px).select("firm", "fpe", F.round("px", 6).alias("px")),
    "trailing return": lambda s, est, px, pm: pit.trailing_return(early_cells(s), px, F.date_sub("t", 30), 330, "r").select("firm", "fpe", F.round("r", 9).alias("r")),
    "activity": lambda s, est, px, pm: change.observed_activity(pm, early_cells(s)),
    "trailing activity": lambda s, est, px, pm: change.trailing_quarter_avg(pm, early_cells(s)),
}


def rows(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("name", list(PLANS))
def test_future_rows_do_not_matter(spark, name):
    est, px, pm = b.estimates(spark, SF), b.prices(spark, SF).select("firm", "d", "px"), b.permits(spark, SF)
    known = PLANS[name](spark, est.where(F.col("anndats") < F.lit(CUT)), px.where(F.col("d") < F.lit(CUT)), pm.where(F.col("permit_date") < F.lit(CUT)))
    later = px.withColumns({"d": F.date_add("d", 4000), "px": F.col("px") * 100})
    full = PLANS[name](spark, est, px.unionByName(later), pm)
    assert rows(known) == rows(full) and known.count() > 0


@pytest.mark.parametrize("name", list(PLANS))
def test_partitioning_does_not_matter(spark, name):
    est, px, pm = b.estimates(spark, SF), b.prices(spark, SF).select("firm", "d", "px"), b.permits(spark, SF)
    one = PLANS[name](spark, est, px, pm)
    other = PLANS[name](spark, est.repartition(7, "value"), px.repartition(5, "px"), pm.repartition(3, "pad_id"))
    assert rows(one) == rows(other)


def test_ledger_uses_no_price_before_it_exists(spark):
    cells = b.cells(spark, SF)
    t = ledger.trade_ledger(signals.equal_weight(cells), cells, b.prices(spark, SF))
    assert t.where("exit_price_date <= ed OR entry_date >= ed").count() == 0 and t.count() > 0


def test_one_written_copy_serves_a_block(spark):
    with b.written_once("cells"):
        first = b.cells(spark, SF)
        with b.written_once("cells", "macro"):
            assert b.cells(spark, SF) is first
    assert rows(first) == rows(b.cells(spark, SF))
