"""Every registered query against its SQL on DuckDB, row by row, at the smallest scale."""

import __spark_entry__ as entry
import compare
import pytest

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in SQL:
        assert compare.differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["firm", "n_trades", "hit_rate", "mean_net_return"]
    assert df.count() > 0
