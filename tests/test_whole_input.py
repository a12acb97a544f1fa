"""Registered queries read every row of their tables."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from pitspark.plans import bindings as b

SF = "/root/testdata/sf0.001"


def test_coverage_counts_the_observations_of_every_pad(spark):
    want = b.sar_obs(spark, SF).groupBy("pad_id", F.year("acq").alias("year")).count()
    counted = {(r.pad_id, r.year): r["count"] for r in want.collect()}
    got = entry.queries()["e11_coverage_check"](spark, SF).collect()
    assert [r for r in got if r.n_obs != counted.get((r.pad_id, r.year), 0)] == []
    assert {k for k, n in counted.items() if n < 80} <= {(r.pad_id, r.year) for r in got}
