"""Hash-based keys and draws. They depend on the data only, so a rerun or a lost executor gives the
same values whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_key(*cols: str) -> Column:
    """sha-256 over a canonical JSON rendering of the named columns, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def unit_draw(key: Column) -> Column:
    """A number in [0,1) fixed by ``key``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def index_draw(key: Column, k: Column) -> Column:
    """An index in 0..k-1 fixed by ``key``, out of 60 bits: even for k far beyond the clusters of any study."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint") % k


def hash_prefix(col: Column) -> Column:
    """Two digits of a hash, by which keys are numbered before their own order."""
    return F.substring(F.md5(col.cast("string")), 1, 2)
