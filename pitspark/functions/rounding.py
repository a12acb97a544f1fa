"""Rounding for reports. A mean of cents over a power of two lies exactly between two results, and
there the last bit of the sum decides. So that a rerun or another engine gives the same digits,
values are nudged up by a thousandth of the last kept digit first."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(col: Column | str, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(10.0 ** -(digits + 3)), digits)


def expand_sql(sql: str) -> str:
    """Write every ``rnd(expr, n)`` of an SQL text out the same way."""
    while True:
        m = re.search(r"\brnd\(", sql)
        if m is None:
            return sql
        depth, comma, i = 1, -1, m.end()
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        expr, digits = sql[m.end():comma], int(sql[comma + 1:i - 1])
        sql = f"{sql[:m.start()]}round(({expr}) + 1e-{digits + 3}::DOUBLE, {digits}){sql[i:]}"
