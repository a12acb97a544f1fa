"""Calendar arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAD_DAYS = 14


def quarter_end(d) -> Column:
    """Last day of the calendar quarter holding ``d``."""
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def quarter_start(d) -> Column:
    """First day of the calendar quarter holding ``d``."""
    return F.trunc(d, "quarter")


def prior_quarter_end(q, k) -> Column:
    """The quarter end ``k`` quarters before quarter end ``q``; ``k`` may be a column."""
    back = k * F.lit(-3) if isinstance(k, Column) else F.lit(-3 * k)
    return F.last_day(F.add_months(q, back.cast("int")))


def is_quarter_end(d) -> Column:
    return (F.month(d) % 3 == 0) & (F.last_day(d) == F.col(d) if isinstance(d, str) else F.last_day(d) == d)


def parse_quarter_label(label) -> Column:
    """``2024Q3`` to the last day of that quarter; NULL when the label is malformed."""
    first = F.try_to_date(F.concat(F.substring(label, 1, 4), F.lit("-01-01")), "yyyy-MM-dd")
    q = F.substring(label, 6, 1).try_cast("int")
    ok = F.col(label).rlike("^[0-9]{4}Q[1-4]$") if isinstance(label, str) else label.rlike("^[0-9]{4}Q[1-4]$")
    return F.when(ok, F.last_day(F.add_months(first, q * 3 - 1)))


def quarter_spine(start, end) -> Column:
    """Array of every quarter end from ``start`` to ``end``, both quarter ends, inclusive."""
    firsts = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 3 months"))
    return F.transform(firsts, lambda m: F.last_day(m))


def decision_date(event_date) -> Column:
    return F.date_sub(event_date, LEAD_DAYS)


def calendar_decision_date(q, lag_days: int = 45, lead_days: int = LEAD_DAYS) -> Column:
    """Decision date when no event calendar is at hand: quarter end + lag - lead."""
    return F.date_add(q, lag_days - lead_days)


def latest_fiscal_year(t) -> Column:
    """Last fiscal year whose annual filing can be known at ``t``."""
    return F.when(F.month(t) <= 3, F.year(t) - 2).otherwise(F.year(t) - 1)


def year_window(fpe, first: int = 2019, last: int = 2023, rest: str = "2024") -> Column:
    """Year label for reporting; years outside ``first``..``last`` fall in ``rest``."""
    y = F.year(fpe)
    return F.when(y.between(first, last), y.cast("string")).otherwise(F.lit(rest))
