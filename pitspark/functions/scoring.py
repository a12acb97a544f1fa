"""Numeric rules shared by the operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitspark import params


def linear_to_db(x) -> Column:
    """10*log10(x); NULL when x is missing, not finite or not positive."""
    x = F.col(x) if isinstance(x, str) else x
    ok = (x > 0) & ~F.isnan(x) & (x < F.lit(float("inf")))
    return F.when(ok, 10 * F.log10(x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def _literal(x) -> str:
    """A string, number or truth value as SQL text."""
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else str(x)


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as a literal map, so that no join is planned for it."""
    found = F.try_element_at(F.expr(f"map({', '.join(_literal(x) for kv in table.items() for x in kv)})"), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def divergence_pct(forecast: Column, consensus: Column) -> Column:
    return F.try_divide(forecast - consensus, consensus) * 100.0


def divergence_class(pct: Column, strong: float = 15.0, modest: float = 5.0) -> Column:
    """Five classes on the unrounded percentage; a missing percentage is in line."""
    return (
        F.when(pct > strong, "strong_beat")
        .when(pct > modest, "modest_beat")
        .when(pct < -strong, "strong_miss")
        .when(pct < -modest, "modest_miss")
        .otherwise("in_line")
    )


def confidence_tier(n: Column, dispersion: Column, consensus: Column) -> Column:
    """Confidence from coverage and relative spread; the ratio is 1 without a positive consensus."""
    ratio = F.when(consensus > 0, dispersion / consensus).otherwise(1.0)
    return F.when((n >= 10) & (ratio < 0.03), "high").when(n >= 5, "medium").otherwise("low")


def passes_gate(cls: Column) -> Column:
    return cls.isin("modest_beat", "strong_beat")


def tier_size(tier: Column) -> Column:
    return lookup(tier, params.TIER_SIZE, 0.0)


def downgraded(tier: Column) -> Column:
    """One tier lower; ``none`` stays ``none``."""
    return lookup(tier, params.TIER_BELOW, "none")


def trade_fields(entry: Column, exit_: Column, size: Column, capital: float = 1_000_000.0, bps: float = 30.0) -> dict[str, Column]:
    """Return and P&L columns of one round trip; all zero when the position is empty."""
    position = size * capital
    gross = F.try_divide(exit_ - entry, entry)
    cost = position * (bps / 10_000.0)
    net_pnl = position * gross - cost

    def or_zero(c: Column) -> Column:
        return F.when(size == 0, F.lit(0.0)).otherwise(c)

    return {
        "position_value": or_zero(position),
        "gross_return": or_zero(gross),
        "cost": or_zero(cost),
        "gross_pnl": or_zero(position * gross),
        "net_pnl": or_zero(net_pnl),
        "net_return": or_zero(F.try_divide(net_pnl, position)),
    }
