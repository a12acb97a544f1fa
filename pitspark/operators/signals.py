"""Strategies as set-based plans. Each gives every cell a direction and a size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark import params
from pitspark.operators import pit
from pitspark.operators.core import asof_join, first_n, join_null_safe, ranked, with_scalar

BASE_SIZE = 0.10


def emit(df: DataFrame, go: Column, size: float = BASE_SIZE) -> DataFrame:
    """Cells with direction and size; an unknown condition is no trade."""
    go = F.coalesce(go, F.lit(False))
    return df.select(*pit.CELL, F.when(go, "long").otherwise("no_trade").alias("direction"), F.when(go, size).otherwise(0.0).alias("size"))


def revision(cells: DataFrame, est: DataFrame, days: int = 28) -> DataFrame:
    """Long when the median estimate rose over the last 28 days. Both dates are stacked as probes of
    one consensus plan, so the estimates are read once."""
    probes = cells.select("firm", "fpe", F.explode(F.array(F.col("t"), F.date_sub("t", days))).alias("t"))
    c = pit.consensus_at(est, probes)
    pair = c.groupBy("firm", "fpe").agg(F.max("t").alias("t"), F.max_by("median_value", "t").alias("now"), F.min_by("median_value", "t").alias("before"))
    return emit(pair, F.col("now") > F.col("before"))


def macro_momentum(cells: DataFrame, series: DataFrame, value: str = "oil", days: int = 90) -> DataFrame:
    """Long when the market series stands above its value 90 days earlier."""
    rows = cells.select(*pit.CELL).withColumn("_b", F.date_sub("t", days))
    rows = asof_join(rows, series.select("d", F.col(value).alias("_now")), [], "t", "d", ["_now"])
    rows = asof_join(rows, series.select("d", F.col(value).alias("_then")), [], "_b", "d", ["_then"])
    return emit(rows, (F.col("_then") != 0) & (F.col("_now") > F.col("_then")))


def window_change(cells: DataFrame, series: DataFrame, value: str = "rigs", default: float = params.DEFAULT_RIG_COUNT) -> DataFrame:
    """Long when the mean of the last 28 days exceeds that of the 28 days before; the day between
    counts in both."""
    rows = cells.select(*pit.CELL)
    rows = pit.window_average(rows, series, F.date_sub("t", 28), F.col("t"), value, "_cur", default)
    rows = pit.window_average(rows, series, F.date_sub("t", 56), F.date_sub("t", 28), value, "_prior", default)
    return emit(rows, (F.col("_cur") != 0) & (F.col("_prior") != 0) & (F.col("_cur") > F.col("_prior")))


def equal_weight(cells: DataFrame) -> DataFrame:
    return emit(cells, F.lit(True))


def never(cells: DataFrame) -> DataFrame:
    """Per-cell side of buy and hold: no single-name trades."""
    return emit(cells, F.lit(False))


def buy_hold(series: DataFrame, start, end, value: str = "px", cost: float = 0.0030) -> DataFrame:
    """Return of holding one series over a window, net of one round trip. An end without a price on or
    before it falls back to the first or the last price there is. One aggregate, no sort."""
    def known(bound) -> Column:
        return F.max_by(value, F.when(F.col("d") <= bound, F.col("d")))

    agg = series.agg(known(start).alias("_s"), known(end).alias("_e"), F.min_by(value, "d").alias("_first"), F.max_by(value, "d").alias("_last"))
    p0, p1 = F.coalesce("_s", "_first"), F.coalesce("_e", "_last")
    return agg.select(F.coalesce(F.try_divide(p1 - p0, p0), F.lit(0.0)).alias("gross_return")).withColumn("net_return", F.col("gross_return") - cost)


def ranking_panel(cells: DataFrame, universe: DataFrame) -> DataFrame:
    """Every firm of the universe at every distinct decision date: rankings are per date, not per
    cell. The dates (at most one per calendar day) are gathered once and exploded per firm."""
    ts = cells.select("t").distinct().agg(F.collect_list("t").alias("_ts"))
    return with_scalar(universe, ts).withColumn("t", F.explode("_ts")).drop("_ts")


def momentum_scores(panel: DataFrame, prices: DataFrame, skip: int = 30, lookback: int = 330) -> DataFrame:
    return pit.trailing_return(panel, prices, F.date_sub("t", skip), lookback, "momentum")


def zscore_by(df: DataFrame, part: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Population z-score per column and group, 0 for fewer than two values or no spread. Adds z_* and
    the group's row count. Moments are aggregated and joined back, so a large group is never in one
    task."""
    part = list(part)
    aggs = [F.count(F.lit(1)).alias("n_group")] + [a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]
    rows = join_null_safe(df, df.groupBy(*part).agg(*aggs), part)
    flat = {c: (F.col(f"_n_{c}") < 2) | (F.col(f"_s_{c}") == 0) for c in cols}
    zs = {f"z_{c}": F.when(F.col(c).isNotNull(), F.when(flat[c], 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))) for c in cols}
    return rows.withColumns(zs).drop(*[f"_{k}_{c}" for c in cols for k in "msn"])


def top_n_by(df: DataFrame, part: Sequence[str], score: str, n: int = 4, tie: str = "idx") -> DataFrame:
    """First n rows per group by score, ties in universe order; rows without a score do not take part."""
    return first_n(df.where(F.col(score).isNotNull()), part, [F.col(score).desc(), tie], n, "position")


def market_cap(shares: Column) -> Column:
    return F.col("px") * shares * 1e6


def value_inputs(panel: DataFrame, fundq: DataFrame, prices: DataFrame) -> DataFrame:
    """The three value ratios of each (firm, t) that has all of them, signed so that more is better.
    ``panel`` carries shares in millions."""
    f = pit.asof_fundamentals(panel, fundq, ["oibdpq", "oancfy", "capxy", "ceqq", "dlttq", "dlcq", "cheq"])
    rows = pit.price_asof(f, prices).where("px > 0 AND oibdpq > 0 AND ceqq > 0")
    cap = market_cap(F.col("shares"))

    def zero(c: str) -> Column:
        return F.coalesce(c, F.lit(0.0))

    ev = cap + (zero("dlttq") + zero("dlcq") - zero("cheq")) * 1e6
    return rows.withColumns({
        "neg_ev_ebitda": -ev / (F.col("oibdpq") * 4e6),
        "neg_pb": -cap / (F.col("ceqq") * 1e6),
        "fcf_yield": (zero("oancfy") - zero("capxy")) * 1e6 / cap,
    })


def quality_inputs(panel: DataFrame, fundq: DataFrame) -> DataFrame:
    """The three quality ratios of each (firm, t) that has all of them."""
    f = pit.asof_fundamentals(panel, fundq, ["niq", "oancfy", "ceqq", "dlttq", "dlcq", "saleq"])
    rows = f.where("niq IS NOT NULL AND ceqq > 0 AND saleq > 0")
    debt = F.coalesce("dlttq", F.lit(0.0)) + F.coalesce("dlcq", F.lit(0.0))
    return rows.withColumns({"roe": F.col("niq") * 4 / F.col("ceqq"), "neg_de": -debt / F.col("ceqq"), "ocf_margin": F.coalesce("oancfy", F.lit(0.0)) / F.col("saleq")})


VALUE_COLS = ["neg_ev_ebitda", "neg_pb", "fcf_yield"]
QUALITY_COLS = ["roe", "neg_de", "ocf_margin"]


def composite(inputs: DataFrame, cols: Sequence[str], out: str, minimum: int = 2) -> DataFrame:
    """Mean of the z-scores per decision date; dates with fewer than ``minimum`` firms give none."""
    z = zscore_by(inputs, ["t"], cols).where(F.col("n_group") >= minimum)
    return z.withColumn(out, sum((F.col(f"z_{c}") for c in cols[1:]), F.col(f"z_{cols[0]}")) / len(cols))


def partial_composite(z: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Mean of the z-scores that exist; NULL when none does."""
    have = sum((F.when(F.col(f"z_{c}").isNotNull(), 1).otherwise(0) for c in cols[1:]), F.when(F.col(f"z_{cols[0]}").isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(f"z_{c}", F.lit(0.0)) for c in cols[1:]), F.coalesce(f"z_{cols[0]}", F.lit(0.0)))
    return z.withColumn(out, F.when(have > 0, total / have))


def long_top(cells: DataFrame, scored: DataFrame, score: str, n: int = 4) -> DataFrame:
    """Long the cells whose firm is among the top n of its decision date."""
    top = top_n_by(scored, ["t"], score, n).select("firm", "t", F.lit(True).alias("_top"))
    return emit(cells.select(*pit.CELL).join(top, ["firm", "t"], "left"), F.col("_top"))


def factor_panel(panel: DataFrame, scores: dict[str, DataFrame], n: int = 4) -> DataFrame:
    """One row per (firm, t): each factor's score, rank (1 best) and top-n flag."""
    out = panel.select("firm", "t")
    for name, scored in scores.items():
        rank = ranked(scored.select("firm", "t", "idx", F.col(name)), ["t"], name, ["idx"], f"{name}_rank")
        flags = rank.select("firm", "t", name, f"{name}_rank", (F.col(f"{name}_rank") <= n).alias(f"{name}_top"))
        out = out.join(flags, ["firm", "t"], "left").withColumn(f"{name}_top", F.coalesce(f"{name}_top", F.lit(False)))
    return out


def spec_fundamentals(fundq: DataFrame) -> DataFrame:
    """Year-to-date cash flows turned into quarterly ones, and four-quarter return on equity (all four
    quarters required). A quarter's flow needs the sum of the quarter before it, unless it is the
    first of its year; across a missing quarter it is unknown."""
    year = Window.partitionBy("firm", F.year("datadate")).orderBy("datadate")
    four = Window.partitionBy("firm").orderBy("datadate").rowsBetween(-3, 0)

    def quarterly(c: str) -> Column:
        follows = F.last_day(F.add_months("datadate", -3)) == F.last_day(F.lag("datadate").over(year))
        return F.when(F.month("datadate") <= 3, F.col(c)).when(follows, F.col(c) - F.lag(c).over(year))

    full = (F.count("niq").over(four) == 4) & (F.count("ceqq").over(four) == 4)
    return fundq.withColumns({
        "ocf_q": quarterly("oancfy"), "capex_q": quarterly("capxy"),
        "roe_4q": F.when(full & (F.avg("ceqq").over(four) > 0), F.sum("niq").over(four) / F.avg("ceqq").over(four)),
    })


def spec_scores(panel: DataFrame, fundq: DataFrame, prices: DataFrame) -> DataFrame:
    """Documented factor variants: a missing or undefined field voids only its own ratio, and the
    composite uses the ratios that remain. Market cap is kept for breaking ties."""
    cols = ["oibdpq", "ocf_q", "capex_q", "ceqq", "dlttq", "dlcq", "cheq", "saleq", "roe_4q"]
    rows = pit.price_asof(pit.asof_fundamentals(panel, spec_fundamentals(fundq), cols), prices)
    cap = F.when(F.col("px") > 0, market_cap(F.col("shares")))
    ev = cap + (F.col("dlttq") + F.col("dlcq") - F.col("cheq")) * 1e6
    equity = F.when(F.col("ceqq") > 0, F.col("ceqq"))
    rows = rows.withColumns({
        "cap": cap,
        "s_ev": F.when(F.col("oibdpq") > 0, -ev / (F.col("oibdpq") * 1e6)), "s_pb": -cap / (equity * 1e6), "s_fcf": (F.col("ocf_q") - F.col("capex_q")) * 1e6 / cap,
        "s_roe": F.col("roe_4q"), "s_de": -(F.col("dlttq") + F.col("dlcq")) / equity, "s_ocf": F.when(F.col("saleq") > 0, F.col("ocf_q") / F.col("saleq")),
    })
    value, quality = ["s_ev", "s_pb", "s_fcf"], ["s_roe", "s_de", "s_ocf"]
    return partial_composite(partial_composite(zscore_by(rows, ["t"], value + quality), value, "value_spec"), quality, "quality_spec")
