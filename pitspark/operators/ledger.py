"""Trade ledger, metrics and equity curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import scoring
from pitspark.operators import pit
from pitspark.operators.core import asof_join, block_scan, group_summary, range_blocks, with_scalar

CAPITAL = 1_000_000.0


def trade_pnl(df: DataFrame, entry: str = "entry_price", exit_: str = "exit_price", size: str = "size", capital: float = CAPITAL, bps: float = 30.0) -> DataFrame:
    """Gross and net return and P&L per row, one round-trip cost; zeros for an empty position."""
    return df.withColumns(scoring.trade_fields(F.col(entry), F.col(exit_), F.col(size), capital, bps))


def priced_cells(cells: DataFrame, prices: DataFrame) -> DataFrame:
    """Entry price as of T and exit price on the second trading day after the event, once per cell."""
    entry = pit.price_asof(cells.select(*pit.CELL, "ed"), prices, out="entry_price")
    return pit.exit_price(entry, prices)


def trade_ledger(signals: DataFrame, cells: DataFrame, prices: DataFrame, capital: float = CAPITAL, bps: float = 30.0) -> DataFrame:
    """One row per long signal with both prices. The reported exit date is two calendar days after the
    event, the exit price the one of the second trading day. Cells are priced once for all strategies."""
    longs = signals.where(F.col("direction") == "long")
    priced = priced_cells(cells, prices).where("entry_price IS NOT NULL AND exit_price IS NOT NULL")
    rows = longs.join(priced, pit.CELL).withColumnRenamed("t", "entry_date").withColumn("exit_date", F.date_add("ed", 2))
    return trade_pnl(rows, capital=capital, bps=bps)


def equity_curve(trades: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Compound growth, its running maximum and the drawdown along entry dates (same day: by firm,
    then quarter), in blocks of rows, so neither a strategy nor a crowded day meets in one task. The product is kept as a sum of logarithms with the sign and the number of zero
    factors apart, so a loss of 100 % or more is still right."""
    keys = list(keys)
    factor = 1.0 + F.col("net_return")
    order = ["entry_date", "firm", "fpe"]
    rows = range_blocks(trades, [*keys, *order])
    sums = {
        "_ln": F.when(factor != 0, F.ln(F.abs(factor))).otherwise(0.0),
        "_neg": F.when(factor < 0, 1).otherwise(0),
        "_zero": F.when(factor == 0, 1).otherwise(0),
    }
    scanned = block_scan(rows, keys, ["_block"], order, sums=sums)
    sign = F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    grown = scanned.withColumn("growth", F.when(F.col("_zero") > 0, 0.0).otherwise(sign * F.exp("_ln"))).drop(*sums)
    peaked = block_scan(grown, keys, ["_block"], order, maxes={"running_max": F.col("growth")}).drop("_block")
    return peaked.withColumn("drawdown", F.try_divide(F.col("growth") - F.col("running_max"), F.col("running_max")))


def strategy_metrics(trades: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Trades, hit rate, mean, median, mean over sample deviation, and the deepest drawdown."""
    keys = list(keys)
    stats = group_summary(trades, keys, "net_return", {"median_net": 0.5}, extra={"_wins": F.count_if(F.col("net_return") > 0)})
    depth = equity_curve(trades, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    return stats.join(depth, keys).select(
        *keys, F.col("n").alias("n_trades"), (F.col("_wins") / F.col("n")).alias("hit_rate"), F.col("mean").alias("mean_net"), "median_net",
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).alias("sharpe"), "max_drawdown",
    )


def headline_table(trades: DataFrame, strategies: DataFrame, buy_hold: DataFrame, buy_hold_id: int = 7) -> DataFrame:
    """One row per strategy, zero trades included, and the buy-and-hold row."""
    empty = strategies.where(F.col("strategy") != buy_hold_id).join(strategy_metrics(trades), "strategy", "left").na.fill(0, ["n_trades"])
    held = buy_hold.select(
        F.lit(buy_hold_id).alias("strategy"), F.lit(1).cast("bigint").alias("n_trades"), F.when(F.col("gross_return") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.col("net_return").alias("mean_net"), F.col("net_return").alias("median_net"),
    )
    return empty.unionByName(strategies.join(held, "strategy"), allowMissingColumns=True)


def window_breakdown(trades: DataFrame, cells: DataFrame, label: str = "window_label") -> DataFrame:
    """Per reporting window: cells evaluated, trades, wins, losses, hit rate, mean and total P&L; a
    window without trades still appears."""
    win = F.col("net_return") > 0
    per = trades.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(win).alias("wins"), F.count_if(~win).alias("losses"),
        F.avg(win.cast("double")).alias("hit_rate"), F.avg("net_return").alias("mean_net"), F.sum("net_pnl").alias("total_pnl"),
    )
    spine = cells.groupBy(label).agg(F.count(F.lit(1)).alias("n_cells"))
    return spine.join(per, label, "left").na.fill(0, ["n_trades", "wins", "losses", "total_pnl"])


def benchmark_curves(series: DataFrame, start, end, capital: float = CAPITAL) -> DataFrame:
    """Each symbol scaled to the capital at its first price in the window."""
    inside = series.where(F.col("d").between(start, end))
    base = inside.groupBy("symbol").agg(F.min_by("px", "d").alias("_p0"))
    return inside.join(base, "symbol").select("symbol", "d", (F.col("px") / F.col("_p0") * capital).alias("value"))


def ledger_window(trades: DataFrame) -> DataFrame:
    """One row: the first entry and the last exit of the ledger (NULLs without trades)."""
    return trades.agg(F.min("entry_date").alias("_first"), F.max("exit_date").alias("_last"))


def curves_over_ledger(series: DataFrame, trades: DataFrame, keys: Sequence[str] = ("strategy",), capital: float = CAPITAL) -> DataFrame:
    """(symbol, d, value) over the ledger's own window: every benchmark scaled to the capital at its first price in
    it, and the curve of each system on the benchmarks' days: the capital plus what its trades have made by their
    exits. A system is named system_ and its keys."""
    inside = with_scalar(series, ledger_window(trades)).where(F.col("d").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")
    base = inside.groupBy("symbol").agg(F.min_by("px", "d").alias("_p0"))
    benchmarks = inside.join(base, "symbol").select("symbol", "d", (F.col("px") / F.col("_p0") * capital).alias("value"))
    # The benchmarks' days are calendar days, the systems the strategies of a study: their grid stays small.
    days = inside.agg(F.collect_set("d").alias("_days"))
    grid = with_scalar(trades.select(*keys).distinct(), days).select(*keys, F.explode("_days").alias("d"))
    name = F.concat_ws("_", F.lit("system"), *[F.col(k).cast("string") for k in keys])
    systems = step_equity(trades, grid, list(keys), capital).select(name.alias("symbol"), "d", "value")
    return benchmarks.unionByName(systems)


def step_equity(trades: DataFrame, grid: DataFrame, keys: Sequence[str], capital: float = CAPITAL) -> DataFrame:
    """Capital plus the net P&L of trades that have exited by each grid date. P&L is summed per exit
    day first; ``grid`` has (keys, d)."""
    day = trades.groupBy(*keys, "exit_date").agg(F.sum("net_pnl").alias("_pnl"))
    so_far = F.sum("_pnl").over(Window.partitionBy(*keys).orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0))
    steps = day.select(*keys, "exit_date", so_far.alias("_cum"))
    out = asof_join(grid, steps, keys, "d", "exit_date", ["_cum"], daily=True)
    return out.withColumn("value", F.lit(capital) + F.coalesce("_cum", F.lit(0.0))).drop("_cum")


def curve_metrics(curve: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Total and annualised return, annualised daily Sharpe, deepest drawdown and end value of a daily
    curve (one row per key and day)."""
    order = Window.partitionBy(*keys).orderBy("d")
    prev, peak = F.lag("value").over(order), F.max("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumns({"_r": F.try_divide(F.col("value"), prev) - 1.0, "_dd": F.try_divide(F.col("value") - peak, peak)})
    agg = rows.groupBy(*keys).agg(
        F.min_by("value", "d").alias("_v0"), F.max_by("value", "d").alias("end_value"), F.datediff(F.max("d"), F.min("d")).alias("_days"),
        F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"), F.min("_dd").alias("max_drawdown"),
    )
    ratio, years = F.col("end_value") / F.col("_v0"), F.col("_days") / 365.25
    return agg.select(
        *keys, (ratio - 1.0).alias("total_return"), F.when(years > 0, F.pow(ratio, 1.0 / years) - 1.0).otherwise(0.0).alias("annual_return"),
        F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * (252.0 ** 0.5)).otherwise(0.0).alias("sharpe"), "max_drawdown", "end_value",
    )


def variant_status(cells: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Cells, longs, no-trades and errors per variant."""
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("decision") == "long").alias("n_long"), F.count_if(F.col("decision") == "no_trade").alias("n_no_trade"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_error"),
    )


def ablation_table(cells: DataFrame, trades: DataFrame, n_iter: int = 1000, seed: int = 0, min_trades: int = 5) -> DataFrame:
    """Status and metrics per variant; test and interval only with enough trades."""
    from pitspark.operators.resample import primary_test

    test = primary_test(trades, "firm", n_iter, seed, by=["variant"]).select("variant", "p_value", "reject", "ci_low", "ci_high")
    rows = variant_status(cells).join(strategy_metrics(trades, ["variant"]), "variant", "left").na.fill(0, ["n_trades"]).join(test, "variant", "left")
    enough = F.col("n_trades") >= min_trades
    return rows.withColumns({c: F.when(enough, F.col(c)) for c in ("p_value", "reject", "ci_low", "ci_high")})


def regime_split(trades: DataFrame, regimes: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Metrics per regime; ``regimes`` labels each entry date in one or more columns stacked as
    (entry_date, regime)."""
    return strategy_metrics(trades.join(regimes, "entry_date"), [*keys, "regime"])


def surprise_hit_rate(scored: DataFrame, actuals: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """How often the forecast lay on the same side of the consensus as the reported figure."""
    rows = scored.join(actuals, list(keys)).where("median_value IS NOT NULL AND forecast IS NOT NULL AND actual IS NOT NULL")
    same = F.signum(F.col("forecast") - F.col("median_value")) == F.signum(F.col("actual") - F.col("median_value"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias("surprise_hit_rate"))


def evidence_pack(sections: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """One nested record with an array of rows per section, in the order of its key. Sections are report
    tables: a row per strategy, metric or variant."""
    packed = None
    for name, df in sections.items():
        rest = [c for c in df.columns if c != keys[name]]
        rows = df.agg(F.array_sort(F.collect_list(F.struct(keys[name], *rest))).alias(name)).withColumn("_one", F.lit(1))
        packed = rows if packed is None else packed.join(rows, "_one")
    return packed.drop("_one")
