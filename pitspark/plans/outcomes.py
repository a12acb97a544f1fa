"""Queries for audits, the ledger, metrics, resampling, constraints and sinks."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import dates
from pitspark.functions.rounding import rnd
from pitspark.operators import audit, change, forecast, ledger, pit, quality, resample, signals
from pitspark.plans import bindings as b
from pitspark.plans import decisions as dec
from pitspark.plans import oracle_base as o
from pitspark.plans.activity import CPM, TRUTH, noisy, relative, rolled
from pitspark.plans.point_in_time import CAPS, EXITS, close_and_shares
from pitspark.plans.registry import query
from pitspark.session import at_once, materialize, shared_folder
from pitspark.sources import sinks
from pitspark.sources.runs import InputManifest, RunLog
from pitspark.sources.snapshots import BucketTable

CP = f"{o.CELLS}, {o.PRICES}"


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


# --- H. audits

COVERAGE = """cov AS (SELECT firm, fpe, count(*) AS n_estimates, count(DISTINCT analyst) AS n_analysts, median(value) AS median_value, avg(value) AS mean_value, stddev_samp(value) AS dispersion,
 max(anndats) AS newest_anndats, min(anndats) AS oldest_anndats, count(DISTINCT analyst) >= 3 AS eligible FROM estimates WHERE fpi = 6 AND measure = 'SAL' AND month(fpe) IN (3, 6, 9, 12) AND fpe = last_day(fpe) GROUP BY 1, 2)"""


@query("h1_coverage_panel", f"WITH {o.ESTIMATES}, {COVERAGE} SELECT * REPLACE (rnd(median_value, 4) AS median_value, rnd(mean_value, 4) AS mean_value, rnd(dispersion, 4) AS dispersion) FROM cov")
def h1(spark, sf):
    return rounded(audit.coverage_panel(b.estimates(spark, sf)), 4, "median_value", "mean_value", "dispersion")


def fractions(spark, sf):
    """Basin share per firm and fiscal year, taken from the parts list."""
    part = b.table(spark, sf, "part").select((F.col("p_partkey") % 25).cast("int").alias("firm"), (F.col("p_partkey") % 8 + 1994).cast("int").alias("fiscal_year"), "p_size")
    return part.groupBy("firm", "fiscal_year").agg((F.max("p_size") / 50.0 - F.min("p_size") / 20.0).alias("fraction"))


FRACTION = "frac AS (SELECT CAST(p_partkey % 25 AS INTEGER) AS firm, CAST(1994 + p_partkey % 8 AS INTEGER) AS fiscal_year, max(p_size) / 50.0::DOUBLE - min(p_size) / 20.0::DOUBLE AS fraction FROM part GROUP BY 1, 2)"
ELIGIBLE = f"""{COVERAGE}, {FRACTION}, {CAPS}, el0 AS (SELECT c.firm, c.fpe, c.t, EXISTS (SELECT 1 FROM prices p WHERE p.firm = c.firm AND p.d <= c.t) AS listed, abs(p.close) * p.shrout * 1000 AS market_cap,
  CASE WHEN month(c.t) <= 3 THEN year(c.t) - 2 ELSE year(c.t) - 1 END AS fy FROM cells c ASOF LEFT JOIN caps p ON c.firm = p.firm AND c.t >= p.d),
el AS (SELECT e.firm, e.fpe, e.t, listed, market_cap, fraction, coalesce(n_analysts, 0) AS n_analysts,
  nullif(concat_ws(';', CASE WHEN NOT listed THEN 'not_listed' END, CASE WHEN coalesce(market_cap < 300000000, true) THEN 'low_market_cap' END, CASE WHEN coalesce(fraction < 0.3, true) THEN 'low_permian_fraction' END, CASE WHEN coalesce(n_analysts, 0) < 3 THEN 'thin_coverage' END), '') AS drop_reason
  FROM el0 e LEFT JOIN frac f ON f.firm = e.firm AND f.fiscal_year = e.fy LEFT JOIN cov ON cov.firm = e.firm AND cov.fpe = e.fpe)"""


def eligibility(spark, sf):
    return audit.eligibility_panel(b.cells(spark, sf), close_and_shares(spark, sf), fractions(spark, sf), audit.coverage_panel(b.estimates(spark, sf)), min_cap=300e6)


@query("h2_eligibility_panel", f"WITH {CP}, {ELIGIBLE} SELECT firm, fpe, t, listed, rnd(market_cap, 2) AS market_cap, rnd(fraction, 6) AS fraction, n_analysts, drop_reason IS NULL AS eligible, drop_reason FROM el")
def h2(spark, sf):
    return eligibility(spark, sf).withColumns({"market_cap": rnd("market_cap", 2), "fraction": rnd("fraction", 6)})


@query("h3_eligibility_counts", f"WITH {CP}, {ELIGIBLE} SELECT firm, count(*) FILTER (drop_reason IS NULL) AS n_eligible, count(*) AS n_quarters FROM el GROUP BY 1")
def h3(spark, sf):
    return audit.eligibility_counts(eligibility(spark, sf))


@query("h3_coverage_matrix", f"WITH {o.ESTIMATES}, {COVERAGE} SELECT firm, year(fpe) || 'Q' || quarter(fpe) AS quarter, max(n_analysts) AS n_analysts FROM cov GROUP BY 1, 2")
def h3_matrix(spark, sf):
    """The matrix over all quarters that occur, as rows."""
    matrix = audit.coverage_matrix(audit.coverage_panel(b.estimates(spark, sf)))
    return matrix.unpivot(["firm"], [c for c in matrix.columns if c != "firm"], "quarter", "n_analysts").where("n_analysts IS NOT NULL")


@query("h4_universe_rule", f"WITH {CP}, {ELIGIBLE} SELECT firm, count(*) FILTER (drop_reason IS NULL) AS n_eligible, count(*) AS n_quarters FROM el GROUP BY 1 HAVING count(*) FILTER (drop_reason IS NULL) >= 0.2 * count(*)")
def h4(spark, sf):
    return audit.universe_rule(eligibility(spark, sf), 0.2)


@query("h5_audit_flags", f"""WITH {CP}, stop AS (SELECT c.firm, c.fpe, c.t, count(DISTINCT e.analyst) AS n_analysts, c.t - max(e.anndats) AS age FROM cells c JOIN estimates e ON c.firm = e.firm AND c.fpe = e.fpe
  WHERE e.anndats <= c.t AND (e.revdats IS NULL OR e.revdats > c.t) AND (e.stopdats IS NULL OR e.stopdats > c.t) GROUP BY 1, 2, 3),
 vol AS (SELECT firm, d, avg(px * ntrades) OVER (PARTITION BY firm ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS adv FROM prices),
 src AS (SELECT firm, fpe, avg(value) AS p, median(value) AS k FROM estimates GROUP BY 1, 2)
 SELECT c.firm, c.fpe, c.t, CASE WHEN n_analysts >= 5 THEN 'high' WHEN n_analysts >= 3 THEN 'adequate' WHEN n_analysts >= 1 THEN 'thin' ELSE 'none' END AS coverage_band, age > 60 AS stale, rnd(v.adv, 4) AS adv,
  CASE WHEN abs((k - p) / p) > 0.05 THEN 'over_5pct' WHEN abs((k - p) / p) > 0.02 THEN 'over_2pct' ELSE 'ok' END AS source_gap
 FROM cells c ASOF LEFT JOIN vol v ON c.firm = v.firm AND c.t >= v.d LEFT JOIN stop s ON s.firm = c.firm AND s.fpe = c.fpe LEFT JOIN src ON src.firm = c.firm AND src.fpe = c.fpe""")
def h5(spark, sf):
    cells, est = b.cells(spark, sf), b.estimates(spark, sf)
    prices = b.prices(spark, sf).withColumn("dollar_volume", F.col("px") * F.col("ntrades"))
    sources = audit.group_summary(est, ["firm", "fpe"], "value", {"check_value": 0.5}).withColumnRenamed("mean", "primary_value")
    return rounded(audit.audit_flags(cells, pit.consensus_with_stops(est, cells), prices, sources), 4, "adv")


# --- I. ledger and metrics


TRADING = (1, 2, 3, 4, 5, 6, 8, 9, 10)


def strategy_signals(spark, sf, which=TRADING) -> DataFrame:
    """Stacked signals of the chosen strategies."""
    make = {1: dec.g1, 2: dec.g2, 3: dec.g3, 4: dec.g4, 5: dec.g5, 6: dec.g6, 8: dec.g8, 9: dec.g9, 10: dec.g10}
    parts = at_once(*[lambda s=s: make[s](spark, sf).select(*pit.CELL, "direction", "size").withColumn("strategy", F.lit(s)) for s in which])
    return reduce(DataFrame.unionByName, parts)


def trades(spark, sf, which=TRADING) -> DataFrame:
    """The ledger of the chosen strategies as a written table, since every report on it reads it
    several times; the tables behind it are written once too, those that need no other at the same time."""
    tables = {"estimates": b.estimates, "prices": b.prices}
    if {1, 2, 4, 5} & set(which):
        tables["macro"] = b.macro
    if {1, 2} & set(which):
        tables |= {"permits": b.permits}
    if {9, 10} & set(which):
        tables |= {"fundq": b.fundq}
    later = ({"scored_cells": dec.scored_cells} if {1, 2} & set(which) else {}) | ({"panel": dec.panel} if {8, 9, 10} & set(which) else {})
    with b.written_once(*tables, "cells", *later):
        for wave in (tables, {"cells": b.cells}, later):
            at_once(*[lambda get=get: get(spark, sf) for get in wave.values()])
        return materialize(ledger.trade_ledger(strategy_signals(spark, sf, which), b.cells(spark, sf), b.prices(spark, sf)), "trades")


def ledger_sql(parts: dict[int, str]) -> str:
    union = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS strategy, firm, fpe, t, direction, size FROM ({q})" for k, q in parts.items())
    return f"""{EXITS}, sig AS ({union}),
priced AS (SELECT c.firm, c.fpe, c.t, c.ed, p.px AS entry_price FROM cells c ASOF LEFT JOIN prices p ON c.firm = p.firm AND c.t >= p.d),
led0 AS (SELECT s.strategy, s.firm, s.fpe, s.t AS entry_date, CAST(p.ed + 2 AS DATE) AS exit_date, entry_price, exit_price, size, (exit_price - entry_price) / entry_price AS gross_return
  FROM sig s JOIN priced p ON s.firm = p.firm AND s.fpe = p.fpe JOIN exits x ON x.firm = s.firm AND x.fpe = s.fpe WHERE direction = 'long' AND entry_price IS NOT NULL),
led AS (SELECT *, gross_return - 0.003 AS net_return, 1000000 * size * gross_return AS gross_pnl, 1000000 * size * gross_return - 1000000 * size * 0.003::DOUBLE AS net_pnl FROM led0),
eq0 AS (SELECT *, exp(sum(ln(1 + net_return)) OVER (PARTITION BY strategy ORDER BY entry_date, firm, fpe ROWS UNBOUNDED PRECEDING)) AS growth FROM led),
eq1 AS (SELECT *, max(growth) OVER (PARTITION BY strategy ORDER BY entry_date, firm, fpe ROWS UNBOUNDED PRECEDING) AS running_max FROM eq0),
eq AS (SELECT *, (growth - running_max) / running_max AS drawdown FROM eq1),
met AS (SELECT strategy, count(*) AS n_trades, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(net_return) AS mean_net, median(net_return) AS median_net,
  CASE WHEN stddev_samp(net_return) > 0 THEN avg(net_return) / stddev_samp(net_return) END AS sharpe, min(drawdown) AS max_drawdown FROM eq GROUP BY 1)"""


SIMPLE = {3: dec.G3, 4: dec.G4, 5: dec.G5, 6: dec.signal_sql("true", "cells")}
LED4 = f"{CP}, {o.MACRO} {o.ACTIVE} {dec.REVISION}, {dec.OIL}, {dec.RIGS}, {ledger_sql(SIMPLE)}"
ALL_SIGNALS = SIMPLE | {1: "SELECT firm, fpe, t, decision AS direction, size FROM full_", 2: "SELECT firm, fpe, t, decision AS direction, size FROM nonews"}
for _id, _src, _score in ((8, "mom", "momentum"), (9, "val", "value_score"), (10, "qua", "quality_score")):
    ALL_SIGNALS[_id] = dec.signal_sql("top", f"(SELECT c.*, k.firm IS NOT NULL AS top FROM cells c LEFT JOIN (SELECT firm, t FROM {_src} WHERE {_score} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t ORDER BY {_score} DESC, idx) <= 4) k ON c.firm = k.firm AND c.t = k.t)")
PRICES_TAIL = o.PRICES.removeprefix(o.LINES + ", ")
ALL_CTE = f"""{dec.COMPOSITES}, {PRICES_TAIL} {dec.REVISION}, {dec.OIL}, {dec.RIGS}, {dec.BUY_HOLD}, {dec.PANEL}, {dec.MOM_PANEL}, {o.FUNDQ_ONLY}, {dec.FUND_PANEL}, {dec.VALUE}, {dec.composite_score('val1', 'val', 'value_score')}, {dec.QUALITY}, {dec.composite_score('qua1', 'qua', 'quality_score')}, {ledger_sql(ALL_SIGNALS)}"""
LED = ALL_CTE
EQUAL = f"{CP}, {ledger_sql({6: dec.signal_sql('true', 'cells')})}"
MET_COLS = ("hit_rate", "mean_net", "median_net", "sharpe", "max_drawdown")
MET = ", ".join(f"rnd({c}, 6) AS {c}" for c in MET_COLS)


@query("i1_trade_pnl", """SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n, rnd(sum(CASE WHEN l_discount = 0 THEN 0 ELSE (l_tax * 10 - l_quantity) / l_quantity END), 6) AS gross_return,
 rnd(sum(CASE WHEN l_discount = 0 THEN 0 ELSE (l_tax * 10 - l_quantity) / l_quantity - 0.003 END), 6) AS net_return, rnd(sum(1000000 * l_discount * ((l_tax * 10 - l_quantity) / l_quantity - 0.003)), 4) AS net_pnl FROM lineitem GROUP BY 1""")
def i1(spark, sf):
    rows = b.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("entry_price"), (F.col("l_tax") * 10).alias("exit_price"), F.col("l_discount").alias("size"))
    got = ledger.trade_pnl(rows).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("gross_return").alias("gross_return"), F.sum("net_return").alias("net_return"), F.sum("net_pnl").alias("net_pnl"))
    return rounded(rounded(got, 6, "gross_return", "net_return"), 4, "net_pnl")


@query("i2_trade_ledger", f"WITH {LED} SELECT strategy, firm, fpe, entry_date, exit_date, rnd(entry_price, 7) AS entry_price, rnd(exit_price, 7) AS exit_price, size, rnd(gross_return, 6) AS gross_return, rnd(net_return, 6) AS net_return, rnd(net_pnl, 4) AS net_pnl FROM led")
def i2(spark, sf):
    t = trades(spark, sf).select("strategy", "firm", "fpe", "entry_date", "exit_date", "entry_price", "exit_price", "size", "gross_return", "net_return", "net_pnl")
    return rounded(rounded(rounded(t, 7, "entry_price", "exit_price"), 6, "gross_return", "net_return"), 4, "net_pnl")


@query("i3_strategy_metrics", f"WITH {LED} SELECT strategy, n_trades, {MET} FROM met")
def i3(spark, sf):
    return rounded(ledger.strategy_metrics(trades(spark, sf)), 6, *MET_COLS)


@query("i3_strategy_metrics_by_firm", f"WITH {EQUAL} SELECT firm, count(*) AS n_trades, rnd(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, rnd(avg(net_return), 6) AS mean_net_return FROM led GROUP BY 1")
def i3_firm(spark, sf):
    """The flagship: equal-weight trades of every cell, reported per firm."""
    cells = b.cells(spark, sf)
    t = ledger.trade_ledger(signals.equal_weight(cells), cells, b.prices(spark, sf))
    stats = t.groupBy("firm").agg(F.count(F.lit(1)).alias("n_trades"), F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate"), F.avg("net_return").alias("mean_net_return"))
    return rounded(stats, 6, "hit_rate", "mean_net_return")


@query("i4_equity_curve", f"WITH {LED} SELECT strategy, firm, fpe, entry_date, rnd(ln(growth), 6) AS log_growth, rnd(ln(running_max), 6) AS log_peak, rnd(drawdown, 6) AS drawdown FROM eq")
def i4(spark, sf):
    e = ledger.equity_curve(trades(spark, sf)).select("strategy", "firm", "fpe", "entry_date", F.ln("growth").alias("log_growth"), F.ln("running_max").alias("log_peak"), "drawdown")
    return rounded(e, 6, "log_growth", "log_peak", "drawdown")


def strategies(spark) -> DataFrame:
    return spark.createDataFrame(list(params.STRATEGIES.items()), "strategy int, name string")


@query("i5_headline_table", f"""WITH {ALL_CTE}, dim AS (SELECT CAST(unnest({list(params.STRATEGIES)}) AS INTEGER) AS strategy, unnest({list(params.STRATEGIES.values())}) AS name)
 SELECT strategy, name, coalesce(n_trades, 0) AS n_trades, {MET} FROM dim LEFT JOIN met USING (strategy) WHERE strategy <> 7
 UNION ALL SELECT 7, 'buy_hold', 1, CASE WHEN p1 > p0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, rnd((p1 - p0) / p0 - 0.003, 6), rnd((p1 - p0) / p0 - 0.003, 6), NULL, NULL FROM bh""")
def i5(spark, sf):
    table = ledger.headline_table(trades(spark, sf), strategies(spark), dec.buy_hold(spark, sf))
    return rounded(table, 6, *MET_COLS)


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("window_label", dates.year_window("fpe", 1995, 1999, "2000"))


@query("i6_window_breakdown", f"""WITH {LED4}, lab AS (SELECT *, CASE WHEN year(fpe) BETWEEN 1995 AND 1999 THEN CAST(year(fpe) AS VARCHAR) ELSE '2000' END AS window_label FROM led WHERE strategy = 3),
 sp AS (SELECT CASE WHEN year(fpe) BETWEEN 1995 AND 1999 THEN CAST(year(fpe) AS VARCHAR) ELSE '2000' END AS window_label, count(*) AS n_cells FROM cells GROUP BY 1)
 SELECT s.window_label, s.n_cells, count(l.firm) AS n_trades, count(*) FILTER (net_return > 0) AS wins, count(*) FILTER (net_return <= 0) AS losses, rnd(avg(CASE WHEN net_return > 0 THEN 1.0 WHEN net_return <= 0 THEN 0.0 END), 6) AS hit_rate,
 rnd(avg(net_return), 6) AS mean_net, rnd(coalesce(sum(net_pnl), 0), 4) AS total_pnl FROM sp s LEFT JOIN lab l USING (window_label) GROUP BY 1, 2""")
def i6(spark, sf):
    got = ledger.window_breakdown(labelled(trades(spark, sf, (3,))), labelled(b.cells(spark, sf)))
    return rounded(rounded(got, 6, "hit_rate", "mean_net"), 4, "total_pnl")


def series(spark, sf) -> DataFrame:
    m = b.macro(spark, sf)
    return m.select("d", "oil", F.col("rigs").cast("double").alias("rigs")).unpivot(["d"], ["oil", "rigs"], "symbol", "px")


BENCH = f"""{LED}, win AS (SELECT min(entry_date) AS a, max(exit_date) AS z FROM led), ser AS (SELECT 'oil' AS symbol, d, oil AS px FROM macro UNION ALL SELECT 'rigs', d, CAST(rigs AS DOUBLE) FROM macro),
inwin AS (SELECT ser.* FROM ser, win WHERE d BETWEEN a AND z), made AS (SELECT strategy, exit_date, sum(net_pnl) AS pnl FROM led GROUP BY 1, 2), made2 AS (SELECT strategy, exit_date, sum(pnl) OVER (PARTITION BY strategy ORDER BY exit_date) AS c FROM made),
sysgrid AS (SELECT strategy, d FROM (SELECT DISTINCT strategy FROM led), (SELECT DISTINCT d FROM inwin)),
curve AS (SELECT symbol, d, px / first_value(px) OVER (PARTITION BY symbol ORDER BY d) * 1000000 AS value FROM inwin
 UNION ALL SELECT 'system_' || g.strategy, g.d, 1000000 + coalesce(c, 0) FROM sysgrid g ASOF LEFT JOIN made2 m ON g.strategy = m.strategy AND g.d >= m.exit_date)"""
CURVE_MET = """cm0 AS (SELECT *, value / lag(value) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r, max(value) OVER (PARTITION BY symbol ORDER BY d) AS pk FROM curve),
cm AS (SELECT symbol, max_by(value, d) / min_by(value, d) AS ratio, (max(d) - min(d)) / 365.25::DOUBLE AS yrs, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252.0::DOUBLE) ELSE 0.0 END AS sharpe, min((value - pk) / pk) AS max_drawdown, max_by(value, d) AS end_value FROM cm0 GROUP BY 1)"""


def curves(spark, sf):
    """Benchmarks and systems from the first entry to the last exit, written as its metrics read it often."""
    return materialize(ledger.curves_over_ledger(series(spark, sf), trades(spark, sf)), "curves")


@query("i7_benchmark_curves", f"WITH {BENCH} SELECT symbol, d, rnd(value, 4) AS value FROM curve")
def i7(spark, sf):
    return rounded(curves(spark, sf), 4, "value")


@query("i8_step_equity", f"""WITH {LED}, steps AS (SELECT strategy, d FROM (SELECT DISTINCT strategy FROM led), (SELECT d FROM macro)), cum AS (SELECT strategy, exit_date, sum(pnl) OVER (PARTITION BY strategy ORDER BY exit_date) AS c FROM (SELECT strategy, exit_date, sum(net_pnl) AS pnl FROM led GROUP BY 1, 2))
 SELECT g.strategy, g.d, rnd(1000000 + coalesce(c, 0), 4) AS value FROM steps g ASOF LEFT JOIN cum ON g.strategy = cum.strategy AND g.d >= cum.exit_date""")
def i8(spark, sf):
    t = trades(spark, sf)
    days = b.macro(spark, sf).select("d").agg(F.collect_set("d").alias("_d"))
    grid = signals.with_scalar(t.select("strategy").distinct(), days).select("strategy", F.explode("_d").alias("d"))
    return rounded(ledger.step_equity(t, grid, ["strategy"]), 4, "value")


@query("i9_curve_metrics", f"WITH {BENCH}, {CURVE_MET} SELECT symbol, rnd(ratio - 1, 6) AS total_return, rnd(pow(ratio, 1 / yrs) - 1, 6) AS annual_return, rnd(sharpe, 6) AS sharpe, rnd(max_drawdown, 6) AS max_drawdown, rnd(end_value, 4) AS end_value FROM cm")
def i9(spark, sf):
    m = ledger.curve_metrics(curves(spark, sf))
    return rounded(rounded(m, 6, "total_return", "annual_return", "sharpe", "max_drawdown"), 4, "end_value")


VARIANTS = [("baseline_target", 0.10, "target", True, 5.0), ("cm_optimistic", 0.10, "optimistic", True, 5.0), ("cm_pessimistic", 0.10, "pessimistic", True, 5.0), ("alpha15", 0.15, "target", True, 5.0), ("alpha0", 0.0, "target", True, 5.0),
            ("no_satellite", 0.10, "target", False, 5.0), ("threshold_10", 0.15, "target", True, 10.0), ("threshold_15", 0.30, "target", True, 15.0), ("threshold_20", 0.30, "target", True, 20.0)]


def sweep(spark, sf) -> DataFrame:
    """All parameter variants in one plan: shared inputs are read once and the variants are rows."""
    with b.written_once("cells", "permits"):
        return _sweep(spark, sf)


def _sweep(spark, sf) -> DataFrame:
    cells = b.cells(spark, sf)
    settings = sorted({v[2] for v in VARIANTS})
    act = reduce(DataFrame.unionByName, [relative(spark, sf, s).select(*pit.CELL, "n_new", "n_cont", "signal").withColumn("setting", F.lit(s)) for s in settings])
    names = ("variant", "alpha", "setting_of", "radar", "modest")
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v)]) for v in VARIANTS])
    base = pit.window_average(cells, b.macro(spark, sf), F.date_sub("t", 90), F.col("t"), "oil", "oil_avg", params.DEFAULT_OIL_PRICE)
    base = dec.with_ticker(base.join(pit.consensus_at(b.estimates(spark, sf), cells), pit.CELL))
    mine = act.withColumn("p", F.explode(F.filter(rows, lambda r: r["setting_of"] == F.col("setting")))).select("*", "p.*").drop("p", "setting_of")
    mine = mine.withColumns({c: F.when(F.col("radar"), F.col(c)).otherwise(F.lit(0)) for c in ("n_new", "n_cont", "signal")})
    fc = forecast.forecast(mine.join(base, pit.CELL), F.col("alpha"), 1.0)
    scored = materialize(forecast.divergence(fc, modest=F.col("modest"), strong=1e9, unit=1.0), "swept")
    return forecast.decide(scored, dec.cell_verdicts(spark, sf), ["firm", "fpe"]).withColumn("error", F.lit(""))


def sweep_sql() -> str:
    acts, rels = [], []
    for s in ("optimistic", "pessimistic"):
        acts.append(f"noisy_{s} AS ({noisy('truth', s)}), activity_{s} AS ({rolled(f'noisy_{s}', 'cells')}), noisy_grid_{s} AS ({noisy('truth_grid', s)}), activity_grid_{s} AS ({rolled(f'noisy_grid_{s}', 'grid')}), "
                    f"trail_{s} AS (SELECT s.firm, s.fpe0 AS fpe, s.t0 AS t, avg(a.absolute_active) AS trailing_avg FROM shifted s JOIN activity_grid_{s} a ON s.firm = a.firm AND s.fpe = a.fpe AND s.t = a.t GROUP BY 1, 2, 3), "
                    f"relative_{s} AS (SELECT a.*, CASE WHEN trailing_avg > 1 THEN (absolute_active - trailing_avg) / trailing_avg ELSE 0.0 END AS signal FROM activity_{s} a JOIN trail_{s} USING (firm, fpe, t))")
    for name, alpha, setting, radar, modest in VARIANTS:
        src = "relative" if setting == "target" else f"relative_{setting}"
        rels.append(f"SELECT '{name}' AS variant, {alpha}::DOUBLE AS alpha, {modest}::DOUBLE AS modest, firm, fpe, t, {'signal' if radar else '0.0::DOUBLE'} AS signal FROM {src}")
    go = "pct > modest"
    return f"""{dec.SCORED}, {o.VERDICTS}, {dec.CELL_VERDICTS}, {', '.join(acts)}, sw AS ({' UNION ALL '.join(rels)}),
sw1 AS (SELECT sw.*, CASE WHEN f.n_analysts >= 1 THEN (f.median_value * (1 + alpha * greatest(least(sw.signal, 1.0), -1.0)) - f.median_value) / f.median_value * 100 ELSE 0 END AS pct FROM sw JOIN fc f USING (firm, fpe, t)),
sw2 AS (SELECT sw1.*, CASE WHEN {go} THEN coalesce(decision, 'no_trade') ELSE 'no_trade' END AS decision, CASE WHEN {go} THEN coalesce(conviction_tier, 'none') ELSE 'none' END AS conviction_tier FROM sw1 LEFT JOIN cv USING (firm, fpe)),
swept AS ({dec.sized_sql('sw2')})"""


@query("i11_parameter_sweep", f"WITH {sweep_sql()} SELECT variant, firm, fpe, t, rnd(pct, 4) AS divergence_pct, decision, conviction_tier, size FROM swept")
def i11(spark, sf):
    return sweep(spark, sf).select("variant", *pit.CELL, rnd("divergence_pct", 4).alias("divergence_pct"), "decision", "conviction_tier", "size")


def variant_cells(spark, sf) -> DataFrame:
    """The pipeline's variants as cells of the ablation table, with errors marked."""
    rows = sweep(spark, sf).select("variant", *pit.CELL, F.col("decision").alias("direction"), "size")
    marked = sinks.with_errors(rows, F.when(F.col("firm") % 13 == 5, F.lit("ValueError, no data")))
    return marked.withColumn("decision", F.col("direction"))


def boot_sql(source: str, cluster: str, by: str, n_iter: int = 1000, seed: int = 0) -> str:
    """Replicates of a clustered bootstrap over a ledger-like relation, per group."""
    return f"""bc AS (SELECT {by}, {cluster} AS cl, count(*) AS n, count(*) FILTER (net_return > 0) AS wins, sum(net_return) AS s, sum(net_return * net_return) AS ss FROM {source} GROUP BY 1, 2),
bi AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY substr(md5(CAST(cl AS VARCHAR)), 1, 2), cl) - 1 AS idx, count(*) OVER (PARTITION BY {by}) AS k FROM bc),
bd AS (SELECT {by}, rep, ('0x' || substr(md5('{seed}|' || rep || '|' || idx), 1, 15))::BIGINT % k AS pick FROM bi, range({n_iter}) r(rep)),
br AS (SELECT d.{by}, d.rep, sum(n) AS n, sum(wins) AS wins, sum(s) AS s, sum(ss) AS ss FROM bd d JOIN bi ON bi.{by} = d.{by} AND bi.idx = d.pick GROUP BY 1, 2),
boot AS (SELECT {by}, rep, wins / n AS hit_rate, s / n AS mean_return, CASE WHEN n < 2 OR ss - s * s / n <= ss * 1e-12 THEN 0 ELSE s / n / sqrt((ss - s * s / n) / (n - 1)) END AS sharpe FROM br)"""


def test_sql(source: str, by: str) -> str:
    return f"""tc AS (SELECT {by}, avg(hit_rate) AS m, quantile_cont(hit_rate, 0.025) AS ci_low, quantile_cont(hit_rate, 0.975) AS ci_high, count(*) AS n_iter FROM boot GROUP BY 1),
tob AS (SELECT {by}, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS obs, count(*) FILTER (net_return > 0) AS wins, count(*) AS n FROM {source} GROUP BY 1),
tp AS (SELECT b.{by}, avg(CASE WHEN round(hit_rate - m + 0.5 - obs, 12) >= 0 THEN 1.0 ELSE 0.0 END) AS p_value FROM boot b JOIN tc USING ({by}) JOIN tob USING ({by}) GROUP BY 1),
test AS (SELECT * FROM tob JOIN tc USING ({by}) JOIN tp USING ({by}))"""


NAMES = [v[0] for v in VARIANTS]
VARIANT_SIGNALS = {i + 1: f"SELECT firm, fpe, t, decision AS direction, size FROM swept WHERE variant = '{v}' AND firm % 13 <> 5" for i, v in enumerate(NAMES)}
VAR = f"""{ledger_sql(VARIANT_SIGNALS)}, vled AS (SELECT *, ({NAMES})[strategy] AS variant FROM led),
vst AS (SELECT variant, count(*) AS n_cells, count(*) FILTER (decision = 'long' AND firm % 13 <> 5) AS n_long, count(*) FILTER (decision = 'no_trade' OR firm % 13 = 5) AS n_no_trade, count(*) FILTER (firm % 13 = 5) AS n_error FROM swept GROUP BY 1),
{boot_sql('vled', 'firm', 'variant')}, {test_sql('vled', 'variant')},
vm AS (SELECT ({NAMES})[strategy] AS variant, * EXCLUDE (strategy) FROM met),
abl AS (SELECT variant, n_cells, n_long, n_no_trade, n_error, coalesce(n_trades, 0) AS n_trades, hit_rate, mean_net, median_net, sharpe, max_drawdown, CASE WHEN n_trades >= 5 THEN p_value END AS p_value, CASE WHEN n_trades >= 5 THEN p_value < 0.05 END AS reject,
  CASE WHEN n_trades >= 5 THEN ci_low END AS ci_low, CASE WHEN n_trades >= 5 THEN ci_high END AS ci_high FROM vst LEFT JOIN vm USING (variant) LEFT JOIN test USING (variant))"""
TESTED = ("p_value", "ci_low", "ci_high")


def ablation(spark, sf):
    with b.written_once("cells", "prices", "macro", "permits"):
        cells = materialize(variant_cells(spark, sf), "variant_cells")
        t = materialize(ledger.trade_ledger(cells, b.cells(spark, sf), b.prices(spark, sf)), "variant_trades")
    return ledger.ablation_table(cells, t)


@query("i10_ablation_table", f"""WITH {sweep_sql()}, {PRICES_TAIL}, {VAR} SELECT variant, n_cells, n_long, n_no_trade, n_error, n_trades, {MET}, rnd(p_value, 6) AS p_value, reject, rnd(ci_low, 6) AS ci_low, rnd(ci_high, 6) AS ci_high FROM abl""")
def i10(spark, sf):
    return rounded(ablation(spark, sf), 6, *MET_COLS, *TESTED)


@query("i12_regime_split", f"""WITH {LED}, mean_oil AS (SELECT avg(oil) AS m FROM macro), reg AS (SELECT t AS entry_date, CASE WHEN now >= m THEN 'oil_high' ELSE 'oil_low' END AS regime FROM (SELECT DISTINCT t, now FROM oil2), mean_oil
  UNION ALL SELECT t, CASE WHEN cur > prior THEN 'expansion' ELSE 'contraction' END FROM (SELECT DISTINCT t, cur, prior FROM rigs2))
 SELECT strategy, regime, count(*) AS n_trades, rnd(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, rnd(avg(net_return), 6) AS mean_net, rnd(median(net_return), 6) AS median_net FROM led JOIN reg USING (entry_date) GROUP BY 1, 2""")
def i12(spark, sf):
    m, cells = b.macro(spark, sf), b.cells(spark, sf)
    days = cells.select("t").distinct()
    oil = pit.asof_join(days, m, [], "t", "d", ["oil"])
    oil = signals.with_scalar(oil, m.agg(F.avg("oil").alias("_m")))
    rigs = signals.window_change(cells, m).select("t", "direction").distinct()
    regimes = oil.select(F.col("t").alias("entry_date"), F.when(F.col("oil") >= F.col("_m"), "oil_high").otherwise("oil_low").alias("regime")).unionByName(
        rigs.select(F.col("t").alias("entry_date"), F.when(F.col("direction") == "long", "expansion").otherwise("contraction").alias("regime")))
    got = ledger.regime_split(trades(spark, sf), regimes).drop("sharpe", "max_drawdown")
    return rounded(got, 6, "hit_rate", "mean_net", "median_net")


@query("i13_surprise_hit_rate", f"""WITH {dec.SCORED}, {o.FUNDQ_ONLY} SELECT firm, count(*) AS n, rnd(avg(CASE WHEN sign(forecast - median_value) = sign(saleq * 80000 - median_value) THEN 1.0 ELSE 0.0 END), 6) AS surprise_hit_rate
 FROM scored s JOIN fundq f ON f.firm = s.firm AND f.datadate = s.fpe WHERE median_value IS NOT NULL GROUP BY ALL""".replace("SELECT firm, count", "SELECT s.firm, count"))
def i13(spark, sf):
    actual = b.fundq(spark, sf).select("firm", F.col("datadate").alias("fpe"), (F.col("saleq") * 80000).alias("actual"))
    return rounded(ledger.surprise_hit_rate(dec.scored_cells(spark, sf), actual, ["firm", "fpe"], ["firm"]), 6, "surprise_hit_rate")


# --- F12, on the ledger


@query("f12_cash_sleeve", f"""WITH {LED4}, by_q AS (SELECT fpe, count(*) AS n_names, sum(size) AS allocated, sum(size * net_return) AS traded, min(entry_date) AS a, max(exit_date) AS z FROM led WHERE strategy = 3 GROUP BY 1),
 pr AS (SELECT q.*, coalesce((pz.oil - pa.oil) / pa.oil, 0) AS cash_return FROM by_q q ASOF LEFT JOIN macro pa ON q.a >= pa.d ASOF LEFT JOIN macro pz ON q.z >= pz.d)
 SELECT fpe, n_names, rnd(allocated, 6) AS allocated, rnd(CASE WHEN n_names < 12 THEN greatest(1 - allocated, 0) ELSE 0 END, 6) AS cash_weight, rnd(cash_return, 6) AS cash_return, rnd(traded + CASE WHEN n_names < 12 THEN greatest(1 - allocated, 0) ELSE 0 END * cash_return, 6) AS season_return FROM pr""")
def f12(spark, sf):
    cash = b.macro(spark, sf).select("d", F.col("oil").alias("px"))
    got = forecast.cash_sleeve(trades(spark, sf, (3,)), cash, min_names=12)
    return rounded(got, 6, "allocated", "cash_weight", "cash_return", "season_return")


# --- J. resampling


@query("j1_cluster_bootstrap_ci", f"""WITH {EQUAL}, {boot_sql('led', 'firm', 'strategy', 1000)}, long AS (UNPIVOT boot ON hit_rate, mean_return, sharpe INTO NAME metric VALUE x)
 SELECT metric, rnd(avg(x), 6) AS mean, rnd(quantile_cont(x, 0.025), 6) AS ci_low, rnd(quantile_cont(x, 0.975), 6) AS ci_high, count(*) AS n_iter FROM long GROUP BY 1""")
def j1(spark, sf):
    return rounded(resample.cluster_bootstrap(trades(spark, sf, (6,)), "firm"), 6, "mean", "ci_low", "ci_high")


@query("j2_quarter_block_bootstrap", f"""WITH {EQUAL}, {boot_sql('led', 'fpe', 'strategy', 1000)}, long AS (UNPIVOT boot ON hit_rate, mean_return, sharpe INTO NAME metric VALUE x)
 SELECT metric, rnd(avg(x), 6) AS mean, rnd(quantile_cont(x, 0.025), 6) AS ci_low, rnd(quantile_cont(x, 0.975), 6) AS ci_high, count(*) AS n_iter FROM long GROUP BY 1""")
def j2(spark, sf):
    return rounded(resample.cluster_bootstrap(trades(spark, sf, (6,)), "fpe"), 6, "mean", "ci_low", "ci_high")


@query("j3_primary_test", f"""WITH {LED}, {boot_sql('led', 'firm', 'strategy', 1000)}, {test_sql('led', 'strategy')} SELECT strategy, rnd(obs, 6) AS hit_rate_obs, wins, n, rnd(ci_low, 6) AS ci_low, rnd(ci_high, 6) AS ci_high, n_iter, rnd(p_value, 6) AS p_value, p_value < 0.05 AS reject, rnd((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM range(test.wins, test.n + 1) r(i)), 6) AS p_exact FROM test""")
def j3(spark, sf):
    got = resample.primary_test(trades(spark, sf), "firm", by=["strategy"])
    return rounded(got, 6, "hit_rate_obs", "ci_low", "ci_high", "p_value", "p_exact")


def diff_sql(a: int, b: int) -> str:
    """The block test of strategy a's hit rate against b's as tables of its own; the last is h2."""
    sums = ", ".join(f"count(*) FILTER (strategy = {k}{won}) AS {n}" for k, won, n in ((a, "", "na"), (a, " AND net_return > 0", "wa"), (b, "", "nb"), (b, " AND net_return > 0", "wb")))
    beyond = "avg(CASE WHEN round(diff - m + 0.03 - (ha - hb), 12) >= 0 THEN 1.0 ELSE 0.0 END)"
    return f"""hab AS (SELECT fpe AS cl, {sums} FROM led WHERE strategy IN ({a}, {b}) GROUP BY 1),
 hai AS (SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(cl AS VARCHAR)), 1, 2), cl) - 1 AS idx, count(*) OVER () AS k FROM hab), had AS (SELECT rep, ('0x' || substr(md5('0|' || rep || '|' || idx), 1, 15))::BIGINT % k AS pick FROM hai, range(1000) r(rep)),
 har AS (SELECT rep, sum(wa) / sum(na) - sum(wb) / sum(nb) AS diff FROM had JOIN hai ON hai.idx = had.pick GROUP BY 1 HAVING sum(na) > 0 AND sum(nb) > 0), hobs AS (SELECT sum(wa) / sum(na) AS ha, sum(wb) / sum(nb) AS hb FROM hab HAVING sum(na) > 0 AND sum(nb) > 0),
 hc AS (SELECT avg(diff) AS m, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi, count(*) AS n FROM har),
 h2 AS (SELECT ha AS hit_rate_a, hb AS hit_rate_b, ha - hb AS diff_obs, lo AS ci_low, hi AS ci_high, n AS n_iter, {beyond} AS p_value, {beyond} < 0.05 AS reject FROM har, hobs, hc GROUP BY ha, hb, lo, hi, n)"""


@query("j4_block_diff_test", f"""WITH {LED}, {diff_sql(1, 3)} SELECT rnd(hit_rate_a, 6) AS hit_rate_a, rnd(hit_rate_b, 6) AS hit_rate_b, rnd(diff_obs, 6) AS diff_obs, rnd(ci_low, 6) AS ci_low, rnd(ci_high, 6) AS ci_high, n_iter, rnd(p_value, 6) AS p_value, reject FROM h2""")
def j4(spark, sf):
    t = trades(spark, sf, (1, 3))
    got = resample.block_diff_test(t.where("strategy = 1"), t.where("strategy = 3"))
    return rounded(got, 6, "hit_rate_a", "hit_rate_b", "diff_obs", "ci_low", "ci_high", "p_value")


PACK_FIELDS = {
    "headline": ("strategy", ["n_trades", *MET_COLS]), "primary_test": ("strategy", ["hit_rate_obs", "wins", "n", "p_value", "p_exact", *TESTED[1:], "n_iter"]),
    "h2_test": ("a", ["hit_rate_a", "hit_rate_b", "diff_obs", "p_value", "ci_low", "ci_high", "n_iter"]), "intervals": ("metric", ["mean", "ci_low", "ci_high", "n_iter"]),
    "ablations": ("variant", ["n_cells", "n_long", "n_no_trade", "n_error", "n_trades", *MET_COLS, *TESTED]),
}


def _apart(sql: str) -> str:
    """The variants' tables under names of their own, beside those of the strategies."""
    return re.sub(r"\b(exits|sig|priced|led0|led|eq0|eq1|eq|met|bc|bi|bd|br|boot|tc|tob|tp|test)\b", r"v_\1", sql)


def pack_sql() -> str:
    one = "(SELECT * FROM led WHERE strategy = 1)"
    exact = "(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM range(test.wins, test.n + 1) r(i))"
    tables = {
        "headline": "SELECT * FROM met", "primary_test": f"SELECT strategy, obs AS hit_rate_obs, wins, n, p_value, {exact} AS p_exact, ci_low, ci_high, n_iter FROM test", "h2_test": "SELECT 1 AS a, * FROM h2", "ablations": "SELECT * FROM abl",
        "intervals": "SELECT metric, avg(x) AS mean, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high, count(*) AS n_iter FROM (UNPIVOT boot ON hit_rate, mean_return, sharpe INTO NAME metric VALUE x) GROUP BY 1",
    }
    parts = [f"SELECT '{name}' AS section, CAST({key} AS VARCHAR) AS item, '{f}' AS field, rnd(CAST({f} AS DOUBLE), 6) AS \"value\" FROM ({tables[name]}) WHERE {f} IS NOT NULL" for name, (key, fields) in PACK_FIELDS.items() for f in fields]
    swept = sweep_sql().removeprefix(f"{dec.SCORED}, {o.VERDICTS}, {dec.CELL_VERDICTS}, ")
    return f"WITH {LED}, {swept}, {_apart(VAR)}, {boot_sql(one, 'firm', 'strategy')}, {test_sql(one, 'strategy')}, {diff_sql(1, 3)} " + " UNION ALL ".join(parts)


@query("i14_evidence_pack", pack_sql())
def i14(spark, sf):
    with b.written_once("estimates", "cells", "permits", "prices", "macro", "fundq"):
        t, ablations = trades(spark, sf), ablation(spark, sf)
    own = t.where("strategy = 1")
    pack = ledger.evidence_pack({
        "headline": ledger.strategy_metrics(t), "primary_test": resample.primary_test(own, "firm", by=["strategy"]), "h2_test": resample.block_diff_test(own, t.where("strategy = 3")).select(F.lit(1).alias("a"), "*"),
        "intervals": resample.cluster_bootstrap(own, "firm"), "ablations": ablations,
    }, {name: key for name, (key, _) in PACK_FIELDS.items()})
    rows = []
    for name, (key, fields) in PACK_FIELDS.items():
        each = pack.select(F.explode(name).alias("r")).select(F.lit(name).alias("section"), F.col(f"r.{key}").cast("string").alias("item"), *[F.col(f"r.{f}").cast("double").alias(f) for f in fields])
        rows.append(each.unpivot(["section", "item"], fields, "field", "value").where("value IS NOT NULL"))
    return rounded(reduce(DataFrame.unionByName, rows), 6, "value")


WINS = "wk AS (SELECT firm, count(*) FILTER (net_return > 0) AS k, count(*) AS n FROM led GROUP BY 1), pe AS (SELECT firm, k, n, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM range(wk.k, wk.n + 1) r(i)) AS p FROM wk)"


def tails(spark, sf):
    t = trades(spark, sf, (6,))
    wins = t.groupBy("firm").agg(F.count_if(F.col("net_return") > 0).alias("k"), F.count(F.lit(1)).alias("n"))
    return resample.binomial_tail(wins, ["firm"], "k", "n", "p")


@query("j5_binomial_tail", f"WITH {EQUAL}, {WINS} SELECT firm, k, n, rnd(p, 6) AS p FROM pe")
def j5(spark, sf):
    return rounded(tails(spark, sf), 6, "p")


@query("j6_holm_bonferroni", f"""WITH {EQUAL}, {WINS}, h AS (SELECT firm, firm % 2 AS family, p, row_number() OVER (PARTITION BY firm % 2 ORDER BY round(p, 9), firm) AS i, count(*) OVER (PARTITION BY firm % 2) AS m FROM pe)
 SELECT family, firm, rnd(least(max((m - i + 1) * p) OVER (PARTITION BY family ORDER BY i), 1), 6) AS p_adjusted FROM h""")
def j6(spark, sf):
    tests = tails(spark, sf).select((F.col("firm") % 2).alias("family"), "firm", F.round("p", 9).alias("p"))
    return resample.holm_bonferroni(tests, ["family"]).select("family", "firm", rnd("p_adjusted", 6).alias("p_adjusted"))


@query("j7_placebo_shuffle", f"""WITH {o.PERMITS}, a AS (SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(pad_id AS VARCHAR)), 1, 2), pad_id) AS i FROM permits),
 z AS (SELECT pad_id AS donor, lat, lon, row_number() OVER (ORDER BY substr(md5('placebo|' || pad_id), 1, 2), md5('placebo|' || pad_id), pad_id) AS i FROM permits) SELECT a.pad_id, z.donor, rnd(z.lat, 6) AS lat, rnd(z.lon, 6) AS lon FROM a JOIN z USING (i)""")
def j7(spark, sf):
    return rounded(resample.placebo_shuffle(b.permits(spark, sf).select("pad_id", "lat", "lon"), "pad_id", ["lat", "lon"]), 6, "lat", "lon")


@query("j7_placebo_shift", f"WITH {o.CELLS.replace('CAST(ed - 14 AS DATE)', 'CAST(ed - 14 + 90 AS DATE)')}, {o.PERMITS}, masked AS (SELECT c.firm, c.fpe, p.pad_id, p.spud_date FROM cells c JOIN permits p ON c.firm = p.firm WHERE p.permit_date <= c.t) SELECT firm, fpe, count(*) AS n_pads FROM masked WHERE firm IN (1, 2, 3, 5, 8) GROUP BY 1, 2")
def j7_shift(spark, sf):
    rows = pit.mask_permits(b.permits(spark, sf), resample.placebo_shift(b.cells(spark, sf)))
    return resample.control_universe(rows, "firm", [1, 2, 3, 5, 8]).groupBy("firm", "fpe").agg(F.count(F.lit(1)).alias("n_pads"))


def regression_rows(spark, sf, strategy: int = 6) -> DataFrame:
    """Mean net return per strategy and quarter with the two market returns over the same quarter."""
    t = trades(spark, sf, (3, strategy))
    q = t.groupBy("strategy", "fpe").agg(F.avg("net_return").alias("y"), F.min("entry_date").alias("_a"), F.max("exit_date").alias("_b"))
    m = b.macro(spark, sf)
    start = pit.asof_join(q, m.select("d", F.col("oil").alias("_o0"), F.col("rigs").alias("_r0")), [], "_a", "d", ["_o0", "_r0"])
    both = pit.asof_join(start, m.select("d", F.col("oil").alias("_o1"), F.col("rigs").alias("_r1")), [], "_b", "d", ["_o1", "_r1"])
    return both.select("strategy", "fpe", "y", (F.col("_o1") / F.col("_o0") - 1).alias("x1"), (F.col("_r1") / F.col("_r0") - 1).alias("x2"))


REG = """rq AS (SELECT strategy, fpe, avg(net_return) AS y, min(entry_date) AS a, max(exit_date) AS z FROM led WHERE strategy IN (3, 6) GROUP BY 1, 2),
rr AS (SELECT q.strategy, q.fpe, y, e.oil / s.oil - 1 AS x1, e.rigs / s.rigs - 1 AS x2 FROM rq q ASOF JOIN macro s ON q.a >= s.d ASOF JOIN macro e ON q.z >= e.d),
mo AS (SELECT strategy, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM rr GROUP BY 1),
be AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM mo),
al AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM be),
gg AS (SELECT r.strategy, r.fpe, (y - b0 - b1 * x1 - b2 * x2) * (1.0 / n) * (1 - ((x1 - m1) * (m1 * s22 - m2 * s12) + (x2 - m2) * (m2 * s11 - m1 * s12)) / (s11 * s22 - s12 * s12)) AS g FROM rr r JOIN al USING (strategy)),
gl AS (SELECT strategy, g * g + 2 * g * (0.8 * coalesce(lag(g, 1) OVER w, 0) + 0.6 * coalesce(lag(g, 2) OVER w, 0) + 0.4 * coalesce(lag(g, 3) OVER w, 0) + 0.2 * coalesce(lag(g, 4) OVER w, 0)) AS v FROM gg WINDOW w AS (PARTITION BY strategy ORDER BY fpe)),
gv AS (SELECT strategy, sum(v) AS v FROM gl GROUP BY 1)"""


@query("j8_residual_alpha", f"WITH {LED4}, {REG} SELECT strategy, n, rnd(b0, 6) AS alpha, rnd(b1, 6) AS beta_x1, rnd(b2, 6) AS beta_x2, rnd(b0 / sqrt(v), 5) AS t_stat FROM al JOIN gv USING (strategy)")
def j8(spark, sf):
    got = resample.residual_alpha(regression_rows(spark, sf), ["strategy"], "fpe", "y", ["x1", "x2"])
    return rounded(rounded(got, 6, "alpha", "beta_x1", "beta_x2"), 5, "t_stat")


@query("j9_field_agreement", f"""WITH {o.VERDICTS}, a AS (SELECT firm, fpe, count(*) AS n_calls, count(DISTINCT coalesce(decision, '~')) = 1 AS decision_match, count(DISTINCT coalesce(conviction_tier, '~')) = 1 AS conviction_tier_match, count(DISTINCT list_sort(evidence)) = 1 AS evidence_match FROM verdicts GROUP BY 1, 2)
 SELECT *, decision_match AND conviction_tier_match AND evidence_match AS passed FROM a""")
def j9(spark, sf):
    return resample.field_agreement(b.verdicts(spark, sf), ["firm", "fpe"], ["decision", "conviction_tier", "evidence"])


# --- K. constraints


@query("k1_expect", "SELECT l_orderkey, l_linenumber, 'quantity_over_40' AS rule, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2 UNION ALL SELECT l_orderkey, l_linenumber, 'discount_without_tax', count(*) FROM lineitem WHERE l_discount > 0.05 AND l_tax = 0 GROUP BY 1, 2")
def k1(spark, sf):
    rules = {"quantity_over_40": (F.col("l_quantity") <= 40, F.col("l_quantity")), "discount_without_tax": ((F.col("l_discount") <= 0.05) | (F.col("l_tax") > 0), F.col("l_discount"))}
    return quality.expect(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], rules).groupBy("l_orderkey", "l_linenumber", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("k2_activity_rules", f"""WITH {CPM}, {TRUTH}, activity AS ({rolled('truth', 'cells', 'truth')})
 SELECT firm, fpe, t, unnest(list_filter([CASE WHEN firm = 3 THEN 'active_is_sum' END, CASE WHEN firm = 4 AND total_monitored > 0 THEN 'share_matches_counts' END, CASE WHEN firm = 5 AND total_monitored > 0 THEN 'pads_match_idle' END, CASE WHEN firm = 5 AND total_monitored > 0 AND absolute_active > 0 THEN 'share_matches_counts' END], lambda x: x IS NOT NULL)) AS rule FROM activity""")
def k2(spark, sf):
    """Activity rows with three kinds of damage, each of which must be found and nothing else."""
    states = change.truth_state(pit.mask_permits(b.permits(spark, sf), b.cells(spark, sf))).withColumn("state", F.col("truth"))
    act = change.rollup_firm_quarter(states, b.cells(spark, sf))
    f = F.col("firm")
    hurt = act.withColumns({
        "absolute_active": F.col("absolute_active") + F.when(f == 3, 1).otherwise(0),
        "share_active": F.when((f == 4) & (F.col("share_active") > 0.5), F.col("share_active") - 0.01).when(f == 4, F.col("share_active") + 0.01).otherwise(F.col("share_active")),
        "n_idle": F.col("n_idle") + F.when(f == 5, 1).otherwise(0),
    })
    return quality.activity_violations(hurt, pit.CELL, states).drop("detail")


@query("k3_class_matches_pct", f"WITH {dec.SCORED} SELECT firm, fpe, 'class_matches_pct' AS rule FROM scored WHERE firm % 3 = 0 AND divergence_class <> 'modest_beat'")
def k3(spark, sf):
    rows = dec.scored_cells(spark, sf).withColumn("divergence_class", F.when(F.col("firm") % 3 == 0, "modest_beat").otherwise(F.col("divergence_class")))
    return quality.divergence_violations(rows.withColumn("divergence_pct", F.round("divergence_pct", 2)), ["firm", "fpe"]).drop("detail")


@query("k4_size_lock", f"WITH {o.VERDICTS}, n AS ({dec.norm_sql('verdicts')}), s AS ({dec.sized_sql('n')}) SELECT verdict_id, 'size_locked' AS rule FROM s WHERE verdict_id % 7 = 0 UNION ALL SELECT verdict_id, 'no_trade_is_flat' FROM s WHERE verdict_id % 7 = 0 AND decision <> 'long' UNION ALL SELECT verdict_id, 'long_matches_tier' FROM s WHERE verdict_id % 7 = 0 AND decision = 'long'")
def k4(spark, sf):
    s = forecast.size_position(forecast.normalize_verdicts(b.verdicts(spark, sf)))
    return quality.size_violations(s.withColumn("size", F.when(F.col("verdict_id") % 7 == 0, 0.07).otherwise(F.col("size"))), ["verdict_id"]).drop("detail")


@query("k5_completeness", f"""WITH {o.CELLS}, outs AS (SELECT firm, fpe, row_id % 5 AS stage, value > 1000 AS valid, CASE WHEN row_id % 211 = 0 THEN 'boom' END AS error FROM estimates),
 per AS (SELECT firm, fpe, count(DISTINCT stage) = 5 AND bool_and(valid AND error IS NULL) AS ok FROM outs GROUP BY 1, 2) SELECT c.firm, c.fpe, coalesce(ok, false) AND c.firm % 6 <> 1 AS complete FROM cells c LEFT JOIN per USING (firm, fpe)""")
def k5(spark, sf):
    e, cells = b.estimates(spark, sf), b.cells(spark, sf)
    outputs = e.select("firm", "fpe", (F.col("row_id") % 5).alias("stage"), (F.col("value") > 1000).alias("valid"), F.when(F.col("row_id") % 211 == 0, "boom").alias("error"))
    return quality.completeness(cells, outputs, cells.where("firm % 6 <> 1"), ["firm", "fpe"])


@query("k6_leak_check", f"WITH {o.CELLS} SELECT c.firm, c.fpe, e.row_id, e.anndats FROM cells c JOIN estimates e USING (firm, fpe) WHERE e.anndats > c.t")
def k6(spark, sf):
    used = b.cells(spark, sf).join(b.estimates(spark, sf), ["firm", "fpe"])
    return quality.leaks(used, "anndats").select("firm", "fpe", "row_id", "anndats")


#: Columns of the supplied tables, with the kind where a plain cast to text isn't the same everywhere.
STORED = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal:f c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal:f",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:f", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:f o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag l_linestatus l_shipdate:t", "events": "event_id ts:t user_id event_type value:f props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding:a label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
PRINTED = {"orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "customer": "c_custkey c_name c_nationkey", "documents": "doc_id text lang source", "conversations": "conv_id turn role text"}


def printed_sql(name: str, columns: str) -> str:
    forms = {"": "CAST({0} AS VARCHAR)", "f": "printf('%.12e', {0})", "t": "CAST(epoch_us({0}) AS VARCHAR)", "a": "array_to_string([CAST(floor(CAST(x AS DOUBLE) * 1e9::DOUBLE) AS BIGINT) FOR x IN {0}], ',')"}
    texts = [(c, forms[kind].format(f'"{c}"')) for c, _, kind in (x.partition(":") for x in columns.split())]
    text = " || ".join(f"'{c}=' || coalesce(length({t}) || ':' || {t}, 'null')" for c, t in texts)
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(sum(('0x' || substr(md5({text}), 1, 15))::BIGINT) AS VARCHAR) AS content_hash FROM {name}"


@query("k7_table_fingerprint", " UNION ALL ".join(printed_sql(n, c) for n, c in STORED.items()))
def k7(spark, sf):
    return reduce(DataFrame.unionByName, [quality.table_fingerprint(b.table(spark, sf, n), n) for n in STORED])


@query("k7_portable_fingerprint", " UNION ALL ".join(printed_sql(n, c) for n, c in PRINTED.items()))
def k7_portable(spark, sf):
    """The same over chosen columns."""
    return reduce(DataFrame.unionByName, [quality.table_fingerprint(b.table(spark, sf, n).select(*c.split()), n) for n, c in PRINTED.items()])


@query("k7_run_drift", """SELECT 'orders' AS table_name, count(*) AS rows_before, count(*) + count(*) FILTER (o_orderstatus = 'P') AS rows_after, CAST(1 AS BIGINT) AS files_added, CAST(0 AS BIGINT) AS files_removed, CAST(0 AS BIGINT) AS files_changed, false AS same FROM orders
 UNION ALL SELECT 'customer', count(*), count(*), 0, 0, 0, true FROM customer""")
def k7_drift(spark, sf):
    """Two recorded runs: between them one table has got another file, of which only that is read again."""
    folders = {n: f"{_folder(spark, 'inputs')}/{n}" for n in ("orders", "customer")}
    for n, folder in folders.items():
        b.table(spark, sf, n).repartition(4).write.parquet(folder)
    manifest = InputManifest(spark, _folder(spark, "manifest"))
    manifest.record("first", folders)
    b.table(spark, sf, "orders").where("o_orderstatus = 'P'").coalesce(1).write.mode("append").parquet(folders["orders"])
    manifest.record("second", folders)
    return manifest.drift("first", "second")


# --- L. set operations around sinks


@query("l1_upsert_by_key", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders")
def l1(spark, sf):
    base = b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("v"))
    new = base.where("o_orderstatus = 'P'").withColumn("v", F.col("v") * 2)
    return sinks.upsert_by_key(base, new, ["o_orderkey"]).select("o_orderkey", "v")


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("l1_upsert_table", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders")
def l1_table(spark, sf):
    """The same against a versioned table on disk."""
    base = b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("v"))
    path = _folder(spark, "upsert")
    sinks.upsert_table(spark, path, base, ["o_orderkey"])
    sinks.upsert_table(spark, path, base.where("o_orderstatus = 'P'").withColumn("v", F.col("v") * 2), ["o_orderkey"])
    return spark.read.parquet(sinks.current_version(spark, path).folder).select("o_orderkey", "v")


@query("l1_upsert_buckets", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders
 UNION ALL SELECT -o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderstatus = 'P'""")
def l1_buckets(spark, sf):
    """The same against a table in buckets: changed and new keys, then a snapshot to read. The status is part of
    the key: the new row of order 0 has that number too, and is not a change of the old one."""
    base = b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("v"))
    changed = base.where("o_orderstatus = 'P'")
    store = BucketTable(spark, _folder(spark, "buckets"), 1 << 17)
    store.create(base, ["o_orderkey", "o_orderstatus"])
    store.upsert(changed.withColumn("v", F.col("v") * 2).unionByName(changed.withColumns({"o_orderkey": -F.col("o_orderkey"), "o_orderstatus": F.lit("N")})))
    return store.read()


@query("l3_mirrored_writes", f"WITH {o.CELLS} SELECT 'parquet' AS kind, firm, fpe, ed FROM earnings UNION ALL SELECT 'csv', firm, fpe, ed FROM earnings")
def l3(spark, sf):
    path = _folder(spark, "mirrored")
    sinks.write_mirrored(b.earnings(spark, sf), path, "earnings")
    schema = "firm int, fpe date, ed date"
    a = spark.read.schema(schema).parquet(f"{path}/earnings.parquet").withColumn("kind", F.lit("parquet"))
    return a.unionByName(spark.read.schema(schema).option("header", True).csv(f"{path}/earnings.csv").withColumn("kind", F.lit("csv")))


@query("l4_json_summary", "SELECT o_orderstatus, count(*) AS n, rnd(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def l4(spark, sf):
    path = _folder(spark, "summary")
    summary = b.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 4).alias("mean"))
    sinks.write_json_summary(summary, path)
    return spark.read.schema("o_orderstatus string, n bigint, mean double").json(path)


@query("l2_dedup_keep_last", "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def l2(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return sinks.dedup_keep_last(rows, ["o_custkey"], ["d", "o_orderkey"])


@query("l5_quality_log", f"WITH {o.VERDICTS} SELECT verdict_id, weight < 0.5 AS low_quality_flag, replace(reasoning, ',', ';') AS reason FROM verdicts")
def l5(spark, sf):
    v = b.verdicts(spark, sf).withColumn("low", F.col("weight") < 0.5)
    return sinks.quality_log(v, ["verdict_id"], "low", "reasoning")


@query("l6_union", "SELECT l_suppkey AS k, 'line' AS kind, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_custkey, 'order', count(*) FROM orders GROUP BY 1")
def l6(spark, sf):
    a = b.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).count().withColumn("kind", F.lit("line"))
    z = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).count().withColumn("kind", F.lit("order"))
    return a.unionByName(z).withColumnRenamed("count", "n")


@query("l7_distinct", "SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem")
def l7(spark, sf):
    return b.table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("d")).distinct()


@query("l8_sort", f"WITH {o.CELLS} SELECT firm, fpe, ed FROM cells ORDER BY firm, fpe")
def l8(spark, sf):
    return b.earnings(spark, sf).orderBy("firm", "fpe")


@query("l9_top_k_per_group", "SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS position_ FROM orders QUALIFY position_ <= 3")
def l9(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return signals.first_n(rows, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3, "position_")


@query("l10_error_capture", f"WITH {o.CELLS} SELECT firm, fpe, t, CASE WHEN firm % 13 = 5 THEN 'no_trade' ELSE 'long' END AS direction, CASE WHEN firm % 13 = 5 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS size, CASE WHEN firm % 13 = 5 THEN repeat('x', 200) ELSE '' END AS error FROM cells")
def l10(spark, sf):
    return sinks.with_errors(signals.equal_weight(b.cells(spark, sf)), F.when(F.col("firm") % 13 == 5, F.repeat(F.lit("x"), 300)))


@query("l11_resume", f"WITH {o.CELLS} SELECT firm, fpe, t FROM cells WHERE NOT (year(fpe) < 1999)")
def l11(spark, sf):
    cells = b.cells(spark, sf).select(*pit.CELL)
    return sinks.pending(cells, cells.where(F.year("fpe") < 1999), ["firm", "fpe"])


@query("l11_resume_after_crash", f"""WITH {o.CELLS} SELECT firm, fpe, t, CASE WHEN firm % 13 = 5 THEN 'no_trade' ELSE 'long' END AS direction, CASE WHEN firm % 13 = 5 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS size, CASE WHEN firm % 13 = 5 THEN 'no data' ELSE '' END AS error FROM cells""")
def l11_crash(spark, sf):
    """A run over the earlier cells that is published, one over all that stops before it is, and its repetition."""
    cells = b.cells(spark, sf)
    log = RunLog(spark, _folder(spark, "runs"), pit.CELL)
    failed = F.when(F.col("firm") % 13 == 5, "no data")
    log.run(cells.where(F.year("fpe") < 1997), signals.equal_weight, failed)
    log.stage(sinks.with_errors(signals.equal_weight(log.pending(cells)), failed))
    log.run(cells, signals.equal_weight, failed)
    return log.results().select(*pit.CELL, "direction", "size", "error")
